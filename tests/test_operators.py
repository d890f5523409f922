from pyspark.sql import functions as F

from glossmill.functions import terms
from glossmill.operators import glossary, model


def test_large_glossary_equals_small(spark):
    """Whatever the glossary's size: terms beside other scripts, white space in terms, letters of several cases."""
    texts = ["ESS를 쓴다", "LNG船と生成AIの", "two ESSes", "essay", "foo_bar", "foo bar", "x foo　 BAR's", "漢 字のテスト", "漢\n 字", "домой", "ДОМ", "ΟΔΟΣ", "οδος", "Kelvin K", "5 Å", "aİb", "maß", "MAẞ", "naïve NAÏVES", "H2O", "H2", "", None, "C++ and c++", "生成ai"]
    sources = ["ESS", "LNG", "AI", "ess", "foo", "foo bar", "漢  字", "漢 字の", "дом", "Дом", "οδοσ", "k", "å", "i", "aib", "maß", "naïve", "H2", "生成AI", "c++", "ss", " "]
    texts = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    entries = spark.createDataFrame([(i, s, s) for i, s in enumerate(sources)], "pos long, source string, target string")
    small, large = ({tuple(r) for r in glossary.match_terms(texts, entries, "k", "text", number=n).collect()} for n in (1, glossary.BROADCAST_TERMS + 1))
    assert {(0, 0), (1, 1), (1, 2), (7, 6), (8, 6), (9, 8)} <= {(r[0], r[1]) for r in small}
    assert large == small
    brute = texts.crossJoin(entries.withColumn("rx", terms.pattern(F.col("source")))).where(terms.occurs(F.col("text"), F.col("rx"))).select("k", "pos").collect()
    assert {(r[0], r[1]) for r in small} == {tuple(r) for r in brute}


def test_halving_ends_at_single_items(spark):
    items = spark.createDataFrame([(1 + i // 70, i, f"t{i}") for i in range(75)], "batch long, id long, text string")

    def run(rows):
        bad = rows.where("id = 33 OR id = 74").select("batch")
        return rows.join(bad, "batch", "left_anti").select("batch", "id", F.concat(F.lit("ok "), "text").alias("output"))

    got = sorted(map(tuple, model.retry_in_halves(items, run).collect()))
    assert got == [(i, f"t{i}" if i in (33, 74) else f"ok t{i}") for i in range(75)]
