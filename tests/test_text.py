from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmill.functions import chunks, scripts, tags, terms
from glossmill.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_paragraph_units():
    got = chunks.units_of("Title\r\n\r\n\r\nLine one\nline two\n \nLast.", 1200)
    assert [(u["text"], u["paragraph"]) for u in got] == [("Title", 0), ("Line one\nline two", 1), ("Last.", 2)]


def test_long_cjk_paragraph():
    units = chunks.units_of("这是一个用来测试的句子，它没有空格。" * 60, 200)
    assert len(units) > 1 and all(u["text"].endswith("。") and len(u["text"]) <= 200 for u in units)
    assert "".join(u["text"] for u in units) == "这是一个用来测试的句子，它没有空格。" * 60


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .。!\n」", max_size=120), st.integers(4, 40))
def test_units_keep_everything(text, most):
    units = chunks.units_of(text, most)
    assert all(len(u["text"]) <= most for u in units)
    assert "".join("".join(u["text"] for u in units).split()) == "".join(text.split())


def test_join_units(spark):
    rows = spark.createDataFrame([([("a ", 0, False), ("b", 0, False), ("c", 0, True), ("d", 1, False)],)], f"u {chunks.UNITS}")
    assert rows.select(chunks.join_units(F.col("u"), F.lit(" ")).alias("x")).first()["x"] == "a b\nc\n\nd"


def test_think_and_json(spark):
    assert one(spark, X.strip_think(F.col("t")), t="<think>hm\nhm</think> answer") == "answer"
    assert one(spark, X.strip_think(F.col("t")), t="left over</think>answer") == "answer"
    assert one(spark, X.strip_think(F.col("t")), t="answer <think>open") == "answer"
    assert one(spark, X.json_content(F.col("t")), t='Here:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.json_content(F.col("t")), t='so {"a": {"b": 2}} it is') == '{"a": {"b": 2}}'
    assert one(spark, X.json_content(F.col("t")), t="none") is None


def test_outer_whitespace(spark):
    assert one(spark, X.keep_outer_whitespace(F.col("s"), F.col("o")), s="  x\n", o=" y ") == "  y\n"


def test_term_occurrence(spark):
    hits = [("AI", "the AI model"), ("AI", "生成AIの"), ("ess", "two ESSes"), ("LNG", "LNG船"), ("GPU server", "gpu  servers here"), ("수소", "청정수소법"), ("H2", "(H2)")]
    misses = [("AI", "maintain"), ("IT", "it works"), ("ess", "essay"), ("cat", "concat"), ("H2", "H2O"), ("GPU server", "GPUserver")]
    rows = [(t, x, True) for t, x in hits] + [(t, x, False) for t, x in misses]
    df = spark.createDataFrame(rows, "term string, text string, hit boolean")
    wrong = df.withColumn("got", terms.occurs(F.col("text"), terms.pattern(F.col("term")))).where("got <> hit").collect()
    assert wrong == []


def test_tags():
    piece = lambda kind, key, text: {"kind": kind, "key": key, "text": text}
    pieces = [piece("text", "n", "Hello "), piece("text", "b", "bold"), piece("text", "b", " & big"), piece("atom", "", ""), piece("text", "n", " world")]
    tagged = tags.encode_pieces(pieces)
    assert tagged == "Hello <g1>bold &amp; big</g1><x1/> world"
    assert tags.encode_pieces([piece("text", "n", "12")]) is None
    back = tags.decode_tagged(tagged)
    assert [p["text"] for p in back] == ["Hello ", "bold & big", "", " world"]
    assert tags.decode_tagged("<g1>open") is None
    assert [p["kind"] for p in tags.repaired(tagged, "broken <g1>x <x1>")] == ["text", "atom"]
    assert [p["key"] for p in tags.repaired(tagged, "lost all")] == ["base", "x1"]


def test_looks_like_and_worth(spark):
    cases = [("한국어 문장", "ko", True), ("English", "ko", False), ("これは", "ja", True), ("Привет мир", "ru", True), ("123", "ko", True), ("plain", "de", True)]
    df = spark.createDataFrame(cases, "t string, l string, want boolean")
    assert df.withColumn("got", scripts.looks_like(F.col("t"), F.col("l"))).where("got <> want").count() == 0
    worth = [("Two words", True), ("NASA", False), ("John Smith", False), ("ab", False), ("한국어 문장", True)]
    df = spark.createDataFrame(worth, "t string, want boolean")
    assert df.withColumn("got", scripts.worth_translating(F.col("t"))).where("got <> want").count() == 0
