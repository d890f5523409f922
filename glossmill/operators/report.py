"""The quality report: numbers that got lost, untouched text, terms not applied, broken tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import numbers, scripts, tags, terms
from glossmill.functions import text as X
from glossmill.operators import glossary

UNTOUCHED, NUMBERS, TERM, TAGS = "untranslated", "missing numbers: ", "term not applied: ", "inline tags differ"
MOST_SHOWN, MOST_ISSUES = 6, 5


def report_items(pairs: DataFrame, entries: DataFrame | None, source_lang: str, target_lang: str, limit: int | None = 500) -> DataFrame:
    """pos, n, source, target, issue for pairs (pos, source, target); entries (pos, source, target) of the direction.

    Distinct pairs only, the first of each. n numbers a pair's issues. limit rows in order; None for all.
    """
    same = source_lang != "auto" and source_lang.split("-")[0].lower() == target_lang.split("-")[0].lower()
    rows = pairs.groupBy("source", "target").agg(F.min("pos").alias("pos"))
    rows = rows.select("pos", "source", "target", X.strip(X.strip_tags(F.col("source"))).alias("s"), X.strip(X.plain_output(F.col("source"), F.col("target"))).alias("t")).where((F.col("s") != "") & X.has_letters(F.col("s")))
    s, t = F.col("s"), F.col("t")
    untouched = F.lit(not same) & (s == t) & scripts.worth_translating(s)
    if source_lang == "auto":
        untouched = untouched & ~scripts.looks_like(s, target_lang)
    miss = numbers.missing_numbers(s, t)
    shown = F.concat(F.lit(NUMBERS), F.array_join(F.slice("miss", 1, MOST_SHOWN), ", "), F.when(F.size("miss") > MOST_SHOWN, " …").otherwise(""))
    rows = rows.withColumn("miss", F.when(s != t, miss))
    if entries is not None:
        # terms are looked up by a token that any text with the term has, whatever the glossary's size
        folded = F.trim(terms.report_fold(F.col("source")))
        used = entries.select(folded.alias("anchor"), terms.report_pattern(F.col("source")).alias("rs"), terms.report_pattern(F.col("target")).alias("rt"), F.col("pos").alias("e"), F.concat(F.lit(TERM), "source", F.lit(" → "), "target").alias("i"))
        # an ASCII term stands between ASCII borders, so its first word is a word of the text; another has a sign that is no ASCII word's
        word, other = F.lit("[a-z0-9]+"), F.lit(r"[^a-z0-9_\- ]")
        plain_anchor = F.coalesce(F.get(F.regexp_extract_all("anchor", word, F.lit(0)), F.lit(0)), F.left("anchor", F.lit(1)))
        used = used.where("rs IS NOT NULL").withColumn("anchors", F.array(F.coalesce(F.get(F.regexp_extract_all("anchor", other, F.lit(0)), F.lit(0)), plain_anchor))).drop("anchor")
        plain = terms.report_fold(F.col("s"))
        found = F.array_distinct(F.concat(F.regexp_extract_all(plain, word, F.lit(0)), F.regexp_extract_all(plain, F.lit("(?s)[^a-z0-9]"), F.lit(0))))
        tried = glossary.candidates(rows.select("pos", "s", "t"), used, "pos", found, used.count())
        lost = tried.where(F.regexp_like(terms.report_fold(F.col("s")), F.col("rs")) & ~F.coalesce(F.regexp_like(terms.report_fold(F.col("t")), F.col("rt")), F.lit(False)))
        lost = lost.groupBy("pos").agg(F.array_sort(F.collect_set(F.struct("e", "i"))).alias("lost"))
        rows = rows.join(lost, "pos", "left")
        missed = F.transform(F.coalesce("lost", F.expr("CAST(array() AS array<struct<e:bigint,i:string>>)")), lambda x: x["i"])
    else:
        missed = F.expr("CAST(array() AS array<string>)")
    first = F.filter(F.array(F.when(untouched, UNTOUCHED), F.when(F.size("miss") > 0, shown)), lambda x: x.isNotNull())
    issues = F.concat(F.slice(F.concat(first, missed), F.lit(1), F.greatest(F.lit(MOST_ISSUES), F.size(first))), F.when(~tags.tags_ok(F.col("source"), F.col("target")), F.array(F.lit(TAGS))).otherwise(F.expr("CAST(array() AS array<string>)")))
    out = rows.select("pos", F.posexplode(issues).alias("n", "issue"), X.clip(s).alias("source"), X.clip(t).alias("target"))
    return out if limit is None else out.orderBy("pos", "n").limit(limit)


def preview(rows: DataFrame, doc: str, pos: str, text: str, most: int = 20_000) -> DataFrame:
    """doc, preview: the first so many characters of the lines, with a line break between two; a break at the very end counts as one. Null for a doc whose lines are all null."""
    w = Window.partitionBy(doc).orderBy(pos)
    before = F.coalesce(F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_b", before).where(F.col("_b") <= most)  # at the length itself, the line's break is the last character
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("x")))), lambda v: v["x"]), "\n")
    return kept.groupBy(doc).agg(F.when(F.count(text) > 0, F.left(joined, F.lit(most))).alias("preview"))
