"""Terminology: which terms occur in which text, exact replacements, merging of glossaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions import terms
from glossmill.functions.languages import normalize_code
from glossmill.functions.text import has_tags, keep_outer_whitespace, squash, strip

#: A glossary up to so many rows is broadcast; a larger one is joined with the texts' tokens, its anchors in so many salts.
BROADCAST_TERMS, SALTS = 1000, 16


def directed(entries: DataFrame, target_lang: str, source_lang: str = "auto") -> DataFrame:
    """Enabled entries of a direction."""
    ok = F.col("enabled") & (normalize_code(F.col("target_lang")) == target_lang)
    if source_lang != "auto":
        ok = ok & (normalize_code(F.col("source_lang")) == source_lang)
    return entries.where(ok)


def _fold(c: Column) -> Column:
    """One form for all that a pattern without case takes as equal: characters by themselves, whatever stands around them."""
    return F.upper(F.translate(c, "İKÅΩẞϴ", "ikåωßθ"))


def _words(folded: Column) -> Column:
    """The runs between the borders that terms.pattern knows."""
    return F.regexp_extract_all(folded, F.lit(f"{terms.WORD}+"), F.lit(0))


def _pairs(folded: Column) -> Column:
    """Every two neighbouring characters, and every one."""
    return F.concat(F.regexp_extract_all(folded, F.lit("(?s)(?=(..))"), F.lit(1)), F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)))


def anchors(term: Column, mode: Column) -> Column:
    """struct<by_pairs, anchors>: what any text with the term has one of: its longest word by the pattern's own borders,
    with the plural endings that the pattern allows; or, for a term that may stand inside a word or has none, its first
    two characters."""
    needle = _fold(squash(term))
    longest = F.get(F.array_sort(F.transform(_words(needle), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    by_word = (mode != "substring") & longest.isNotNull()
    forms = F.when(by_word, F.array(longest, F.concat(longest, F.lit("S")), F.concat(longest, F.lit("ES")))).otherwise(F.array(F.left(needle, F.lit(2))))
    return F.struct((~by_word).alias("by_pairs"), forms.alias("anchors"))


def candidates(texts: DataFrame, entries: DataFrame, key: str, found: Column, number: int) -> DataFrame:
    """texts with each entry once that has one of its anchors (a column of arrays) among the tokens found in the text.

    A small glossary's anchors are one array that each text's tokens are met with, and its rows are broadcast: texts
    stay where they are. A larger one is joined with the tokens alone, by salted anchors, and each text gets its
    entries back in one join.
    """
    fields = [c for c in entries.columns if c != "anchors"]
    if number <= BROADCAST_TERMS:
        rows = entries.collect()
        places: dict[str, list[int]] = {}
        for n, r in enumerate(rows):
            for a in r["anchors"]:
                places.setdefault(a, []).append(n)
        if not places:
            return texts.join(entries.drop("anchors"), F.lit(False))
        named = entries.sparkSession.createDataFrame([(n, *(r[c] for c in fields)) for n, r in enumerate(rows)], T.StructType([T.StructField("_n", T.IntegerType()), *(entries.schema[c] for c in fields)]))
        of = F.create_map(*(F.lit(x) for a, numbers in places.items() for x in (a, numbers)))
        met = F.array_intersect(found, F.array(*map(F.lit, places)))
        tried = texts.select("*", F.explode(F.array_distinct(F.flatten(F.transform(met, lambda a: F.try_element_at(of, a))))).alias("_n"))
        return tried.join(F.broadcast(named), "_n").drop("_n")
    rows = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(found)).alias("_a"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_s"))
    salted = entries.select(*fields, F.explode("anchors").alias("anchor")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = rows.join(salted, (F.col("_a") == F.col("anchor")) & (F.col("_s") == F.col("_salt")))
    own = hits.groupBy("_key").agg(F.collect_set(F.struct(*fields)).alias("_e"))
    return texts.join(own, F.col(key) == F.col("_key")).select(*texts.columns, F.explode("_e").alias("_e")).select(*texts.columns, "_e.*")


def match_terms(texts: DataFrame, entries: DataFrame, key: str, text: str, number: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """key, carry, pos, source, target of each entry (pos, source, target) that occurs in each text, with its rank: longest first.

    number: the entries' count, if known. Only entries whose anchor is in a text are tried against it.
    """
    entries = entries.select("pos", "source", "target", terms.pattern(F.col("source")).alias("rx"), anchors(F.col("source"), terms.mode(F.col("source"))).alias("a")).where("rx IS NOT NULL")
    number = entries.count() if number is None else number
    by_pairs = bool(entries.where("a.by_pairs").head(1))
    entries = entries.select("pos", "source", "target", "rx", "a.anchors")
    names = [key, *(carry or [])]
    rows = texts.where(F.col(text).isNotNull()).select(*names, squash(F.col(text)).alias("_t")).withColumn("_f", _fold(F.col("_t")))
    found = _words(F.col("_f"))
    if by_pairs:
        found = F.concat(found, _pairs(F.col("_f")))
    tried = candidates(rows, entries, key, found, number)
    found = tried.where(F.regexp_like("_t", F.col("rx"))).select(*names, "pos", "source", "target")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.length("source").desc(), "pos")))


def exact_terms(texts: DataFrame, entries: DataFrame, text: str) -> DataFrame:
    """texts with exact: the term's target where the whole text without tags is a term, its outer white space kept; else null. The last entry of a term holds."""
    last = entries.where(strip(F.col("source")) != "").groupBy(F.lower(strip(F.col("source"))).alias("_k")).agg(F.max_by("target", "pos").alias("_target"))
    joined = texts.withColumn("_k", F.when(~has_tags(F.col(text)), F.lower(strip(F.col(text))))).join(last, "_k", "left")
    return joined.withColumn("exact", F.when(F.col("_target").isNotNull(), keep_outer_whitespace(F.col(text), F.col("_target")))).drop("_k", "_target")


def term_key() -> Column:
    return F.struct(normalize_code(F.col("source_lang")).alias("s"), normalize_code(F.col("target_lang")).alias("t"), F.lower(strip(F.col("source"))).alias("x"))


def merge(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Entries (pos, source_lang, target_lang, source, target, …) with imported ones in the place of those of the same direction and term.

    The last imported entry of a key holds; it takes the first place that the key has. Existing duplicates of a
    replaced key go, others stay.
    """
    fields = [c for c in existing.columns if c != "pos"]
    value = F.struct(*fields)
    new = imported.withColumn("_k", term_key()).groupBy("_k").agg(F.max_by(value, "pos").alias("v"), F.min("pos").alias("first"))
    old = existing.withColumn("_k", term_key()).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("pos")))
    both = old.select("_k", "_n", "pos", value.alias("o")).join(new, "_k", "full_outer")
    kept = both.where("v IS NULL OR _n IS NULL OR _n = 1")
    place = F.struct(F.when(F.col("_n").isNull(), 1).otherwise(0).alias("part"), F.coalesce("pos", "first").alias("at"))
    return kept.select(place.alias("place"), F.coalesce("v", "o").alias("e")).select(F.col("place.part").alias("part"), F.col("place.at").alias("at"), "e.*")


def valid_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good entries and rejected ones: known languages, terms not blank and within their length limits."""
    from glossmill.functions.languages import CODES

    known = lambda c: normalize_code(F.col(c)).isin(*CODES)
    sized = lambda c, n, least: (F.length(strip(F.col(c))) >= least) & (F.length(c) <= n)
    ok = F.coalesce((known("source_lang") | (F.col("source_lang") == "auto")) & known("target_lang") & sized("source", 200, 1) & sized("target", 200, 1) & sized("note", 300, 0), F.lit(False))
    return entries.where(ok), entries.where(~ok)
