"""End-to-end flows: texts, batches of items and whole documents, from scan to written output.

All have one shape: units in, the model over distinct units that need it, outputs back to where the units stand, and
one row a text or document out. What differs is how a text is cut into units and put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions import scripts
from glossmill.functions import text as X
from glossmill.functions.chunks import join_units, split_units
from glossmill.functions.languages import normalize_code
from glossmill.operators import glossary, model
from glossmill.operators.folding import fold_sorted
from glossmill.operators.packing import pack_step

# A batch's tokens and items, tokens of an item that is translated in parts, characters of a unit, items of context.
BATCH_TOKENS, BATCH_ITEMS, LONG_TOKENS, UNIT_CHARS, CONTEXT_ITEMS = 2000, 30, 2500, 1200, 3


def prepared(texts: DataFrame, key: str, text: str, source_lang: str, target_lang: str, detector: Callable[[Column], Column] = scripts.detect) -> DataFrame:
    """texts with normal (line breaks in one form), detected, source_lang, shown_lang and identity: nothing to translate.

    Chinese found in one script that has characters of the other one is still to be converted.
    """
    rows = texts.withColumn("normal", X.normalize_line_breaks(F.coalesce(F.col(text), F.lit(""))))
    asked = F.coalesce(F.nullif(normalize_code(F.lit(source_lang)), F.lit("")), F.lit("auto"))
    chinese = ("zh-Hans", "zh-Hant")

    def pure(language: Column) -> Column:
        if source_lang != "auto" or target_lang not in chinese:
            return F.lit(True)
        other = "simplified" if target_lang == "zh-Hant" else "traditional"
        return F.when(language == target_lang, scripts.script_counts(F.col("normal"))[other] == 0).otherwise(True)

    def found(detected: Column) -> Column:
        one = scripts.resolve_source(F.lit("auto"), detected)
        return F.when(one == "auto", one).otherwise(normalize_code(one))

    def settled(detected: Column, language: Column) -> Column:
        shown = F.when(language != "auto", language).otherwise(detected["primary_language"])
        return F.struct(detected.alias("detected"), language.alias("source_lang"), shown.alias("shown_lang"), ((language == target_lang) & pure(language)).alias("identity"))

    # one bound value: as columns upon columns, a filter by identity would have the detection written out dozens of times
    if source_lang == "auto":
        about = X.let(detector(F.col("normal")), lambda d: X.let(found(d), lambda language: settled(d, language)))
    else:
        about = X.let(asked, lambda language: settled(scripts.given_language(F.col("normal"), language), language))
    rows = rows.withColumn("_about", about).select("*", "_about.*").drop("_about")
    if source_lang == "auto" and detector is scripts.detect and target_lang not in scripts.DETECTED:
        rows = rows.withColumn("identity", F.lit(False))  # known beforehand, so a filter needs no detection
    return rows


def answered(units: DataFrame, engine: model.Engine, target_lang: str, cache: DataFrame | None = None) -> DataFrame:
    """unit, output of distinct units: from the cache (source, target), or the engine's answer; an empty one is asked for once more, and is no output if it stays empty."""
    wanted = units.select("unit").distinct()
    known = None
    if cache is not None:
        known = cache.select(F.col("source").alias("unit"), F.col("target").alias("output"))
        wanted = wanted.join(known, "unit", "left_anti")
        known = known.join(units.select("unit").distinct(), "unit", "left_semi")
    once = lambda: F.nullif(X.strip(engine(F.col("unit"), target_lang)), F.lit(""))
    done = wanted.withColumn("output", F.coalesce(once(), once()))
    return done if known is None else done.unionByName(known)


def translate_texts(texts: DataFrame, key: str, text: str, engine: model.Engine, target_lang: str, source_lang: str = "auto", entries: DataFrame | None = None, max_chars: int = UNIT_CHARS, cache: DataFrame | None = None) -> DataFrame:
    """key, translation, n_units, mode, primary_language, shown_lang, hits (terms, longest first) of texts (key, text)."""
    rows = prepared(texts.select(key, text), key, text, source_lang, target_lang)
    units = rows.where("NOT identity").select(key, F.posexplode(split_units(F.col("normal"), max_chars)).alias("pos", "u")).select(key, "pos", F.col("u.text").alias("unit"), "u.paragraph", "u.newline_before")
    done = units.join(answered(units, engine, target_lang, cache), "unit", "left")
    piece = F.struct("pos", F.coalesce("output", F.lit("")).alias("text"), "paragraph", "newline_before")
    built = done.groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count("*").alias("n"))
    built = built.select(key, join_units(F.col("p"), X.unit_joiner(F.lit(target_lang))).alias("_t"), "n")
    out = rows.join(built, key, "left")
    if entries is not None:
        hits = glossary.match_terms(rows.where("NOT identity"), glossary.directed(entries, target_lang, source_lang), key, "normal")
        named = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "target"))), lambda h: F.struct(h["source"].alias("source"), h["target"].alias("target"))).alias("hits"))
        out = out.join(named, key, "left")
    else:
        out = out.withColumn("hits", F.expr("CAST(NULL AS array<struct<source:string,target:string>>)"))
    translation = F.when(F.col("identity"), F.col("normal")).otherwise(F.coalesce("_t", F.lit("")))
    return out.select(key, translation.alias("translation"), F.coalesce("n", F.lit(0)).alias("n_units"), F.col("detected.mode").alias("mode"), F.col("detected.primary_language").alias("primary_language"), "shown_lang", "hits")


def batches(items: DataFrame, group: str, pos: str, text: str) -> DataFrame:
    """items with batch: by estimated tokens and count, in order inside each group."""
    sized = items.withColumn("_tokens", X.estimate_tokens(F.col(text)))
    return fold_sorted(sized, [group], [pos], ["_tokens"], lambda: (0, 0, 0), pack_step(BATCH_TOKENS, BATCH_ITEMS), "batch", T.IntegerType()).drop("_tokens")


def batch_terms(items: DataFrame, group: str, text: str, entries: DataFrame, target_lang: str, source_lang: str = "auto") -> DataFrame:
    """group, batch, terms: the entries that occur in any item of each batch, in the glossary's order."""
    key = F.struct(group, "batch", "pos")
    found = glossary.match_terms(items.select(key.alias("k"), X.plain_text(F.col(text)).alias("t")), glossary.directed(entries, target_lang, source_lang), "k", "t")
    distinct = found.groupBy(F.col(f"k.{group}").alias(group), F.col("k.batch").alias("batch"), "pos").agg(F.first("source").alias("source"), F.first("target").alias("target"))
    return distinct.groupBy(group, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source", "target"))), lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"))).alias("terms"))


def translate_items(items: DataFrame, group: str, pos: str, text: str, engine: model.Engine, target_lang: str, entries: DataFrame | None = None) -> DataFrame:
    """group, pos, output, batch of items: exact terms from the glossary, what needs no translation as it is, long items in parts, the others through the engine; batch is null for what isn't sent."""
    rows = items.select(group, F.col(pos).alias("pos"), F.col(text).alias("text"))
    if entries is not None:
        rows = glossary.exact_terms(rows, glossary.directed(entries, target_lang), "text")
    else:
        rows = rows.withColumn("exact", F.lit(None).cast("string"))
    wanted = F.col("exact").isNull() & X.needs_translation_service(F.col("text"))
    sent = batches(rows.where(wanted), group, "pos", "text")
    long = ~X.has_tags(F.col("text")) & (X.estimate_tokens(F.col("text")) > LONG_TOKENS)
    units = sent.where(long).select("text").distinct().select("text", F.posexplode(split_units(F.col("text"), max(400, UNIT_CHARS))).alias("n", "u")).select("text", "n", F.col("u.text").alias("unit"), "u.paragraph", "u.newline_before")
    parts = units.join(answered(units, engine, target_lang), "unit", "left")
    piece = F.struct("n", F.coalesce("output", "unit").alias("text"), "paragraph", "newline_before")
    joined = parts.groupBy("text").agg(F.array_sort(F.collect_list(piece)).alias("p")).select(F.col("text").alias("unit"), X.keep_outer_whitespace(F.col("text"), join_units(F.col("p"), X.unit_joiner(F.lit(target_lang)))).alias("output"))
    short = sent.where(~long).select(F.col("text").alias("unit"))
    done = answered(short, engine, target_lang).unionByName(joined)
    back = sent.join(done, sent["text"] == done["unit"], "left").select(group, "pos", F.coalesce("output", "text").alias("output"), "batch")
    rest = rows.where(~F.coalesce(wanted, F.lit(False))).select(group, "pos", F.coalesce("exact", "text").alias("output"), F.lit(None).cast("int").alias("batch"))
    return back.unionByName(rest).withColumnRenamed("pos", pos)


def batch_context(items: DataFrame, group: str, pos: str, text: str) -> DataFrame:
    """group, batch, context: the last items of the batch before, for items (group, pos, text, batch) that are sent."""
    from glossmill.operators.packing import preceding_context

    return preceding_context(items.where("batch IS NOT NULL"), group, "batch", pos, text, keep=CONTEXT_ITEMS)


def translate_documents(docs: DataFrame, key: str, content: str, read: Callable[[Column], Column], write: Callable[[Column, Column], Column], engine: model.Engine, target_lang: str, unit: str = "text", cache: DataFrame | None = None) -> DataFrame:
    """key, content, n_units, n_translated of docs: scanned, distinct units translated, written back.

    read gives an array of units (structs with a text), write takes the content and an array of outputs in the units'
    order; an output is null where the unit stays as it is.
    """
    units = docs.select(key, F.posexplode(read(F.col(content))).alias("pos", "u")).select(key, "pos", F.col(f"u.{unit}").alias("text"))
    wanted = units.where(X.needs_translation_document(F.col("text"))).select(F.col("text").alias("unit"))
    done = units.join(answered(wanted, engine, target_lang, cache), units["text"] == F.col("unit"), "left").select(key, "pos", "output")
    listed = done.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "output"))).alias("o"), F.count("*").alias("n_units"), F.count("output").alias("n_translated"))
    both = docs.join(listed, key, "left")
    outputs = F.transform("o", lambda x: x["output"])
    written = F.when(F.col("n_translated") > 0, write(F.col(content), outputs)).otherwise(F.col(content))
    return both.select(key, written.alias(content), F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("n_translated", F.lit(0)).alias("n_translated"))
