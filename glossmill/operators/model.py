"""The model stage: a text-to-text function over distinct units, joined back to where they stand.

apply_model fixes the plan's shape: filters first, then distinct units, then the function once for each, then a
left join back with the source text as the default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import text as X
from glossmill.operators.lineage import cut

#: Columns of a unit and its context to an output column.
Engine = Callable[[Column, str], Column]


def mock_engine(text: Column, target_lang: str) -> Column:
    return X.mock_translate(text, target_lang)


#: The deterministic engine's other verbs.
def mock_alternatives(span: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(X.strip(span), F.lit(" ("), i.cast("string"), F.lit(")")))


def mock_rewrite(text: Column, style: Column | str) -> Column:
    return F.concat(F.lit("["), F.lit(style) if isinstance(style, str) else style, F.lit("] "), X.strip(text))


def mock_lookup(term: Column, target_lang: str) -> Column:
    translation = F.concat(F.lit(f"[{target_lang}] "), term)
    return F.struct(
        F.array(F.struct(translation.alias("translation"), F.lit("명사").alias("pos"), F.lit("").alias("note"))).alias("entries"), F.array(F.struct(term.alias("source"), translation.alias("target"))).alias("examples")
    )


def distinct_units(rows: DataFrame, text: str, pos: str) -> DataFrame:
    """text and first: each distinct text with the first place it has."""
    return rows.groupBy(text).agg(F.min(pos).alias("first"), F.count("*").alias("uses"))


def apply_model(rows: DataFrame, text: str, engine: Engine, target_lang: str, keep: Column | None = None, cache: DataFrame | None = None) -> DataFrame:
    """rows with output. Units that need no translation, or that the cache (source, target) has, don't reach the engine."""
    wanted = rows.where(X.needs_translation_document(F.col(text)) if keep is None else keep).select(F.col(text).alias("_u")).distinct()
    known = None
    if cache is not None:
        known = cache.select(F.col("source").alias("_u"), F.col("target").alias("_o"))
        wanted = wanted.join(known, "_u", "left_anti")
    done = wanted.withColumn("_o", engine(F.col("_u"), target_lang))
    if known is not None:
        done = done.unionByName(known)
    done = done.withColumn("_o", F.when(X.strip(F.col("_o")) != "", F.col("_o")))
    return rows.join(done, rows[text] == done["_u"], "left").withColumn("output", F.coalesce("_o", text)).drop("_u", "_o")


def bilingual(rows: DataFrame, key: list[str], source: str, target: str) -> DataFrame:
    """Each row twice: the source, then the output."""
    pair = F.posexplode(F.array(F.col(source), F.col(target)))
    return rows.select(*key, pair.alias("side", "text"))


def aligned_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """items (batch, id, text) with output of results (batch, id, output) for batches whose ids are a permutation; others are marked failed."""
    got = results.groupBy("batch").agg(F.array_sort(F.collect_list("id")).alias("got"))
    want = items.groupBy("batch").agg(F.array_sort(F.collect_list("id")).alias("want"))
    ok = want.join(got, "batch", "left").select("batch", F.coalesce(F.col("want") == F.col("got"), F.lit(False)).alias("ok"))
    joined = items.join(ok, "batch").join(results.dropDuplicates(["batch", "id"]), ["batch", "id"], "left")
    return joined.select("batch", "id", "text", F.when(F.col("ok"), F.col("output")).alias("output"), (~F.col("ok")).alias("failed"))


def split_failed(failed: DataFrame) -> DataFrame:
    """Items (batch, id, text) of failed batches in halves: batch*2 and batch*2+1."""
    from pyspark.sql import Window

    w = Window.partitionBy("batch")
    half = F.when(F.row_number().over(w.orderBy("id")) <= F.floor(F.count("*").over(w) / 2), 0).otherwise(1)
    return failed.withColumn("half", half).withColumn("batch", F.col("batch") * 2 + F.col("half")).drop("half")


def retry_in_halves(items: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """items (batch from 1, id, text) through run, which gives (batch, id, output) and leaves out what it fails on; failed batches are halved down to single items, and single items that fail keep their text."""
    from pyspark.sql import Window

    done, todo = None, items
    while True:
        alone = F.count("*").over(Window.partitionBy("batch")) == 1
        result = cut(aligned_results(todo, run(todo)).withColumn("alone", alone))
        settled = result.where("alone OR NOT failed").select("id", F.when(F.col("failed"), F.col("text")).otherwise(F.col("output")).alias("output"))
        done = settled if done is None else done.unionByName(settled)
        failed = result.where("failed AND NOT alone").select("batch", "id", "text")
        if not failed.head(1):
            return done
        todo = split_failed(failed)


def better_tags(source: Column, output: Column, retry: Column) -> Column:
    """The retry only if its tags are nearer to the source's."""
    from glossmill.functions.tags import distance, signature

    broken = signature(source) != signature(output)
    return F.when(broken & (X.strip(retry) != "") & (distance(source, retry) < distance(source, output)), retry).otherwise(output)
