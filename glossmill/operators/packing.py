"""Packing ordered items into batches, and chunks into lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.text import squash
from glossmill.operators.folding import fold_sorted


def pack_step(limit: int, items: int = 30):
    """Fold step: a batch closes when the next item would pass the limit or the item count. State: size, count, number."""

    def step(state: tuple[int, int, int], size: int) -> tuple[tuple[int, int, int], int]:
        n, k, batch = state
        if k and (n + size > limit or k >= items):
            n, k, batch = 0, 0, batch + 1
        return (n + size, k + 1, batch), batch

    return step


def pack_batches(rows: DataFrame, group: str, pos: str, size: Column, limit: int, items: int = 30) -> DataFrame:
    """group, pos, size, batch for each row; order by pos inside each group. A group streams through one task, three numbers of state."""
    sized = rows.select(group, pos, F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    return fold_sorted(sized, [group], [pos], ["size"], lambda: (0, 0, 0), pack_step(limit, items), "batch", T.IntegerType())


def lanes(chunks: DataFrame, group: str, chunk: str, size: str, n: int) -> DataFrame:
    """chunks with lane: contiguous runs of similar size, by the share of what goes before."""
    w = Window.partitionBy(group)
    order = w.orderBy(chunk)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.least(F.lit(n), F.count("*").over(w))
    total = F.greatest(F.sum(size).over(w), F.lit(1))
    return chunks.withColumn("lane", F.least(most - 1, F.floor(before * most / total)).cast("int"))


def preceding_context(rows: DataFrame, group: str, chunk: str, pos: str, source: str, target: str | None = None, keep: int = 3, clip: int = 400) -> DataFrame:
    """group, chunk, context: the last rows of the chunk before, as lines, squashed and clipped."""
    tail = rows.withColumn("r", F.row_number().over(Window.partitionBy(group, chunk).orderBy(F.desc(pos)))).where(F.col("r") <= keep)
    text = F.left(squash(F.col(source)), F.lit(clip))
    line = F.concat(F.lit("- "), text)
    if target:
        t = F.left(squash(F.coalesce(F.col(target), F.lit(""))), F.lit(clip))
        line = F.concat(line, F.when(t != "", F.concat(F.lit("  ⇒  "), t)).otherwise(""))
    lines = tail.groupBy(group, chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))
    return lines.select(group, (F.col(chunk) + 1).alias(chunk), "context")
