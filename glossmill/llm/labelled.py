"""Labelled rows for the classifiers: a bounded sample of each class, the share of label 1, and fitting off the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm import runtime

#: Rows of each class that a classifier is fitted on, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 3000, 48 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: Column, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, float]:
    """text and y (0 or 1) of at most so many rows of each class, chosen by a hash of the id; and the share of 1.

    docs: doc_id, text. labels: doc_id and the label; of several labels of an id the largest holds, of several texts
    the first in byte order. folds: a Column over doc_id, true for ids that may be learned from. Whole texts are
    taken in the order of the hash while their bytes stay within the bound. The sample's ids are few, so they are
    broadcast.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(folds, F.lit(False))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    ids = ids.where("y IN (0, 1)").join(sizes, "doc_id")
    count = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    one, all_ = count.get(1, 0), max(1, sum(count.values()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ids.where("y = 1").orderBy(*order).limit(most).unionByName(ids.where("y = 0").orderBy(*order).limit(most))
    so_far = F.sum("size").over(Window.partitionBy("y").orderBy(*order))  # over the few rows that are left
    chosen = chosen.withColumn("bytes", so_far).where(F.col("bytes") <= most_bytes).select(F.col("doc_id").alias("_id"), "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"), one / all_


def fit_apart(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What fit makes of all rows, in one task; None without rows. rows are a bounded sample, and only the model, of a bounded size too, comes to the driver."""

    def run(table: pa.Table) -> pa.Table:
        runtime.release()
        model = pickle.dumps(fit(table.drop_columns("_one")))
        runtime.release()
        return pa.table({"model": pa.array([model], pa.binary())})

    got = rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(run, "model binary").first()
    return got and pickle.loads(got["model"])
