"""Corpus pipeline: reject poor and toxic documents, remove near-duplicates, mix sources, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() hands each stage's rows to the next through a Parquet table beside the checkpoints.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm import bpe_automaton, mixing, neardup, quality, queries, runtime, toxicity

SCORE, RANK = "__stage_score", "__stage_rank"


def _accepted(docs: DataFrame, sf_dir: str, method, label: str, keep) -> DataFrame:
    """docs without those that a classifier rejects; it learns from the labels of documents outside the held-out fold."""
    labels = runtime.read(docs.sparkSession, sf_dir, "labels").select("doc_id", label)
    model = method.learn(docs.select("doc_id", "text"), labels, runtime.crc_mod("doc_id", queries.LABEL_FOLDS) != 0, label)
    return method.predict(docs, model, name=SCORE).where(keep(F.col(SCORE))).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _accepted(docs, sf_dir, quality, "quality", lambda s: s >= queries.QUALITY_FROM)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _accepted(docs, sf_dir, toxicity, "toxic", lambda s: s < queries.TOXIC_FROM)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id, stays; of several rows of that id the one with the first text. Rows with a null id stay."""
    gone = neardup.near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
    docs = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    often = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not often.head(1):
        return docs
    order = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
    first = docs.join(often, "doc_id", "left_semi").withColumn(RANK, F.row_number().over(order)).where(F.col(RANK) == 1)
    return docs.join(often, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, digests and the ids themselves of each row."""
    return bpe_automaton.encode_and_digest(docs.select("doc_id", "source", "text"), queries.vocabulary_path(), ids="ids")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("neardup", neardup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The classifiers, the random mix and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's table is deleted once the next one is written; the last one stays."""
    folder = f"{runtime.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        runtime.sweep(spark)
        before = name
    return docs
