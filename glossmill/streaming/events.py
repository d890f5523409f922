"""Streams: server-sent chunks, unit events, progress and load as Structured Streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.operators.lineage import shared_folder

CHUNK = T.StructType(
    [T.StructField("choices", T.ArrayType(T.StructType([T.StructField("delta", T.StructType([T.StructField("content", T.StringType())])), T.StructField("finish_reason", T.StringType())])))]
)


def sse_deltas(lines: DataFrame, line: str) -> DataFrame:
    """lines with delta and finish of each `data:` line; [DONE] and others go."""
    data = F.trim(F.regexp_extract(line, r"^data:\s*(.*)$", 1))
    rows = lines.withColumn("_d", data).where("_d <> '' AND _d <> '[DONE]'").withColumn("_c", F.from_json("_d", CHUNK))
    first = F.get("_c.choices", F.lit(0))
    return rows.select(*lines.columns, first["delta"]["content"].alias("delta"), first["finish_reason"].alias("finish"))


def final_units(events: DataFrame) -> DataFrame:
    """req, index, text of events (req, seq, type, index, text): a unit event in the place of its deltas, else these joined."""
    own = events.where("type IN ('delta', 'unit')")
    delta = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "text")))), lambda x: x["text"]), "")
    unit = F.max_by(F.when(F.col("type") == "unit", F.col("text")), F.when(F.col("type") == "unit", F.col("seq")))
    return own.groupBy("req", "index").agg(F.coalesce(unit, delta).alias("text"))


def request_state(events: DataFrame) -> DataFrame:
    """req, state: done or error if such an event came, else running."""
    has = lambda t: F.max(F.col("type") == t)
    return events.groupBy("req").agg(F.when(has("error"), "error").when(has("done"), "done").otherwise("running").alias("state"))


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """All that a bounded stream gives. In complete mode each batch is the whole result: the last one is read back from
    the shared folder; else all batches are. Nothing is held by the driver."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    written: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        written.append(f"{folder}/batch-{number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(*(written[-1:] if mode == "complete" else written))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """event_type, hour, n, total in tumbling windows of event time."""
    grouped = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 hour"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("window.start").alias("hour"), "n", "total")


def hourly_totals(spark: SparkSession, path: str) -> DataFrame:
    """hourly() over a Parquet table read as a stream, to its end."""
    folder, _, file = path.rpartition("/")
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", file).parquet(folder)
    hours = _finished(hourly(source.withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    return hours.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def progress(samples: DataFrame, job: str, done: Column, total: Column) -> DataFrame:
    """job, percent so far, of a stream: the largest share seen, 99 at most."""
    return samples.groupBy(job).agg(F.max(F.round(F.least(100.0 * done / total, F.lit(99.0)), 1)).alias("percent"))


def write_ndjson(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends the rows as JSON lines."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
