"""Load figures of a model server: exposition lines, and flags from polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The gauges that are read.
GAUGES = {"vllm:num_requests_running": "running", "vllm:num_requests_waiting": "waiting", "vllm:kv_cache_usage_perc": "kv_cache"}


def parsed(lines: DataFrame, line: str) -> DataFrame:
    """metric, value of each line that holds a gauge."""
    names = F.create_map(*(F.lit(x) for pair in GAUGES.items() for x in pair))
    text = F.trim(line)
    metric = F.try_element_at(names, F.regexp_extract(text, r"^([^{\s]+)", 1))
    value = F.regexp_extract(text, r"\s(\S+)$", 1).try_cast("double")
    return lines.select(metric.alias("metric"), value.alias("value")).where("metric IS NOT NULL AND value IS NOT NULL")


def rollup(lines: DataFrame, line: str) -> DataFrame:
    """metric, value: sums over labels, the largest for the cache."""
    value = F.when(F.col("metric") == "kv_cache", F.max("value")).otherwise(F.sum("value"))
    return parsed(lines, line).groupBy("metric").agg(value.alias("value"))


def congested(polls: DataFrame, key: str, ts: str, waiting: Column) -> DataFrame:
    """key, congested by the last poll."""
    last = polls.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))).where("_r = 1")
    return last.select(key, (waiting > 0).alias("congested"))
