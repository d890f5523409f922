"""What all operators of this subpackage share: session set-up, Arrow stages over whole texts, folds."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step holds; a longer document is a step of its own.
SLICE_BYTES = 1 << 19
#: Documents in one vectorised step.
SLICE_ROWS = 512
#: Bytes of an Arrow batch, but for a single row that is longer.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Makes the package importable on executors and bounds the Arrow batches that reach Python."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(root)
        target = os.path.join(tempfile.mkdtemp(prefix="glossmill-"), f"{name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, root)))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session, as in tests, gets one of its own where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="glossmill-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, written: list[str] | None = None) -> DataFrame:
    """df as a compressed table in the shared folder; its path is added to written, for drop() once nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if written is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, written: list[str]) -> None:
    """Deletes tables that stored() wrote."""
    for path in written:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    written.clear()


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more; else they stay until the
    driver happens to collect its garbage, and an iteration's leftovers pile up on the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(col: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary")) % m


def pieces(texts: list[bytes], max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes and rows; at least one text each."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > max_bytes or i - at >= max_rows):
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


#: What a worker process keeps from one task to the next.
_held: dict[str, Any] = {}


def held(key: str, build: Callable[[], Any]) -> Any:
    """What build makes, once in a worker process, until a task of another kind comes."""
    if key not in _held:
        _held[key] = build()
    return _held[key]


def release(all_of_it: bool = True) -> None:
    """Gives free memory back to the system, and what is held before that. Workers wait for the next task beside others and beside the JVM, so what they don't need counts."""
    if all_of_it:
        _held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def append_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
    max_rows: int = SLICE_ROWS,
    max_bytes: int = SLICE_BYTES,
    without: str | None = None,
    holds: bool = False,
) -> DataFrame:
    """df with columns computed from its text column, in one pass without a shuffle.

    make() runs once per task and returns the function of a list of texts; it gives one array per field. Columns of
    df with the name of a field (whatever their case) are replaced; the column without is left out. holds: make uses
    held().
    """
    names = [f.name for f in fields]
    taken = {n.lower() for n in names} | ({without.lower()} if without else set())
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    df = df.select(*(quoted(f.name).alias(f"c{i}") for i, f in enumerate(kept)), quoted(text).alias("text"))
    schema = T.StructType(kept + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        if not holds:
            release()
        for batch in batches:
            if not batch.num_rows:
                continue
            step = step or make()
            *own, column = batch.columns
            texts = text_bytes(column)
            for a, b in pieces(texts, max_bytes, max_rows):
                out = step(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in own), *out], [*(f.name for f in kept), *names])
        if step:
            texts = out = own = column = batch = step = None
            release(not holds)

    return df.mapInArrow(run, schema)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
