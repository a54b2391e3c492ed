"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the whitespace-delimited contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: Paths of intermediate tables that still stand.
_written: set[str] = set()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Where both are unset, a temporary folder serves a local master, whose executors run in the driver; any other raises.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or getattr(context, "_weftline_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._weftline_dir = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return found


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside only."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. Its shuffle files go at once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _set(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    _written.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.discard(path)


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        _delete(df.sparkSession, path)


def standing() -> frozenset[str]:
    """Paths of the intermediate tables of this process that still stand."""
    return frozenset(_written)


def sweep(spark: SparkSession, *keep: DataFrame, since: frozenset[str] = frozenset()) -> None:
    """Delete the intermediate tables of this process but ``keep``, what these read, and those ``since`` names: for when the results that read them are written."""
    read = [f for df in keep for f in df.inputFiles()]
    for path in _written - since:
        folder = f"/{path.rpartition('/')[2]}/"
        if not any(folder in f for f in read):
            _delete(spark, path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside hand Python at most ``rows`` rows at a time, so that neither side holds more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with _set(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield


def among(rows: DataFrame, ids: DataFrame, column: str = "rid") -> DataFrame:
    """Those of the rows whose ``column`` is in that of ``ids``. Rows stay where they are: the ids are sent to all, as bits of 64-bit words.

    For dense numbers, as ``monotonically_increasing_id`` gives: a word takes about 70 bytes, so that is a byte or so for each row there is.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).bitwiseAND(63).cast("int"))
    words = ids.groupBy(F.shiftright(column, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.withColumn("_word", F.shiftright(column, 6)).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).select(*(f"`{c}`" for c in rows.columns))


def trim() -> None:
    """Give the memory this Python worker has freed back to the system; allocators keep it otherwise while the worker idles."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def width(spark: SparkSession, least: int = 2) -> int:
    """Number of shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefixes of an array under an associative ``combine``, by doubling: n log n steps, and no array grows."""
    powers = F.array(*(F.lit(1 << k) for k in range(31)))
    step = lambda s, p: F.transform(s, lambda x, i: F.when(i >= p, combine(F.get(s, i - p), x)).otherwise(x))
    return let(values, lambda v: F.aggregate(F.filter(powers, lambda p: p < F.size(v)), v, step))
