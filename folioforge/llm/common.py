"""What several operators share: tables, scratch tables in the shared folder, bounded batches and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have: 2 million pairs of longs are some 60 MB as a hash relation.
BROADCAST_ROWS = 2_000_000
#: What an Arrow batch holds at most, so that neither the JVM nor a Python worker holds many texts at a time.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

_made: list[list[str]] = []
_kept: dict[str, Any] = {}
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends BATCH at most to Python at a time from now on.

    The limits are read when a query runs, so they are set for the session and stay set; smaller ones that it has stay, too.
    """
    for key, most in BATCH.items():
        now = re.match(r"\d+", df.sparkSession.conf.get(key))
        if not now or not 0 < int(now[0]) <= int(most):
            df.sparkSession.conf.set(key, most)
    return df


def _give_back() -> None:
    """What this Python worker has freed, Arrow's and the C library's memory, goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """``df.mapInArrow`` in small batches; at the end of a task its Python worker, which later tasks use, gives memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return small_batches(df).mapInArrow(run, schema)


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps for the tasks of one operator.

    Workers are used again by later stages: what another operator kept goes, and so does Arrow's unused memory.
    """
    if name not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[name] = make()
    return _kept[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see.  Where the session names none, a local master gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        named = tempfile.mkdtemp(prefix="folioforge-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends or the ``scratch`` around it is left."""
    path = f"{shared_dir(spark)}/folioforge/{label}-{uuid.uuid4().hex}"
    where, files = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables made inside are removed at the end, but for those taken out of the list."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        for path in _made.pop():
            where, files = _hadoop_path(spark, path)
            files.delete(where, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and an executor loss costs nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (a stored table, so counting is cheap) with a broadcast hint if its row count is within the bound."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
