"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is absent, a local session (as in tests) takes a temporary folder and sets it; on
    a cluster, whose machines share no such folder, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/beliefmill-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


#: Where the tables of staged() are, while they are in use.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def dropped(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; others are left alone."""
    for table in tables:
        if table is not None and (path := _PATHS.pop(table, None)):
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd number, whose powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first powers, n + 1 at least, of BASE and of its inverse, modulo 2**64; a worker keeps the longest only."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(10, int(n).bit_length())
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS


def tidy(run):
    """run(batches), which at its end gives the memory that the worker no longer uses back to the machine."""

    def work(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return work


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of bytes times powers: those of a stretch, divided by its first power, tell the stretch's content."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][:len(data)], dtype=np.uint64, out=total[1:])
    return total
