"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame, SparkSession

from framesieve.shipping import ship

__all__ = ["checkpointed", "planned_bytes", "ship", "shuffle_partitions", "small_batches", "table", "text_slices", "trimmed"]

#: Bytes of text that a Python worker takes at a time, one document at least.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder of ``spark.checkpoint.dir``.

    Only where the session names none, and executors share the driver's disk (as in
    tests), a folder of our own is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="framesieve-checkpoint-"))
    return df.checkpoint(eager=True)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the table's size, from file sizes; no job runs.  0: unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(sizes, limit: int):
    """Yield (start, stop) row ranges of at most ``limit`` units each, one row at least."""
    sizes = list(sizes)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def small_batches(batches, column: int):
    """The batches cut so that the texts of ``column`` have ``BATCH`` bytes at most, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for a, b in text_slices([n + 1 for n in sizes], BATCH):
            yield batch.slice(a, b - a)
        if not sizes:
            yield batch


def trimmed(run):
    """A function over batches that gives its memory back to the system when its task ends: workers are kept for later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc's own
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
