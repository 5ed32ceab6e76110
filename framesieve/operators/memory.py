"""Memory plan of a capture session, and its admission.

A geometry is one row; its plan is an array of (name, bytes), built from BIGINT
expressions that raise on overflow.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.functions.scalar import ceil_div, long

# Object and header sizes in bytes.
PAGE, ALLOCATION_HEADER = 4096, 64
SAMPLE, RINGS = 4, 2
CHUNK_OBJECT, CHUNK_INDEX, FIXED, QUEUE_SLOT = 512, 8, 512, 64
COMMAND_RESULT, SPLIT_SLOT, WRITER_SLOT, PATH_SLOT = 512, 32, 256, 32
MANIFEST_ENTRY, MANIFEST_FIXED, MANIFEST_SLOT, OPERATION = 128, 1024, 256, 256

#: Columns of a geometry that have to be positive.
POSITIVE = ("retention", "channels", "rate", "chunk", "snapshots", "split", "control", "stack", "queue", "slot_frames", "capture_stack", "io", "path")


def budget(n: Column, page: int = PAGE) -> Column:
    """Bytes that an allocation of n bytes occupies: header added, rounded up to pages."""
    return ceil_div(n + ALLOCATION_HEADER, page) * page


def chunks(retention: Column, chunk: Column) -> Column:
    return F.greatest(long(1), ceil_div(retention, chunk))


def components(page: int = PAGE) -> dict[str, Column]:
    """The 22 parts in order, over the columns of a geometry (split: frames per part in ``per_part``)."""
    c = F.col
    n, block = chunks(c("retention"), c("chunk")), c("chunk") * c("channels") * SAMPLE
    split_parts = ceil_div(c("retention"), c("per_part")) * c("channels")
    paths = split_parts * 2 + 5
    own = lambda x: budget(x, page)
    return {
        "ring_samples": RINGS * n * block,
        "ring_sample_allocator_padding": RINGS * n * (own(block) - block),
        "ring_chunk_objects": RINGS * n * own(long(CHUNK_OBJECT)),
        "ring_chunk_index": RINGS * own(n * CHUNK_INDEX),
        "ring_fixed_metadata": RINGS * own(long(FIXED)),
        "capture_queue_samples": c("queue") * own(c("slot_frames") * c("channels") * SAMPLE),
        "capture_queue_slot_metadata": own(c("queue") * QUEUE_SLOT),
        "capture_command_result_slot": own(long(COMMAND_RESULT)),
        "capture_worker_stack": own(c("capture_stack")),
        "persistence_workspace": block + c("channels") * c("io"),
        "workspace_allocator_padding": own(block) - block + c("channels") * (own(c("io")) - c("io")),
        "split_part_slots": own(split_parts * SPLIT_SLOT),
        "file_writer_slots": own(c("channels") * WRITER_SLOT),
        "path_bytes": paths * c("path"),
        "path_allocator_padding": paths * (own(c("path")) - c("path")),
        "path_slot_metadata": own(paths * PATH_SLOT),
        "manifest_entries": own(split_parts * MANIFEST_ENTRY),
        "manifest_serialization": own(paths * (c("path") * 6 + MANIFEST_SLOT) + MANIFEST_FIXED),
        "manifest_paths": own((split_parts * 3 + 5) * c("path")),
        "operation_worker_stack": own(c("stack")),
        "operation_queue": own(c("control") * OPERATION),
        "runtime_fixed_metadata": own(long(FIXED)),
    }


def invalid(headroom: str = "headroom") -> Column:
    """Text of the first rule a geometry breaks, else null."""
    out = None
    for name in POSITIVE:
        text = F.lit(f"{name} must be > 0")
        out = F.when(F.coalesce(F.col(name), long(0)) <= 0, text) if out is None else out.when(F.coalesce(F.col(name), long(0)) <= 0, text)
    h = F.col(headroom)
    return out.when(h.isNull() | F.isnan(h) | (h == float("inf")) | (h < 1), F.lit("headroom must be finite and >= 1.0"))


def plan(geometries: DataFrame, page: int = PAGE) -> DataFrame:
    """The geometries with ``plan``, array<struct<name, bytes>>, and ``committed``, its sum."""
    parts = components(page)
    listed = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("bytes")) for k, v in parts.items()))
    return geometries.withColumn("plan", listed).withColumn("committed", F.aggregate("plan", long(0), lambda a, x: a + x["bytes"]))


def required_exact(committed: int, headroom: float) -> int:
    """Exact ceiling of committed x the binary value of headroom (driver side; DOUBLE columns can't)."""
    if not math.isfinite(headroom) or headroom < 1:
        raise ValueError("headroom must be finite and >= 1.0")
    return math.ceil(Fraction(committed) * Fraction(headroom))


def required(committed: Column, quarters: Column) -> Column:
    """Ceiling of committed x quarters / 4: headroom in steps of a quarter stays exact in BIGINT."""
    return ceil_div(committed * quarters, 4)


def admitted(required_bytes: Column, limit: Column) -> Column:
    return F.when(limit.isNull() | (required_bytes <= limit), F.lit("accepted")).otherwise(F.concat(F.lit("required "), required_bytes.cast("string"), F.lit(" bytes exceed "), limit.cast("string")))


def ring_estimate(seconds: int, rate: int, channels: int, headroom: float, sample_bytes: int = SAMPLE) -> int:
    return math.ceil(seconds * rate * channels * sample_bytes * headroom)
