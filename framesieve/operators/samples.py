"""De-interleaving, silence, quantisation and part assignment of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.functions.scalar import div, long, s24


def deinterleave(blocks: DataFrame, key: str, start: Column, channels: int, samples: str = "samples") -> DataFrame:
    """Long form (key, frame, channel, sample) of frame-major blocks."""
    rows = blocks.select(key, start.alias("_start"), F.posexplode(samples).alias("_at", "sample"))
    return rows.select(key, (F.col("_start") + div(F.col("_at").cast("bigint"), channels)).alias("frame"), F.pmod("_at", F.lit(channels)).alias("channel"), "sample")


def channel_of(samples: Column, channel: int, channels: int) -> Column:
    """One channel of an interleaved array."""
    return F.transform(F.filter(samples, lambda s, i: F.pmod(i, F.lit(channels)) == channel), lambda s: s)


def capped_copy(samples: Column, first: int, frames: int, capacity: int, channels: int) -> Column:
    """Frames [first, first + frames) of a frame-major array, as many as the capacity (in samples, whole frames) has room for."""
    if capacity % channels:
        raise ValueError("capacity must be whole frames")
    room = min(frames, capacity // channels)
    inside = F.size(samples) >= (first + frames) * channels
    return F.when(inside, F.slice(samples, first * channels + 1, room * channels)).otherwise(F.raise_error(F.lit("the range is not retained")).cast("array<float>"))


def interleave(*buffers: Column) -> Column:
    """Frame-major array of equally long channel arrays; raises if they aren't."""
    if not buffers:
        raise ValueError("at least one buffer")
    first = buffers[0]
    frames = F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.array(*(F.get(b, i) for b in buffers)))
    uneven = F.lit(False)
    for b in buffers[1:]:
        uneven = uneven | (F.size(b) != F.size(first))
    return F.when(uneven, F.raise_error(F.lit("channel buffers differ in length")).cast("array<float>")).when(F.size(first) == 0, F.array().cast("array<float>")).otherwise(F.flatten(frames))


def silent_blocks(frames: DataFrame, block: int, frame: str = "frame", sample: str = "sample") -> DataFrame:
    """(block, n, silent): whether each run of ``block`` frames is exactly zero."""
    zero = F.col(sample) == F.lit(0.0).cast("float")
    return frames.groupBy(div(F.col(frame), block).alias("block")).agg(F.count("*").alias("n"), F.bool_and(zero).alias("silent"))


def part_totals(frames: DataFrame, start: Column, per_part: int, frame: str = "frame", sample: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """Per part (and ``by``): count, sum, min and max of the quantised samples, and silence; one partial aggregate."""
    q = frames.withColumn("q", s24(F.col(sample))).withColumn("part", (div(F.col(frame) - start, per_part) + long(1)).cast("int"))
    zero = F.col(sample) == F.lit(0.0).cast("float")
    return q.groupBy(*by, "part").agg(F.count("*").alias("n_frames"), F.sum(F.col("q").cast("bigint")).alias("sum_q"), F.min("q").alias("min_q"), F.max("q").alias("max_q"), F.bool_and(zero).alias("silent"))


def channel_stats(long_form: DataFrame, channel: str = "channel", sample: str = "sample") -> DataFrame:
    q = long_form.withColumn("q", s24(F.col(sample)))
    return q.groupBy(channel).agg(F.min("q").alias("min_q"), F.max("q").alias("max_q"), F.sum(F.col("q").cast("bigint")).alias("sum_q"), F.count(F.when(F.col("q") != 0, 1)).alias("nonzero"))
