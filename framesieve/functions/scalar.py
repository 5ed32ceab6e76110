"""Scalar rules as Column expressions: integer geometry, quantisation, names and texts.

Everything stays inside whole-stage code generation; integers are BIGINT and
ANSI overflow raises, which is the checked arithmetic the rules ask for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 9223372036854775807
# The signed 24-bit range and the WAV header's size.
S24_MAX, S24_MIN_SIZE, HEADER = 8388607, 8388608, 44


def long(x) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else x


def div(a, b) -> Column:
    """Integer division of BIGINTs (never by way of DOUBLE)."""
    return F.call_function("div", long(a), long(b))


def ceil_div(a, b) -> Column:
    return div(long(a) + long(b) - 1, b)


def chunk_frames(rate, requested=None) -> Column:
    """A quarter of a second of frames, one at least, unless a positive number is asked for."""
    quarter = F.greatest(div(long(rate) * 250, 1000), long(1))
    return quarter if requested is None else F.when(F.coalesce(requested, F.lit(0)) > 0, requested.cast("bigint")).otherwise(quarter)


def descriptor_count(seconds, rate, chunk) -> Column:
    return ceil_div(long(seconds) * long(rate), chunk)


def oldest_frame(head, chunk, chunks, base=0, cleared=0) -> Column:
    """First readable frame of a ring of ``chunks`` chunks that began at ``base``: retention is by whole chunks."""
    head, chunk, chunks, base = long(head), long(chunk), long(chunks), long(base)
    own = head - base
    kept = F.when(own > 0, F.greatest(long(0), (div(own - 1, chunk) - chunks + 1) * chunk)).otherwise(long(0))
    return F.greatest(base + kept, long(cleared))


def enqueued(n, slots, slot_frames, queued=0) -> Column:
    """Frames of a push that fit in the queue; the whole remainder is dropped."""
    return F.least(long(n), F.greatest(long(slots) - long(queued), long(0)) * long(slot_frames))


def accepted_before_pin(n, head, pinned_chunk, chunk, chunks) -> Column:
    """Frames of a push until it would overwrite the oldest pinned chunk (null: none); the rest of the push is dropped."""
    room = (long(pinned_chunk) + long(chunks)) * long(chunk) - long(head)
    return F.least(long(n), F.greatest(long(0), F.coalesce(room, long(n))))


def seconds(frames: Column, rate) -> Column:
    return frames / F.lit(rate) if not isinstance(rate, Column) else frames / rate


def saturating_sum(*xs: Column) -> Column:
    """Sum that stays at the largest BIGINT instead of overflowing."""
    total = xs[0]
    for x in xs[1:]:
        total = F.coalesce(F.try_add(total, x), long(LONG_MAX))
    return total


def silent(samples: Column) -> Column:
    """All samples exactly zero; -0.0 is, NaN and denormals aren't."""
    return ~F.exists(samples, lambda s: s != F.lit(0.0).cast("float"))


def s24(x: Column) -> Column:
    """FLOAT sample to a signed 24-bit integer: clamp, scale in FLOAT, round half away from zero; NaN is 0."""
    one = lambda v: F.lit(float(v)).cast("float")
    up = F.round(F.least(x, one(1)) * one(S24_MAX))
    down = F.round(F.greatest(x, one(-1)) * one(S24_MIN_SIZE))
    return F.when(x.isNull(), F.lit(None).cast("int")).when(F.isnan(x), F.lit(0)).when(x >= one(0), up.cast("int")).otherwise(down.cast("int"))


def s24_hex(q: Column) -> Column:
    """Three little-endian bytes as hex."""
    byte = lambda k: F.lpad(F.hex(F.shiftright(q, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return F.concat(byte(0), byte(1), byte(2))


def frames_per_part(split, bytes_per_frame) -> Column:
    """Frames that fit a file of ``split`` bytes; raises where there is no room."""
    split, size = long(split), long(bytes_per_frame)
    n = div(split - HEADER, size)
    return (
        F.when(size <= 0, F.raise_error(F.lit("bytes per frame must be > 0")))
        .when(split <= HEADER, F.raise_error(F.lit("split threshold must leave room for WAV data")))
        .when(n <= 0, F.raise_error(F.lit("split threshold is too small for one frame")))
        .otherwise(n)
        .cast("bigint")
    )


def part_count(total, per_part) -> Column:
    return ceil_div(total, per_part)


def parts(total: Column, per_part: Column) -> Column:
    """array<struct<part, start_frame, frame_count>>, the last short; none for no frames."""
    n = part_count(total, per_part)
    one = lambda i: F.struct((i + 1).cast("int").alias("part"), (i * per_part).alias("start_frame"), F.least(per_part, total - i * per_part).alias("frame_count"))
    return F.when(n > 0, F.transform(F.sequence(long(0), n - 1), one)).otherwise(F.array().cast("array<struct<part:int,start_frame:bigint,frame_count:bigint>>"))


def header_hex(frames: Column, rate: Column) -> Column:
    """The 44-byte header of a mono 24-bit PCM file, as hex."""

    def little(x, width):
        return F.concat(*(F.lpad(F.hex(F.shiftright(x.cast("bigint"), 8 * k).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0") for k in range(width)))

    data = frames * 3
    text = lambda s: F.lit(s.encode().hex().upper())
    fields = [text("RIFF"), little(data + 36, 4), text("WAVE"), text("fmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(1), 2), little(rate, 4), little(rate * 3, 4), little(F.lit(3), 2), little(F.lit(24), 2), text("data"), little(data, 4)]
    return F.concat(*fields)


def channel_name(name: Column, channel: Column) -> Column:
    """The given name, or ch01, ch02, ..."""
    return F.coalesce(name, F.format_string("ch%02d", channel + 1))


def simple_name(name: Column, part: Column, n_parts: Column) -> Column:
    return F.when(n_parts > 1, F.format_string("%s-part%03d.wav", name, part)).otherwise(F.concat(name, F.lit(".wav")))


def detailed_name(prefix: str, label: Column, name: Column, rate, start: Column, end: Column, part: Column) -> Column:
    """Frame numbers are relative to the selection."""
    return F.format_string(f"{prefix}-%s-%s-%dHz-%09d-%09d-part%03d.wav", label, name, F.lit(rate), start, end, part)


def safe_name(name: Column) -> Column:
    """Exactly one ordinary path component without NUL."""
    return (name != "") & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\0")


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def loss_text(retention: Column, cleared: Column, dropped: Column) -> Column:
    cause = lambda label, n: F.when(n > 0, F.concat(F.lit(f"{label} "), n.cast("string")))
    return F.concat_ws(", ", cause("retention", retention), cause("cleared", cleared), cause("capture-dropped", dropped))


def outcome_message(kind: Column, frames: Column, lost: Column) -> Column:
    text = F.when(kind == "written", F.concat(F.lit("written: "), frames.cast("string"), F.lit(" frames"))).when(kind == "skipped_silent", F.concat(F.lit("skipped exact-zero audio: "), frames.cast("string"), F.lit(" frames"))).otherwise(F.lit("no new audio"))
    return F.when(lost > 0, F.concat(text, F.lit("; warning: "), lost.cast("string"), F.lit(" frames lost before persistence"))).otherwise(text)


def expand_runtime(text: Column, runtime_dir: Column) -> Column:
    """%t is the runtime folder; an error where it isn't set."""
    missing = F.raise_error(F.lit("XDG_RUNTIME_DIR is not set")).cast("string")
    return F.when(~text.contains("%t"), text).when(runtime_dir.isNull(), missing).otherwise(F.replace(text, F.lit("%t"), runtime_dir))


def first_failure(rules: list[tuple[Column, Column]]) -> Column:
    """Text of the first rule whose condition holds, else null; rules are (fails when, text)."""
    out = None
    for fails, text in rules:
        fails = F.coalesce(fails, F.lit(False))
        out = F.when(fails, text) if out is None else out.when(fails, text)
    return out
