"""Ingest, retention, selection and replay of command logs.

A log is (session, seq, op, n_frames): pushes and the commands recall, dump and
clear.  Every operator partitions by session; the windows of one session never
leave their task, and sessions spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesieve.functions.scalar import div, enqueued, long, oldest_frame, saturating_sum


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _through(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def ingest(log: DataFrame, slots: int, slot_frames: int, session: str = "session", seq: str = "seq", n: str = "n_frames", queued: Column | int = 0) -> DataFrame:
    """Pushes with enqueued, dropped, cumulative_dropped, start_frame, end_frame (absolute, by running sum), published_sequence (slots so far).

    ``queued`` is how many slots still waited when a push came: none, if the log
    doesn't tell.
    """
    w = Window.partitionBy(session).orderBy(seq)
    taken = log.withColumn("enqueued", enqueued(F.col(n), slots, slot_frames, queued)).withColumn("dropped", F.col(n) - F.col("enqueued"))
    taken = taken.withColumn("published_sequence", F.sum(div(F.col("enqueued") + slot_frames - 1, slot_frames)).over(_through(w)))
    return taken.withColumn("end_frame", F.sum("enqueued").over(_through(w))).withColumn("start_frame", F.col("end_frame") - F.col("enqueued")).withColumn("cumulative_dropped", F.sum("dropped").over(_through(w)))


def slots_of(pushes: DataFrame, slot_frames: int) -> DataFrame:
    """One row per queue slot: slot (from 0), slot_start, slot_frames; all full but the last."""
    at = F.explode(F.sequence(long(0), F.col("enqueued") - 1, long(slot_frames)))
    rows = pushes.where("enqueued > 0").withColumn("_at", at)
    return rows.withColumn("slot", div(F.col("_at"), slot_frames)).withColumn("slot_start", F.col("start_frame") + F.col("_at")).withColumn("slot_frames", F.least(long(slot_frames), F.col("enqueued") - F.col("_at"))).drop("_at")


def chunks_of(pushes: DataFrame, chunk: int, session: str = "session") -> DataFrame:
    """(session, chunk, chunk_start, valid): frames that each chunk has of its session."""
    rows = pushes.where("enqueued > 0").withColumn("chunk", F.explode(F.sequence(div(F.col("start_frame"), chunk), div(F.col("end_frame") - 1, chunk))))
    own = F.least(F.col("end_frame"), (F.col("chunk") + 1) * chunk) - F.greatest(F.col("start_frame"), F.col("chunk") * chunk)
    return rows.groupBy(session, "chunk").agg(F.min(F.greatest(F.col("start_frame"), F.col("chunk") * chunk)).alias("chunk_start"), F.sum(own).alias("valid"))


def status(pushes: DataFrame, chunk: int, chunks: int, session: str = "session") -> DataFrame:
    """Per session: head, oldest, retained, capacity, dropped, of a ring that was never cleared."""
    head = pushes.groupBy(session).agg(F.max("end_frame").alias("head"), F.sum("dropped").alias("dropped"))
    oldest = oldest_frame(F.col("head"), chunk, chunks)
    return head.select(session, "head", oldest.alias("oldest"), (F.col("head") - oldest).alias("retained"), long(chunk * chunks).alias("capacity"), "dropped")


def last_frames(frames: DataFrame, n: int, chunk: int, chunks: int, frame: str = "frame") -> DataFrame:
    """The trailing n frames, or what is retained of them: a filter, whose bound is a scalar subquery."""
    return frames.where(F.col(frame) >= last_start(frames, n, chunk, chunks, frame))


def last_start(frames: DataFrame, n: int, chunk: int, chunks: int, frame: str = "frame") -> Column:
    """First of the trailing n frames, as a scalar; used twice, it is computed once."""
    head = frames.agg((F.max(frame) + 1).alias("head"))
    return head.select(F.greatest(F.col("head") - n, oldest_frame(F.col("head"), chunk, chunks))).scalar()


def exact_range(frames: DataFrame, start: int, end: int, oldest: int, head: int, frame: str = "frame") -> DataFrame:
    """Frames of [start, end), which has to lie in [oldest, head); an empty range is fine."""
    if start > end:
        raise ValueError(f"range {start}..{end} is reversed")
    if start < oldest or end > head:
        raise ValueError(f"range {start}..{end} is not retained ({oldest}..{head})")
    return frames.where((F.col(frame) >= start) & (F.col(frame) < end))


def segments(chunks: DataFrame, start: int, end: int, chunk: str = "chunk_start", valid: str = "valid") -> DataFrame:
    """Overlap of each chunk with [start, end): segment_start, segment_frames."""
    lo, hi = F.greatest(F.col(chunk), long(start)), F.least(F.col(chunk) + F.col(valid), long(end))
    return chunks.where((F.col(chunk) < end) & (F.col(chunk) + F.col(valid) > start)).withColumn("segment_start", lo).withColumn("segment_frames", hi - lo)


def _reach(ends: DataFrame, width: int, depth: int) -> DataFrame:
    """(b, r): for each bucket how far the earlier ones reach; buckets of buckets, so that no task sees more than ``width`` of them."""
    if not depth:
        return ends.select("b", F.max("hi").over(_before(Window.orderBy("b"))).alias("r"))
    placed = ends.select("b", "hi", div(F.col("b"), width).alias("u"))
    above = _reach(placed.groupBy(F.col("u").alias("b")).agg(F.max("hi").alias("hi")), width, depth - 1).select(F.col("b").alias("u"), F.col("r").alias("far"))
    near = placed.withColumn("near", F.max("hi").over(_before(Window.partitionBy("u").orderBy("b"))))
    return near.join(above, "u").select("b", F.greatest("near", "far").alias("r"))


def gaps(rows: DataFrame, start: int | Column, end: int | Column, first: str, count: str, width: int = 4096, depth: int = 3) -> DataFrame:
    """(gap_start, gap_end): what segments leave uncovered of [start, end); the bounds may be scalars.

    A bucket of ``width`` frames knows its own gaps; how far earlier buckets reach goes
    by levels of buckets, so that the last, global level sees one row for
    ``width`` ** (``depth`` + 1) frames.
    """
    start, end = long(start), long(end)
    s = rows.select(F.col(first).alias("s"), (F.col(first) + F.col(count)).alias("e")).where((F.col("e") > start) & (F.col("s") < end))
    s = s.withColumn("b", div(F.col("s"), width))
    w = Window.partitionBy("b").orderBy("s", "e")
    inner = s.withColumn("r", F.max("e").over(_before(w))).where("r < s").select("b", F.col("r").alias("gap_start"), F.col("s").alias("gap_end"))
    ends = s.groupBy("b").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    far = _reach(ends, width, depth)
    outer = ends.join(far, "b").withColumn("r", F.coalesce("r", start)).where("r < lo").select(F.col("r").alias("gap_start"), F.col("lo").alias("gap_end"))
    # A segment of an earlier bucket may reach into an inner gap.
    inner = inner.join(far, "b").withColumn("gap_start", F.greatest("gap_start", F.coalesce("r", F.col("gap_start")))).where("gap_start < gap_end").select("gap_start", "gap_end")
    tail = ends.agg(F.coalesce(F.max("hi"), start).alias("gap_start")).withColumn("gap_end", end).where("gap_start < gap_end")
    return inner.unionByName(outer).unionByName(tail)


def since_cursor(heads: DataFrame, chunk: int, chunks: int) -> DataFrame:
    """Selection since a cursor: requested, start_frame, end_frame, lost (needs head and cursor)."""
    oldest = oldest_frame(F.col("head"), chunk, chunks)
    requested = F.coalesce(F.col("cursor"), oldest)
    start = F.greatest(requested, oldest)
    return heads.withColumn("oldest", oldest).withColumn("requested", requested).withColumn("start_frame", start).withColumn("end_frame", F.col("head")).withColumn("lost", start - requested)


def once(reports: DataFrame, *key: str) -> DataFrame:
    """Results that were handed out again after a timeout, once each: the key is the operation's identity."""
    return reports.dropDuplicates(list(key))


def replay(log: DataFrame, chunk: int, chunks: int, slots: int, slot_frames: int, session: str = "session", seq: str = "seq") -> DataFrame:
    """Outcomes of the commands of failure-free logs, by windows alone.

    ``log`` has session, seq, op (push, recall, dump, clear), n_frames and sound
    (a push of non-zero samples).  Per command: kind (written, skipped_silent,
    no_new_audio, cleared), start_frame, end_frame, frames, the three causes of
    loss, and their sum.  A clear's losses are reported by the next persist; it has
    them itself as ``own_retention`` and ``own_cleared``.
    """
    w = Window.partitionBy(session).orderBy(seq)
    push = F.col("op") == "push"
    took = F.when(push, enqueued(F.col("n_frames"), slots, slot_frames)).otherwise(long(0))
    rows = log.withColumn("took", took).withColumn("lost_now", F.when(push, F.col("n_frames")).otherwise(long(0)) - F.col("took"))
    rows = rows.withColumn("H", F.sum("took").over(_through(w))).withColumn("D", F.sum("lost_now").over(_through(w)))
    rows = rows.withColumn("heard", F.coalesce(F.max(F.when(push & F.col("sound") & (F.col("took") > 0), F.col("H"))).over(_through(w)), long(0)))
    cmds = rows.where(~push)
    clear = F.col("op") == "clear"
    zero = lambda x: F.coalesce(x, long(0))
    cmds = cmds.withColumns({
        "K": zero(F.lag("H").over(w)),
        "B": zero(F.max(F.when(~clear, F.col("H"))).over(_before(w))),
        "CL": zero(F.max(F.when(clear, F.col("H"))).over(_before(w))),
        "acked": zero(F.max(F.when(~clear, F.col("D"))).over(_before(w))),
        "turn": F.count(F.when(~clear, 1)).over(_before(w)),
    })
    cmds = cmds.withColumn("old", oldest_frame(F.col("H"), chunk, chunks, F.col("B"), F.col("CL")))
    cmds = cmds.withColumns({
        "own_retention": F.when(clear, F.greatest(long(0), F.col("old") - F.col("K"))).otherwise(long(0)),
        "own_cleared": F.when(clear, F.greatest(long(0), F.col("H") - F.greatest("K", "old"))).otherwise(long(0)),
    })
    pending = _before(Window.partitionBy(session, "turn").orderBy(seq))
    start = F.greatest("K", "old")
    some = (start < F.col("H")) & ~clear
    cmds = cmds.withColumns({
        "start_frame": F.when(some, start), "end_frame": F.when(some, F.col("H")), "frames": F.when(some, F.col("H") - start).otherwise(long(0)),
        "kind": F.when(clear, F.lit("cleared")).when(~some, F.lit("no_new_audio")).when(F.col("heard") <= start, F.lit("skipped_silent")).otherwise(F.lit("written")),
        "retention_lost": F.when(clear, long(0)).otherwise(F.when(some, start - F.col("K")).otherwise(long(0)) + zero(F.sum("own_retention").over(pending))),
        "cleared_lost": F.when(clear, long(0)).otherwise(zero(F.sum("own_cleared").over(pending))),
        "dropped_lost": F.when(clear, long(0)).otherwise(F.col("D") - F.col("acked")),
    })
    return cmds.withColumn("lost", saturating_sum(F.col("retention_lost"), F.col("cleared_lost"), F.col("dropped_lost"))).select(
        session, seq, "op", "kind", "start_frame", "end_frame", "frames", "retention_lost", "cleared_lost", "dropped_lost", "lost", "own_retention", "own_cleared", F.col("H").alias("head"),
    )


def conservation(log: DataFrame, outcomes: DataFrame, slots: int, slot_frames: int, session: str = "session", seq: str = "seq") -> DataFrame:
    """Per session: pushed frames against what became of them; ``balance`` is 0."""
    took = enqueued(F.col("n_frames"), slots, slot_frames)
    pushed = log.where("op = 'push'").groupBy(session).agg(F.sum("n_frames").alias("pushed"), F.sum(took).alias("enqueued"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("frames")).otherwise(long(0)))
    direct = F.when(F.col("op") != "clear", F.when(F.col("start_frame").isNotNull(), F.col("retention_direct")).otherwise(long(0))).otherwise(F.col("own_retention"))
    w = Window.partitionBy(session).orderBy(seq)
    rows = outcomes.withColumn("retention_direct", F.col("start_frame") - F.coalesce(F.lag("head").over(w), long(0)))
    # An empty persist has no range; what its cursor passed over was counted before.
    ends = rows.groupBy(session).agg(of("written").alias("written"), of("skipped_silent").alias("silent"), F.sum("own_cleared").alias("cleared"), F.sum(direct).alias("retention"), F.max("head").alias("cursor"))
    zero = lambda c: F.coalesce(c, long(0))
    both = pushed.join(ends, session, "left").select(session, "pushed", (F.col("pushed") - F.col("enqueued")).alias("dropped"), *(zero(F.col(c)).alias(c) for c in ("written", "silent", "cleared", "retention")), (F.col("enqueued") - zero(F.col("cursor"))).alias("uncommitted"))
    parts: Column = F.col("pushed")
    for c in ("dropped", "written", "silent", "cleared", "retention", "uncommitted"):
        parts = parts - F.col(c)
    return both.withColumn("balance", parts)
