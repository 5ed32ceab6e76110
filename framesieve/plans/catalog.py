"""Every query of the library proper, with the DuckDB SQL of the same result.

Tables become frame streams and command logs: an event is a push (view, click),
a dump (purchase), a recall (signup) or a clear (error) of its user's session; a
vector is a frame of 64 channels, or a block of 32 stereo frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.functions import scalar as S
from framesieve.operators import memory, samples, settings, streams
from framesieve.sources import publish, scans
from framesieve.streaming import replay as stateful

# Geometry of the replayed rings, small enough to wrap.
CHUNK, CHUNKS, SLOTS, SLOT_FRAMES = 8, 4, 5, 8
RATE = 48000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


# --- views over the test tables ---------------------------------------------------------------


def event_log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("view", "click"), "push").when(F.col("event_type") == "purchase", "dump").when(F.col("event_type") == "signup", "recall").otherwise("clear")
    n = F.when(op == "push", 1 + F.pmod(F.floor("value").cast("bigint"), F.lit(50).cast("bigint")))
    return _t(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), op.alias("op"), F.coalesce(n, S.long(0)).alias("n_frames"), (F.col("event_type") == "view").alias("sound"))


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    sample = F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value") / 500).cast("float")
    return _t(spark, d, "events").select(F.col("event_id").alias("frame"), sample.alias("sample"))


def vector_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("samples"))


def _pushes(spark: SparkSession, d: str) -> DataFrame:
    return streams.ingest(event_log(spark, d).where("op = 'push'"), SLOTS, SLOT_FRAMES)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return streams.replay(event_log(spark, d), CHUNK, CHUNKS, SLOTS, SLOT_FRAMES)


def _long_form(spark: SparkSession, d: str) -> DataFrame:
    return samples.deinterleave(vector_blocks(spark, d), "vec_id", F.col("vec_id") * 32, 2)


_LOG = """log AS (SELECT user_id AS session, event_id AS seq,
  CASE WHEN event_type IN ('view','click') THEN 'push' WHEN event_type='purchase' THEN 'dump' WHEN event_type='signup' THEN 'recall' ELSE 'clear' END AS op,
  CASE WHEN event_type IN ('view','click') THEN 1 + CAST(floor(value) AS BIGINT) % 50 ELSE 0 END AS n_frames,
  event_type='view' AS sound FROM events)"""
_PUSHES = f"""{_LOG}, taken AS (SELECT *, least(n_frames, 40) AS enqueued, n_frames - least(n_frames, 40) AS dropped FROM log WHERE op='push'),
pushes AS (SELECT *, CAST(sum(enqueued) OVER w AS BIGINT) AS end_frame, CAST(sum(enqueued) OVER w AS BIGINT) - enqueued AS start_frame, CAST(sum(dropped) OVER w AS BIGINT) AS cumulative_dropped
  FROM taken WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
_OLDEST = "greatest(0, ((({h}) - 1) // {c} - {n} + 1) * {c})"
_FRAMES = "frames AS (SELECT event_id AS frame, CAST(CASE WHEN event_type='error' THEN 0.0 ELSE value / 500 END AS FLOAT) AS sample FROM events)"
_LONG = "longform AS (SELECT vec_id, vec_id * 32 + (i - 1) // 2 AS frame, CAST((i - 1) % 2 AS INTEGER) AS channel, embedding[i] AS sample FROM embeddings, range(1, 65) r(i))"
_Q = """CASE WHEN isnan({x}) THEN 0 WHEN {x} >= 0 THEN CAST(round(least({x}, 1::FLOAT) * 8388607::FLOAT) AS INTEGER)
  ELSE CAST(round(greatest({x}, (-1)::FLOAT) * 8388608::FLOAT) AS INTEGER) END"""
_REPLAY = f"""{_LOG},
a AS (SELECT *, CASE WHEN op='push' THEN least(n_frames, 40) ELSE 0 END AS took, CASE WHEN op='push' THEN n_frames - least(n_frames, 40) ELSE 0 END AS lost_now FROM log),
b AS (SELECT *, CAST(sum(took) OVER w AS BIGINT) AS H, CAST(sum(lost_now) OVER w AS BIGINT) AS D FROM a WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, coalesce(max(CASE WHEN op='push' AND sound AND took > 0 THEN H END) OVER w, 0) AS heard FROM b WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, coalesce(lag(H) OVER o, 0) AS K, coalesce(max(CASE WHEN op<>'clear' THEN H END) OVER w, 0) AS B, coalesce(max(CASE WHEN op='clear' THEN H END) OVER w, 0) AS CL,
  coalesce(max(CASE WHEN op<>'clear' THEN D END) OVER w, 0) AS acked, count(CASE WHEN op<>'clear' THEN 1 END) OVER w AS turn
  FROM c WHERE op<>'push' WINDOW o AS (PARTITION BY session ORDER BY seq), w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, greatest(B + CASE WHEN H > B THEN greatest(0, ((H - B - 1) // 8 - 4 + 1) * 8) ELSE 0 END, CL) AS old FROM e),
g AS (SELECT *, CASE WHEN op='clear' THEN greatest(0, old - K) ELSE 0 END AS own_retention, CASE WHEN op='clear' THEN greatest(0, H - greatest(K, old)) ELSE 0 END AS own_cleared, greatest(K, old) AS s FROM f),
h AS (SELECT *, CAST(coalesce(sum(own_retention) OVER w, 0) AS BIGINT) AS pr, CAST(coalesce(sum(own_cleared) OVER w, 0) AS BIGINT) AS pc FROM g
  WINDOW w AS (PARTITION BY session, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT session, seq, op, CASE WHEN op='clear' THEN 'cleared' WHEN s >= H THEN 'no_new_audio' WHEN heard <= s THEN 'skipped_silent' ELSE 'written' END AS kind,
  CASE WHEN op<>'clear' AND s < H THEN s END AS start_frame, CASE WHEN op<>'clear' AND s < H THEN H END AS end_frame, CASE WHEN op<>'clear' AND s < H THEN H - s ELSE 0 END AS frames,
  CASE WHEN op='clear' THEN 0 ELSE CASE WHEN s < H THEN s - K ELSE 0 END + pr END AS retention_lost, CASE WHEN op='clear' THEN 0 ELSE pc END AS cleared_lost, CASE WHEN op='clear' THEN 0 ELSE D - acked END AS dropped_lost,
  own_retention, own_cleared, H AS head, K FROM h),
outcomes AS (SELECT *, retention_lost + cleared_lost + dropped_lost AS lost FROM i)"""

_QUERIES: dict = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return add


# --- ingest -----------------------------------------------------------------------------------


@query("ingest_offsets", f"WITH {_PUSHES} SELECT session, seq, n_frames, start_frame, end_frame FROM pushes")
def ingest_offsets(spark, d):
    return _pushes(spark, d).select("session", "seq", "n_frames", "start_frame", "end_frame")


@query("ingress_drops", f"WITH {_PUSHES} SELECT session, seq, enqueued, dropped, cumulative_dropped FROM pushes")
def ingress_drops(spark, d):
    return _pushes(spark, d).select("session", "seq", "enqueued", "dropped", "cumulative_dropped")


@query("ingress_split", f"WITH {_PUSHES} SELECT session, seq, i AS slot, start_frame + i * 8 AS slot_start, least(8, enqueued - i * 8) AS slot_frames FROM pushes, range(0, 5) r(i) WHERE i * 8 < enqueued")
def ingress_split(spark, d):
    return streams.slots_of(_pushes(spark, d), SLOT_FRAMES).select("session", "seq", "slot", "slot_start", "slot_frames")


@query("ingress_unconsumed", f"WITH {_LOG}, c AS (SELECT session, max(seq) AS last FROM log WHERE op<>'push' GROUP BY 1) SELECT l.session, count(*) AS pushes, CAST(sum(least(n_frames, 40)) AS BIGINT) AS frames FROM log l LEFT JOIN c USING (session) WHERE op='push' AND (last IS NULL OR seq > last) GROUP BY 1")
def ingress_unconsumed(spark, d):
    """Pushes after a session's last command: what a shutdown counts as dropped."""
    log = event_log(spark, d)
    last = log.where("op <> 'push'").groupBy("session").agg(F.max("seq").alias("last"))
    rest = log.where("op = 'push'").join(last, "session", "left").where("last is null or seq > last")
    return rest.groupBy("session").agg(F.count("*").alias("pushes"), F.sum(S.enqueued(F.col("n_frames"), SLOTS, SLOT_FRAMES)).alias("frames"))


@query("ingress_queue_fill", f"""WITH {_LOG}, t AS (SELECT *, seq % 7 AS queued, least(n_frames, greatest(5 - seq % 7, 0) * 8) AS enqueued FROM log WHERE op='push')
SELECT session, seq, enqueued, n_frames - enqueued AS dropped, CAST(sum((enqueued + 7) // 8) OVER w AS BIGINT) AS published_sequence, CAST(sum(enqueued) OVER w AS BIGINT) AS end_frame FROM t WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def ingress_queue_fill(spark, d):
    """Pushes that meet a queue with up to six of its five slots' worth still waiting."""
    log = event_log(spark, d).where("op = 'push'")
    return streams.ingest(log, SLOTS, SLOT_FRAMES, queued=F.col("seq") % 7).select("session", "seq", "enqueued", "dropped", "published_sequence", "end_frame")


@query("pinned_overrun", f"WITH {_PUSHES}, h AS (SELECT session, seq, n_frames, start_frame AS head, CASE WHEN seq % 3 > 0 THEN greatest(0, start_frame // 8 - seq % 4) END AS pin FROM pushes) SELECT session, seq, CASE WHEN pin IS NULL THEN n_frames ELSE least(n_frames, greatest(0, (pin + 4) * 8 - head)) END AS accepted, n_frames - CASE WHEN pin IS NULL THEN n_frames ELSE least(n_frames, greatest(0, (pin + 4) * 8 - head)) END AS overrun FROM h")
def pinned_overrun(spark, d):
    """Pushes against a ring in which a reader pins one of the newest chunks."""
    p = _pushes(spark, d).withColumn("head", F.col("start_frame"))
    pin = F.when(F.col("seq") % 3 > 0, F.greatest(S.long(0), S.div(F.col("head"), CHUNK) - F.col("seq") % 4))
    took = S.accepted_before_pin(F.col("n_frames"), F.col("head"), pin, CHUNK, CHUNKS)
    return p.select("session", "seq", took.alias("accepted"), (F.col("n_frames") - took).alias("overrun"))


@query("clear_once", f"WITH {_REPLAY} SELECT session, seq AS clear_id, own_retention, own_cleared FROM outcomes WHERE op = 'clear'")
def clear_once(spark, d):
    """Clear reports delivered twice, taken once by their session and number."""
    reports = _outcomes(spark, d).where("op = 'clear'").select("session", F.col("seq").alias("clear_id"), "own_retention", "own_cleared")
    return streams.once(reports.union(reports.where("clear_id % 2 = 0")), "session", "clear_id")


@query("chunk_layout", f"WITH {_PUSHES}, f AS (SELECT session, unnest(range(start_frame, end_frame)) AS frame FROM pushes WHERE enqueued > 0) SELECT session, frame // 8 AS chunk, min(frame) AS chunk_start, count(*) AS valid FROM f GROUP BY 1, 2")
def chunk_layout(spark, d):
    return streams.chunks_of(_pushes(spark, d), CHUNK)


# --- retention and selection -------------------------------------------------------------------


@query("retention_oldest", f"WITH {_PUSHES} SELECT session, seq, end_frame AS head, {_OLDEST.format(h='end_frame', c=8, n=4)} AS oldest, end_frame - {_OLDEST.format(h='end_frame', c=8, n=4)} AS retained FROM pushes")
def retention_oldest(spark, d):
    p = _pushes(spark, d)
    oldest = S.oldest_frame(F.col("end_frame"), CHUNK, CHUNKS)
    return p.select("session", "seq", F.col("end_frame").alias("head"), oldest.alias("oldest"), (F.col("end_frame") - oldest).alias("retained"))


@query("ring_status", f"WITH {_PUSHES}, s AS (SELECT session, max(end_frame) AS head, CAST(sum(dropped) AS BIGINT) AS dropped FROM pushes GROUP BY 1) SELECT session, head, {_OLDEST.format(h='head', c=8, n=4)} AS oldest, head - {_OLDEST.format(h='head', c=8, n=4)} AS retained, CAST(32 AS BIGINT) AS capacity, dropped FROM s")
def ring_status(spark, d):
    return streams.status(_pushes(spark, d), CHUNK, CHUNKS)


@query("last_n_frames", f"WITH {_FRAMES}, h AS (SELECT max(frame) + 1 AS head FROM frames) SELECT frame, CAST(sample AS DOUBLE) AS sample FROM frames, h WHERE frame >= greatest(head - 1500, {_OLDEST.format(h='head', c=250, n=8)})")
def last_n_frames(spark, d):
    return streams.last_frames(event_frames(spark, d), 1500, 250, 8).select("frame", F.col("sample").cast("double").alias("sample"))


@query("exact_range", "SELECT vec_id AS frame, CAST(embedding[1] AS DOUBLE) AS left_sample, CAST(embedding[2] AS DOUBLE) AS right_sample FROM embeddings WHERE vec_id >= 100 AND vec_id < 300")
def exact_range(spark, d):
    f = vector_blocks(spark, d).withColumnRenamed("vec_id", "frame")
    return streams.exact_range(f, 100, 300, 0, 1 << 62).select("frame", F.col("samples")[0].cast("double").alias("left_sample"), F.col("samples")[1].cast("double").alias("right_sample"))


@query("capped_copy", "SELECT vec_id, len(embedding[11:30]) AS n, CAST(embedding[11] AS DOUBLE) AS first_sample, CAST(embedding[30] AS DOUBLE) AS last_sample FROM embeddings")
def capped_copy(spark, d):
    """Frames 5 to 24 of a stereo block into room for 10 frames."""
    s = samples.capped_copy(F.col("samples"), 5, 20, 20, 2)
    return vector_blocks(spark, d).select("vec_id", F.size(s).cast("bigint").alias("n"), F.get(s, F.lit(0)).cast("double").alias("first_sample"), F.get(s, F.size(s) - 1).cast("double").alias("last_sample"))


@query("range_segments", "WITH c AS (SELECT event_id // 64 AS chunk, min(event_id) AS chunk_start, count(*) AS valid FROM events GROUP BY 1) SELECT chunk, greatest(chunk_start, 100) AS segment_start, least(chunk_start + valid, 700) - greatest(chunk_start, 100) AS segment_frames FROM c WHERE chunk_start < 700 AND chunk_start + valid > 100")
def range_segments(spark, d):
    c = event_frames(spark, d).groupBy(S.div(F.col("frame"), 64).alias("chunk")).agg(F.min("frame").alias("chunk_start"), F.count("*").alias("valid"))
    return streams.segments(c, 100, 700).select("chunk", "segment_start", "segment_frames")


@query("coverage_gaps", "WITH p AS (SELECT event_id AS f, lag(event_id, 1, -1) OVER (ORDER BY event_id) AS b FROM events WHERE event_type <> 'signup' UNION ALL SELECT (SELECT max(event_id) + 1 FROM events), (SELECT max(event_id) FROM events WHERE event_type <> 'signup')) SELECT b + 1 AS gap_start, f AS gap_end FROM p WHERE b + 1 < f")
def coverage_gaps(spark, d):
    e = _t(spark, d, "events")
    end = e.agg(F.max("event_id") + 1).scalar()
    return streams.gaps(e.where("event_type <> 'signup'").select("event_id", S.long(1).alias("n")), 0, end, "event_id", "n")


@query("select_since_cursor", f"WITH {_PUSHES}, s AS (SELECT session, max(end_frame) AS head FROM pushes GROUP BY 1), o AS (SELECT session, head, CASE WHEN session % 3 > 0 THEN head // 2 END AS cur, {_OLDEST.format(h='head', c=8, n=4)} AS oldest FROM s) SELECT session, coalesce(cur, oldest) AS requested, oldest, greatest(coalesce(cur, oldest), oldest) AS start_frame, head AS end_frame, greatest(coalesce(cur, oldest), oldest) - coalesce(cur, oldest) AS lost FROM o")
def select_since_cursor(spark, d):
    heads = _pushes(spark, d).groupBy("session").agg(F.max("end_frame").alias("head"))
    heads = heads.withColumn("cursor", F.when(F.col("session") % 3 > 0, S.div(F.col("head"), 2)))
    return streams.since_cursor(heads, CHUNK, CHUNKS).select("session", "requested", "oldest", "start_frame", "end_frame", "lost")


# --- samples -----------------------------------------------------------------------------------


@query("deinterleave", f"WITH {_LONG} SELECT frame, channel, CAST(sample AS DOUBLE) AS sample FROM longform")
def deinterleave(spark, d):
    return _long_form(spark, d).select("frame", "channel", F.col("sample").cast("double").alias("sample"))


@query("interleave", "SELECT vec_id, CAST(64 AS BIGINT) AS n, true AS same FROM embeddings")
def interleave(spark, d):
    b = vector_blocks(spark, d)
    back = samples.interleave(samples.channel_of(F.col("samples"), 0, 2), samples.channel_of(F.col("samples"), 1, 2))
    return b.select("vec_id", F.size(back).cast("bigint").alias("n"), (back == F.col("samples")).alias("same"))


@query("frames_to_seconds", f"WITH {_PUSHES} SELECT session, max(end_frame) / 48000.0::DOUBLE AS seconds FROM pushes GROUP BY 1")
def frames_to_seconds(spark, d):
    return _pushes(spark, d).groupBy("session").agg(F.max("end_frame").alias("h")).select("session", S.seconds(F.col("h"), RATE).alias("seconds"))


@query("silence_blocks", f"WITH {_FRAMES} SELECT frame // 2 AS block, count(*) AS n, bool_and(sample = 0) AS silent FROM frames GROUP BY 1")
def silence_blocks(spark, d):
    return samples.silent_blocks(event_frames(spark, d), 2)


@query("silence_any_channel", "SELECT vec_id, bool_and(vec_id % 3 = 0 OR i > 1 + vec_id % 4 OR embedding[i] = 0) AS silent FROM embeddings, range(1, 65) r(i) GROUP BY 1")
def silence_any_channel(spark, d):
    """Vectors with every channel zeroed (every third), or all but the first few."""
    kept = F.transform("samples", lambda s, i: F.when((F.col("vec_id") % 3 == 0) | (i > F.col("vec_id") % 4), F.lit(0.0).cast("float")).otherwise(s))
    return vector_blocks(spark, d).select("vec_id", S.silent(kept).alias("silent"))


@query("quantize_s24", f"WITH v AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS channel, CAST(embedding[i] * 3::FLOAT AS FLOAT) AS x FROM embeddings, range(1, 65) r(i)) SELECT vec_id, channel, {_Q.format(x='x')} AS q FROM v")
def quantize_s24(spark, d):
    v = vector_blocks(spark, d).select("vec_id", F.posexplode("samples").alias("channel", "s"))
    return v.select("vec_id", "channel", S.s24(F.col("s") * F.lit(3.0).cast("float")).alias("q"))


@query("pcm_hex", f"WITH v AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS channel, embedding[i] AS x FROM embeddings, range(1, 65) r(i)), q AS (SELECT vec_id, channel, {_Q.format(x='x')} AS q FROM v) SELECT vec_id, channel, printf('%02X%02X%02X', q & 255, (q >> 8) & 255, (q >> 16) & 255) AS pcm FROM q")
def pcm_hex(spark, d):
    v = vector_blocks(spark, d).select("vec_id", F.posexplode("samples").alias("channel", "s"))
    return v.select("vec_id", "channel", S.s24_hex(S.s24(F.col("s"))).alias("pcm"))


@query("channel_stats", f"WITH {_LONG}, q AS (SELECT channel, {_Q.format(x='sample')} AS q FROM longform) SELECT channel, min(q) AS min_q, max(q) AS max_q, CAST(sum(q) AS BIGINT) AS sum_q, count(CASE WHEN q <> 0 THEN 1 END) AS nonzero FROM q GROUP BY 1")
def channel_stats(spark, d):
    return samples.channel_stats(_long_form(spark, d))


@query("channel_sample_parts", f"WITH {_LONG} SELECT channel, frame // 4096 AS part, count(*) AS n, md5(string_agg(CAST({_Q.format(x='sample')} AS VARCHAR), ',' ORDER BY frame)) AS digest FROM longform GROUP BY 1, 2")
def channel_sample_parts(spark, d):
    """Every channel's samples in time order over the whole table, in parts of 4096 frames: what a task gathers is bounded."""
    rows = _long_form(spark, d).withColumn("part", S.div(F.col("frame"), 4096)).groupBy("channel", "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("frame", S.s24(F.col("sample")).alias("q")))).alias("x"))
    return rows.select("channel", "part", "n", F.md5(F.array_join(F.transform("x", lambda s: s["q"].cast("string")), ",")).alias("digest"))


# --- parts, headers, names ----------------------------------------------------------------------

_SPLITS = "(5L, 50L), (16L, 80L), (8L, 47L), (0L, 80L), (79380000L, 390000L), (79380000L, 3900000000L), (1000L, 3044L)"
_PARTS = "t AS (SELECT total, split, (split - 44) // 3 AS per FROM (VALUES (5, 50), (16, 80), (8, 47), (0, 80), (79380000, 390000), (79380000, 3900000000), (1000, 3044)) v(total, split)), parts AS (SELECT total, split, CAST(i + 1 AS INTEGER) AS part, i * per AS start_frame, least(per, total - i * per) AS frame_count, (total + per - 1) // per AS n_parts FROM t, range(0, 1000) r(i) WHERE i * per < total)"


def _part_rows(spark):
    t = _rows(spark, _SPLITS, "total, split").withColumn("per", S.frames_per_part(F.col("split"), 3))
    rows = t.withColumn("n_parts", S.part_count(F.col("total"), F.col("per"))).withColumn("_p", F.explode(S.parts(F.col("total"), F.col("per"))))
    return rows.select("total", "split", "n_parts", "_p.part", "_p.start_frame", "_p.frame_count")


@query("wav_parts", f"WITH {_PARTS} SELECT CAST(total AS BIGINT) AS total, CAST(split AS BIGINT) AS split, CAST(n_parts AS BIGINT) AS n_parts, part, CAST(start_frame AS BIGINT) AS start_frame, CAST(frame_count AS BIGINT) AS frame_count FROM parts")
def wav_parts(spark, d):
    return _part_rows(spark)


@query("part_assignment", f"WITH {_LONG} SELECT channel, CAST(frame // 500 + 1 AS INTEGER) AS part, count(*) AS n_frames FROM longform GROUP BY 1, 2")
def part_assignment(spark, d):
    rows = _long_form(spark, d).withColumn("part", (S.div(F.col("frame"), 500) + S.long(1)).cast("int"))
    return rows.groupBy("channel", "part").agg(F.count("*").alias("n_frames"))


@query("wav_part_totals", f"""WITH {_FRAMES}, h AS (SELECT max(frame) + 1 AS head FROM frames), b AS (SELECT greatest(head - 1500, {_OLDEST.format(h='head', c=250, n=8)}) AS start FROM h),
k AS (SELECT frame, sample, start, {_Q.format(x='sample')} AS q FROM frames, b WHERE frame >= start) SELECT CAST((frame - start) // 100 + 1 AS INTEGER) AS part, count(*) AS n_frames, CAST(sum(q) AS BIGINT) AS sum_q, min(q) AS min_q, max(q) AS max_q, bool_and(sample = 0) AS silent FROM k GROUP BY 1""")
def wav_part_totals(spark, d):
    """Last frames of a stream, cut into parts and quantised: the flagship."""
    frames = event_frames(spark, d)
    start = streams.last_start(frames, 1500, 250, 8)
    return samples.part_totals(frames.where(F.col("frame") >= start), start, 100)


@query("wav_header_fields", f"WITH {_PARTS} SELECT CAST(total AS BIGINT) AS total, CAST(split AS BIGINT) AS split, part, CAST(36 + 3 * frame_count AS BIGINT) AS riff_size, CAST(144000 AS BIGINT) AS byte_rate, CAST(3 * frame_count AS BIGINT) AS data_bytes FROM parts")
def wav_header_fields(spark, d):
    return _part_rows(spark).select("total", "split", "part", (F.col("frame_count") * 3 + 36).alias("riff_size"), S.long(RATE * 3).alias("byte_rate"), (F.col("frame_count") * 3).alias("data_bytes"))


@query("wav_header_bytes", f"""WITH {_PARTS}, p AS (SELECT *, 3 * frame_count AS n FROM parts) SELECT CAST(total AS BIGINT) AS total, CAST(split AS BIGINT) AS split, part, concat(hex('RIFF'),
 printf('%02X%02X%02X%02X', (n+36) & 255, ((n+36)>>8) & 255, ((n+36)>>16) & 255, ((n+36)>>24) & 255), hex('WAVE'), hex('fmt '), '10000000', '0100', '0100', '80BB0000', '80320200', '0300', '1800', hex('data'),
 printf('%02X%02X%02X%02X', n & 255, (n>>8) & 255, (n>>16) & 255, (n>>24) & 255)) AS header FROM p""")
def wav_header_bytes(spark, d):
    return _part_rows(spark).select("total", "split", "part", S.header_hex(F.col("frame_count"), F.lit(RATE)).alias("header"))


@query("wav_names_simple", f"WITH {_PARTS} SELECT CAST(total AS BIGINT) AS total, CAST(split AS BIGINT) AS split, part, CASE WHEN n_parts > 1 THEN printf('ch%02d-part%03d.wav', CAST(total % 7 + 1 AS INTEGER), part) ELSE printf('ch%02d.wav', CAST(total % 7 + 1 AS INTEGER)) END AS name FROM parts")
def wav_names_simple(spark, d):
    rows = _part_rows(spark).withColumn("channel", (F.col("total") % 7).cast("int"))
    return rows.select("total", "split", "part", S.simple_name(S.channel_name(F.lit(None).cast("string"), F.col("channel")), F.col("part"), F.col("n_parts")).alias("name"))


@query("wav_names_detailed", f"WITH {_PARTS} SELECT CAST(total AS BIGINT) AS total, CAST(split AS BIGINT) AS split, part, printf('take-20260818T120000-left-48000Hz-%09d-%09d-part%03d.wav', start_frame, start_frame + frame_count, part) AS name FROM parts")
def wav_names_detailed(spark, d):
    name = S.detailed_name("take", F.lit("20260818T120000"), F.lit("left"), F.lit(RATE), F.col("start_frame"), F.col("start_frame") + F.col("frame_count"), F.col("part"))
    return _part_rows(spark).select("total", "split", "part", name.alias("name"))


@query("duplicate_names", "SELECT coalesce(nullif(p_brand, 'Brand#11'), printf('ch%02d', CAST(p_partkey % 50 + 1 AS INTEGER))) || '.wav' AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    p = _t(spark, d, "part")
    name = S.channel_name(F.nullif(F.col("p_brand"), F.lit("Brand#11")), (F.col("p_partkey") % 50).cast("int"))
    files = p.select(S.simple_name(name, F.lit(1), F.lit(1)).alias("name"))
    return files.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


@query("filename_safety", "SELECT safe, count(*) AS n FROM (SELECT p_name <> '' AND p_name NOT IN ('.', '..') AND NOT contains(p_name, '/') AS safe FROM part UNION ALL SELECT url <> '' AND url NOT IN ('.', '..') AND NOT contains(url, '/') FROM pages) GROUP BY 1")
def filename_safety(spark, d):
    names = _t(spark, d, "part").select(F.col("p_name").alias("x")).union(_t(spark, d, "pages").select("url"))
    return names.groupBy(S.safe_name(F.col("x")).alias("safe")).agg(F.count("*").alias("n"))


@query("timestamp_label", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d%H%M%S') AS label FROM orders UNION ALL SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') FROM events")
def timestamp_label(spark, d):
    a = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.time_label(F.col("o_orderdate")).alias("label"))
    return a.union(_t(spark, d, "events").select("event_id", S.time_label(F.col("ts"))))


# --- replay ------------------------------------------------------------------------------------

_OUT = "session, seq, op, kind, start_frame, end_frame, frames, retention_lost, cleared_lost, dropped_lost, lost"


@query("replay_outcomes", f"WITH {_REPLAY} SELECT {_OUT} FROM outcomes WHERE op <> 'clear'")
def replay_outcomes(spark, d):
    return _outcomes(spark, d).where("op <> 'clear'").select(*_OUT.split(", "))


@query("clear_accounting", f"WITH {_REPLAY} SELECT session, seq, own_retention, own_cleared, head FROM outcomes WHERE op = 'clear'")
def clear_accounting(spark, d):
    return _outcomes(spark, d).where("op = 'clear'").select("session", "seq", "own_retention", "own_cleared", "head")


@query("replay_loss_totals", f"WITH {_REPLAY} SELECT session, CAST(sum(retention_lost) AS BIGINT) AS retention_lost, CAST(sum(cleared_lost) AS BIGINT) AS cleared_lost, CAST(sum(dropped_lost) AS BIGINT) AS dropped_lost, CAST(sum(lost) AS BIGINT) AS lost FROM outcomes GROUP BY 1")
def replay_loss_totals(spark, d):
    return _outcomes(spark, d).groupBy("session").agg(*(F.sum(c).alias(c) for c in ("retention_lost", "cleared_lost", "dropped_lost", "lost")))


@query("persist_counts", f"WITH {_REPLAY} SELECT session, kind, count(*) AS n, CAST(sum(frames) AS BIGINT) AS frames FROM outcomes WHERE op <> 'clear' GROUP BY 1, 2")
def persist_counts(spark, d):
    return _outcomes(spark, d).where("op <> 'clear'").groupBy("session", "kind").agg(F.count("*").alias("n"), F.sum("frames").alias("frames"))


@query("replay_conservation", f"""WITH {_REPLAY}, p AS (SELECT session, CAST(sum(n_frames) AS BIGINT) AS pushed, CAST(sum(least(n_frames, 40)) AS BIGINT) AS enq FROM log WHERE op='push' GROUP BY 1),
x AS (SELECT session, CAST(sum(CASE WHEN kind='written' THEN frames ELSE 0 END) AS BIGINT) AS written, CAST(sum(CASE WHEN kind='skipped_silent' THEN frames ELSE 0 END) AS BIGINT) AS silent, CAST(sum(own_cleared) AS BIGINT) AS cleared,
 CAST(sum(CASE WHEN op='clear' THEN own_retention WHEN start_frame IS NOT NULL THEN start_frame - K ELSE 0 END) AS BIGINT) AS retention, max(head) AS cur FROM outcomes GROUP BY 1)
SELECT session, pushed, pushed - enq AS dropped, coalesce(written, 0) AS written, coalesce(silent, 0) AS silent, coalesce(cleared, 0) AS cleared, coalesce(retention, 0) AS retention, enq - coalesce(cur, 0) AS uncommitted, CAST(0 AS BIGINT) AS balance FROM p LEFT JOIN x USING (session)""")
def replay_conservation(spark, d):
    return streams.conservation(event_log(spark, d), _outcomes(spark, d), SLOTS, SLOT_FRAMES)


@query("loss_text", f"WITH {_REPLAY} SELECT session, seq, concat_ws(', ', CASE WHEN retention_lost > 0 THEN 'retention ' || retention_lost END, CASE WHEN cleared_lost > 0 THEN 'cleared ' || cleared_lost END, CASE WHEN dropped_lost > 0 THEN 'capture-dropped ' || dropped_lost END) AS causes FROM outcomes WHERE op <> 'clear'")
def loss_text(spark, d):
    return _outcomes(spark, d).where("op <> 'clear'").select("session", "seq", S.loss_text(F.col("retention_lost"), F.col("cleared_lost"), F.col("dropped_lost")).alias("causes"))


@query("outcome_message", f"WITH {_REPLAY} SELECT session, seq, CASE kind WHEN 'written' THEN 'written: ' || frames || ' frames' WHEN 'skipped_silent' THEN 'skipped exact-zero audio: ' || frames || ' frames' ELSE 'no new audio' END || CASE WHEN lost > 0 THEN '; warning: ' || lost || ' frames lost before persistence' ELSE '' END AS message, frames / 48000.0::DOUBLE AS duration_seconds FROM outcomes WHERE op <> 'clear'")
def outcome_message(spark, d):
    return _outcomes(spark, d).where("op <> 'clear'").select("session", "seq", S.outcome_message(F.col("kind"), F.col("frames"), F.col("lost")).alias("message"), S.seconds(F.col("frames"), RATE).alias("duration_seconds"))


@query("outcome_json_defaults", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'written' ELSE 'no_new_audio' END AS kind, event_id % 11 AS lost_frames, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE 0 END AS retention_lost_frames, CAST(0 AS BIGINT) AS cleared_frames FROM events")
def outcome_json_defaults(spark, d):
    """Responses with and without the newer loss fields; missing ones read as 0."""
    e = _t(spark, d, "events").select("event_id")
    kind = F.when(F.col("event_id") % 2 == 0, "written").otherwise("no_new_audio")
    new = F.to_json(F.struct(kind.alias("kind"), (F.col("event_id") % 11).alias("lost_frames"), (F.col("event_id") % 5).alias("retention_lost_frames")))
    old = F.to_json(F.struct(kind.alias("kind"), (F.col("event_id") % 11).alias("lost_frames")))
    x = F.from_json(F.when(F.col("event_id") % 3 == 0, new).otherwise(old), "kind string, lost_frames long, retention_lost_frames long, cleared_frames long")
    rows = e.withColumn("x", x)
    return rows.select("event_id", "x.kind", *(F.coalesce(F.col(f"x.{c}"), S.long(0)).alias(c) for c in ("lost_frames", "retention_lost_frames", "cleared_frames")))


@query("replay_stateful", f"WITH {_REPLAY} SELECT session, seq, op, kind, start_frame, end_frame, frames, retention_lost, cleared_lost, dropped_lost FROM outcomes")
def replay_stateful(spark, d):
    """The streaming coordinator's step function, folded over the same logs."""
    return stateful.replay_fold(event_log(spark, d), CHUNK, CHUNKS, SLOTS, SLOT_FRAMES)


_FAILURES = f"""WITH RECURSIVE {_LOG},
o AS (SELECT *, op = 'dump' AND seq % 7 = 0 AS fails, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM log),
s AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, '' AS op, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS start_frame, CAST(NULL AS BIGINT) AS end_frame, CAST(0 AS BIGINT) AS frames,
    CAST(0 AS BIGINT) AS rl, CAST(0 AS BIGINT) AS cl, CAST(0 AS BIGINT) AS dl, CAST(0 AS BIGINT) AS head, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS base, CAST(0 AS BIGINT) AS mark, CAST(0 AS BIGINT) AS cur,
    CAST(0 AS BIGINT) AS heard, CAST(0 AS BIGINT) AS pr, CAST(0 AS BIGINT) AS pc, CAST(0 AS BIGINT) AS acked, CAST(-1 AS BIGINT) AS fs, CAST(0 AS BIGINT) AS fe, false AS fz FROM log
  UNION ALL
  SELECT session, nrn, nseq, nop, kind, CASE WHEN kind IN ('written', 'skipped_silent', 'error') THEN xs END, CASE WHEN kind IN ('written', 'skipped_silent', 'error') THEN xe END, CASE WHEN kind IN ('written', 'skipped_silent', 'error') THEN xe - xs ELSE 0 END,
    CASE WHEN done THEN xs - cur ELSE 0 END + CASE WHEN done OR kind = 'no_new_audio' THEN pr ELSE 0 END, CASE WHEN done OR kind = 'no_new_audio' THEN pc ELSE 0 END, CASE WHEN done OR kind = 'no_new_audio' THEN d - acked ELSE 0 END,
    h, d, CASE WHEN nop IN ('recall', 'dump') AND fs < 0 THEN h ELSE base END, CASE WHEN nop = 'clear' THEN h ELSE mark END, CASE WHEN nop = 'clear' THEN h WHEN done THEN xe ELSE cur END, hd,
    CASE WHEN nop = 'clear' THEN pr + CASE WHEN fs >= 0 THEN fs - cur ELSE 0 END + greatest(0, old - expected) WHEN done OR kind = 'no_new_audio' THEN 0 ELSE pr END,
    CASE WHEN nop = 'clear' THEN pc + CASE WHEN fs >= 0 THEN fe - fs ELSE 0 END + greatest(0, h - greatest(expected, old)) WHEN done OR kind = 'no_new_audio' THEN 0 ELSE pc END,
    CASE WHEN done OR kind = 'no_new_audio' THEN d ELSE acked END, CASE WHEN nop = 'push' THEN fs WHEN kind = 'error' THEN xs ELSE -1 END, CASE WHEN kind = 'error' THEN xe ELSE fe END, CASE WHEN kind = 'error' THEN false ELSE fz END
  FROM (SELECT *, coalesce(kind IN ('written', 'skipped_silent'), false) AS done FROM (SELECT * EXCLUDE (kind), CASE WHEN nop = 'push' THEN NULL WHEN nop = 'clear' THEN 'cleared' WHEN fs < 0 AND xs >= h THEN 'no_new_audio' WHEN nfails AND NOT xz THEN 'error' WHEN xz THEN 'skipped_silent' ELSE 'written' END AS kind
    FROM (SELECT *, CASE WHEN fs >= 0 THEN fe ELSE cur END AS expected, CASE WHEN fs < 0 THEN greatest(cur, old) ELSE fs END AS xs, CASE WHEN fs < 0 THEN h ELSE fe END AS xe, CASE WHEN fs < 0 THEN hd <= greatest(cur, old) ELSE fz END AS xz
      FROM (SELECT *, greatest(base + CASE WHEN h > base THEN greatest(0, ((h - base - 1) // 8 - 4 + 1) * 8) ELSE 0 END, mark) AS old
        FROM (SELECT s.*, o.rn AS nrn, o.seq AS nseq, o.op AS nop, o.fails AS nfails, s.head + CASE WHEN o.op = 'push' THEN least(o.n_frames, 40) ELSE 0 END AS h, s.dropped + CASE WHEN o.op = 'push' THEN greatest(0, o.n_frames - 40) ELSE 0 END AS d,
          CASE WHEN o.op = 'push' AND o.sound AND o.n_frames > 0 THEN s.head + least(o.n_frames, 40) ELSE s.heard END AS hd FROM s JOIN o ON o.session = s.session AND o.rn = s.rn + 1)))))
) SELECT session, seq, op, kind, start_frame, end_frame, frames, rl AS retention_lost, cl AS cleared_lost, dl AS dropped_lost FROM s WHERE kind IS NOT NULL"""


@query("replay_failures", _FAILURES)
def replay_failures(spark, d):
    """Every seventh dump fails once; its range is kept and published by the next persist."""
    log = event_log(spark, d).withColumn("fails", (F.col("op") == "dump") & (F.col("seq") % 7 == 0))
    return stateful.replay_fold(log, CHUNK, CHUNKS, SLOTS, SLOT_FRAMES)


# --- whole files and raw buffers ------------------------------------------------------------------


@query("wav_files", f"""WITH {_LONG}, q AS (SELECT channel, CAST(frame // 4000 + 1 AS INTEGER) AS part, frame, {_Q.format(x='sample')} AS q FROM longform),
b AS (SELECT channel, part, count(*) AS frames, 3 * count(*) AS n, string_agg(printf('%02X%02X%02X', q & 255, (q >> 8) & 255, (q >> 16) & 255), '' ORDER BY frame) AS body FROM q GROUP BY 1, 2)
SELECT channel, part, frames, printf('ch%02d-part%03d.wav', channel + 1, part) AS name, 44 + n AS size, md5(unhex(concat(hex('RIFF'), printf('%02X%02X%02X%02X', (n+36) & 255, ((n+36)>>8) & 255, ((n+36)>>16) & 255, ((n+36)>>24) & 255), hex('WAVE'), hex('fmt '), '10000000', '0100', '0100', '80BB0000', '80320200', '0300', '1800', hex('data'),
 printf('%02X%02X%02X%02X', n & 255, (n>>8) & 255, (n>>16) & 255, (n>>24) & 255), body))) AS digest FROM b""")
def wav_files(spark, d):
    """The files themselves: header and PCM body of every channel and part."""
    name = S.simple_name(S.channel_name(F.lit(None).cast("string"), F.col("channel")), F.col("part"), F.lit(2))
    files = publish.wav_parts(_long_form(spark, d), S.long(0), 4000, RATE, name)
    return files.select("channel", "part", "frames", "name", F.length("content").cast("bigint").alias("size"), F.md5("content").alias("digest"))


@query("raw_buffer_scan", "SELECT event_id AS id, CASE WHEN event_id % 10 > 0 THEN event_id % 8 + 1 END AS n, CASE WHEN event_id % 10 > 0 THEN CAST(event_id % 8 + 1 AS DOUBLE) END AS total, CASE WHEN event_id % 10 = 0 THEN 'stride must be 4 bytes a channel' END AS error FROM events")
def raw_buffer_scan(spark, d):
    """Buffers of 1.0 samples behind 4 bytes of something else; every tenth has a wrong stride."""
    n = (F.col("event_id") % 8 + 1).cast("int")
    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.unhex(F.concat(F.lit("FFFFFFFF"), F.repeat(F.lit("0000803F"), n))).alias("data"), F.lit(4).alias("offset"), (n * 4).alias("size"), F.when(F.col("event_id") % 10 == 0, 8).otherwise(4).alias("stride"), F.lit(1).alias("channels"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return scans.raw_buffers(rows).select("id", F.when(F.col("error").isNull(), F.size("samples").cast("bigint")).alias("n"), F.when(F.col("error").isNull(), total).alias("total"), "error")


@query("signal_frames", """WITH RECURSIVE a(k, v) AS (SELECT 0, 0::FLOAT UNION ALL SELECT k + 1, v + 0.001::FLOAT FROM a WHERE v + 0.001::FLOAT <= 1),
b(k, v) AS (SELECT 0, (-1)::FLOAT UNION ALL SELECT k + 1, v + 0.001::FLOAT FROM b WHERE v + 0.001::FLOAT <= 1),
n AS (SELECT (SELECT count(*) FROM a) AS first, (SELECT count(*) FROM b) AS period),
k AS (SELECT event_id AS frame, c, event_id * 2 + c AS pos FROM events, range(0, 2) r(c)),
x AS (SELECT frame, c, CAST(coalesce(a.v, b.v) AS DOUBLE) AS v FROM k CROSS JOIN n LEFT JOIN a ON pos < first AND a.k = pos LEFT JOIN b ON pos >= first AND b.k = (pos - first) % period)
SELECT frame, max(v) FILTER (WHERE c = 0) AS left_sample, max(v) FILTER (WHERE c = 1) AS right_sample FROM x GROUP BY 1""")
def signal_frames(spark, d):
    """The deterministic stereo test signal, one frame an event."""
    x = scans.signal_samples(F.col("event_id"), 2)
    return _t(spark, d, "events").select(F.col("event_id").alias("frame"), x[0].cast("double").alias("left_sample"), x[1].cast("double").alias("right_sample"))


# --- memory plan -------------------------------------------------------------------------------


def geometries(spark) -> DataFrame:
    """A grid; the first is the small test geometry."""
    names = "retention, channels, rate, chunk, snapshots, split, control, stack, queue, slot_frames, capture_stack, io, path"
    small = "(10L, 2L, 48000L, 4L, 1L, 50L, 3L, 1024L, 3L, 4L, 2048L, 64L, 128L)"
    full = ", ".join(f"({s}L * {r}L, {c}L, {r}L, {r}L div 4, 1L, {split}L, 16L, 524288L, 64L, {r}L div 4, 524288L, 65536L, 4096L)" for s in (5, 60, 1800) for r in (44100, 48000) for c in (1, 2, 4) for split in (1073741824, 3900000000))
    g = _rows(spark, f"{small}, {full}", names)
    return g.withColumn("per_part", S.frames_per_part(F.col("split"), 3))


_GRID = """g AS (SELECT *, (split - 44) // 3 AS per FROM (SELECT 10 AS retention, 2 AS channels, 48000 AS rate, 4 AS chunk, 50 AS split, 3 AS control, 1024 AS stack, 3 AS queue, 4 AS slot_frames, 2048 AS capture_stack, 64 AS io, 128 AS path
 UNION ALL SELECT CAST(s AS BIGINT) * r, c, r, r // 4, split, 16, 524288, 64, r // 4, 524288, 65536, 4096 FROM (VALUES (5), (60), (1800)) a(s), (VALUES (44100), (48000)) b(r), (VALUES (1), (2), (4)) x(c), (VALUES (1073741824), (3900000000)) y(split))),
k AS (SELECT *, greatest(1, (retention + chunk - 1) // chunk) AS n, chunk * channels * 4 AS blk, ((retention + per - 1) // per) * channels AS pa FROM g),
m AS (SELECT *, 2 * pa + 5 AS sl FROM k)"""
_A = "((({}) + 64 + 4095) // 4096 * 4096)"


def _oracle_components() -> dict[str, str]:
    a = _A.format
    return {
        "ring_samples": "2 * n * blk", "ring_sample_allocator_padding": f"2 * n * ({a('blk')} - blk)", "ring_chunk_objects": f"2 * n * {a('512')}", "ring_chunk_index": f"2 * {a('8 * n')}",
        "ring_fixed_metadata": f"2 * {a('512')}", "capture_queue_samples": f"queue * {a('slot_frames * channels * 4')}", "capture_queue_slot_metadata": a("64 * queue"), "capture_command_result_slot": a("512"),
        "capture_worker_stack": a("capture_stack"), "persistence_workspace": "blk + channels * io", "workspace_allocator_padding": f"{a('blk')} - blk + channels * ({a('io')} - io)", "split_part_slots": a("32 * pa"),
        "file_writer_slots": a("256 * channels"), "path_bytes": "sl * path", "path_allocator_padding": f"sl * ({a('path')} - path)", "path_slot_metadata": a("32 * sl"), "manifest_entries": a("128 * pa"),
        "manifest_serialization": a("1024 + sl * (6 * path + 256)"), "manifest_paths": a("(3 * pa + 5) * path"), "operation_worker_stack": a("stack"), "operation_queue": a("256 * control"), "runtime_fixed_metadata": a("512"),
    }


_COMPONENTS = " UNION ALL ".join(f"SELECT retention, channels, rate, split, '{k}' AS name, {v} AS bytes FROM m" for k, v in _oracle_components().items())
_KEY = "CAST(retention AS BIGINT) AS retention, CAST(channels AS BIGINT) AS channels, CAST(rate AS BIGINT) AS rate, CAST(split AS BIGINT) AS split"
_SUM = f"WITH {_GRID}, c AS ({_COMPONENTS}), s AS (SELECT retention, channels, rate, split, CAST(sum(bytes) AS BIGINT) AS committed FROM c GROUP BY ALL)"


@query("memory_plan", f"WITH {_GRID}, c AS ({_COMPONENTS}) SELECT {_KEY}, name, CAST(bytes AS BIGINT) AS bytes FROM c")
def memory_plan(spark, d):
    return memory.plan(geometries(spark)).select("retention", "channels", "rate", "split", F.explode("plan").alias("p")).select("retention", "channels", "rate", "split", "p.name", "p.bytes")


@query("memory_total", f"{_SUM} SELECT {_KEY}, committed FROM s")
def memory_total(spark, d):
    return memory.plan(geometries(spark)).select("retention", "channels", "rate", "split", "committed")


@query("memory_admission", f"{_SUM}, q AS (SELECT *, (committed * h + 3) // 4 AS required FROM s, (VALUES (4), (5), (6)) v(h)) SELECT {_KEY}, CAST(h AS BIGINT) AS quarters, CAST(required AS BIGINT) AS required, CASE WHEN required <= 500000000 THEN 'accepted' ELSE 'required ' || CAST(required AS BIGINT) || ' bytes exceed 500000000' END AS verdict FROM q")
def memory_admission(spark, d):
    rows = memory.plan(geometries(spark)).withColumn("quarters", F.explode(F.array(S.long(4), S.long(5), S.long(6)))).withColumn("required", memory.required(F.col("committed"), F.col("quarters")))
    return rows.select("retention", "channels", "rate", "split", "quarters", "required", memory.admitted(F.col("required"), S.long(500000000)).alias("verdict"))


@query("memory_validation", "SELECT * FROM (VALUES ('ok', NULL), ('zero channels', 'channels must be > 0'), ('zero path', 'path must be > 0'), ('low', 'headroom must be finite and >= 1.0'), ('nan', 'headroom must be finite and >= 1.0'), ('inf', 'headroom must be finite and >= 1.0')) t(name, error)")
def memory_validation(spark, d):
    g = geometries(spark).where("retention = 10")
    cases = [("ok", {}), ("zero channels", {"channels": S.long(0)}), ("zero path", {"path": S.long(0)}), ("low", {"headroom": F.lit(0.99)}), ("nan", {"headroom": F.lit(float("nan"))}), ("inf", {"headroom": F.lit(float("inf"))})]
    out = None
    for name, change in cases:
        one = g.withColumns({"headroom": F.lit(1.0)} | change).select(F.lit(name).alias("name"), memory.invalid().alias("error"))
        out = one if out is None else out.union(one)
    return out


@query("chunk_defaults", "SELECT rate, requested, CASE WHEN coalesce(requested, 0) > 0 THEN CAST(requested AS BIGINT) ELSE greatest(rate * 250 // 1000, 1) END AS chunk_frames, CAST((1800 * rate + 4095) // 4096 AS BIGINT) AS descriptors FROM (VALUES (44100, NULL), (48000, 0), (48000, 1024), (3, NULL), (100, 7)) t(rate, requested)")
def chunk_defaults(spark, d):
    t = _rows(spark, "(44100, NULL), (48000, 0), (48000, 1024), (3, NULL), (100, 7)", "rate, requested")
    return t.select(F.col("rate"), "requested", S.chunk_frames(F.col("rate").cast("bigint"), F.col("requested")).alias("chunk_frames"), S.descriptor_count(1800, F.col("rate").cast("bigint"), 4096).alias("descriptors"))


# --- settings ----------------------------------------------------------------------------------


def _nodes(spark, d) -> DataFrame:
    s, n = _t(spark, d, "supplier"), _t(spark, d, "nation")
    kind = F.when(F.col("s_suppkey") % 4 == 0, "Audio/Sink").when(F.col("s_suppkey") % 4 == 1, "Audio/Input").otherwise("Audio/Source")
    name = F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit(".monitor"))).otherwise(F.col("s_name"))
    text = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("Monitor of "), "n_name")).otherwise(F.concat("n_name", F.lit(" "), F.col("s_suppkey").cast("string")))
    both = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return both.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("position"), F.when(F.col("s_suppkey") % 6 == 0, "Device").otherwise("Node").alias("object_type"), kind.alias("media_class"), name.alias("name"), text.alias("description"))


_NODES = """nodes AS (SELECT s_suppkey AS id, s_suppkey AS position, CASE WHEN s_suppkey % 6 = 0 THEN 'Device' ELSE 'Node' END AS object_type,
 CASE WHEN s_suppkey % 4 = 0 THEN 'Audio/Sink' WHEN s_suppkey % 4 = 1 THEN 'Audio/Input' ELSE 'Audio/Source' END AS media_class,
 CASE WHEN s_suppkey % 5 = 0 THEN s_name || '.monitor' ELSE s_name END AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'Monitor of ' || n_name ELSE n_name || ' ' || s_suppkey END AS description
 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
good AS (SELECT *, object_type = 'Node' AND media_class IN ('Audio/Source', 'Audio/Input') AND name NOT LIKE '%.monitor' AND lower(description) NOT LIKE '%monitor%' AS ok FROM nodes)"""


@query("input_sources", f"WITH {_NODES} SELECT id, ok FROM good")
def input_sources(spark, d):
    return _nodes(spark, d).select("id", settings.input_source().alias("ok"))


@query("resolve_target", f"""WITH {_NODES}, req AS (SELECT * FROM (VALUES (1, NULL), (2, '2'), (3, '4'), (4, 'no such node'), (5, '9')) t(request, target)),
j AS (SELECT request, target, id, ok, row_number() OVER (PARTITION BY request ORDER BY position) AS rn FROM req LEFT JOIN good ON CASE WHEN target IS NULL THEN ok ELSE CAST(id AS VARCHAR) = target OR name = target OR description = target END)
SELECT request, target, CASE WHEN id IS NOT NULL AND ok THEN id END AS id, CASE WHEN id IS NULL AND target IS NULL THEN 'no input source available' WHEN id IS NULL THEN 'target ' || target || ' not found' WHEN NOT ok THEN 'target ' || target || ' is not an input source' END AS error FROM j WHERE rn = 1""")
def resolve_target(spark, d):
    req = _rows(spark, "(1, CAST(NULL AS STRING)), (2, '2'), (3, '4'), (4, 'no such node'), (5, '9')", "request, target")
    return settings.resolve(_nodes(spark, d), req)


@query("resolved_format", "SELECT * FROM (VALUES (1, 2, 48000, NULL), (2, 4, 44100, NULL), (3, 2, 48000, 'channelMap length 3 must match channels 2'), (4, NULL, 48000, 'channels unknown'), (5, 2, NULL, 'sample rate unknown'), (6, 2, 48000, 'format S16LE is unsupported')) t(id, channels, sample_rate, error)")
def resolved_format(spark, d):
    rows = _rows(spark, "(1, 2, CAST(NULL AS INT), 48000, 44100, CAST(NULL AS STRING), array('a','b')), (2, NULL, 4, NULL, 44100, 'F32LE', NULL), (3, 2, 3, 48000, NULL, NULL, array('a','b','c')), (4, NULL, NULL, 48000, NULL, NULL, NULL), (5, 2, NULL, NULL, NULL, NULL, NULL), (6, 2, NULL, 48000, NULL, 'S16LE', NULL)", "id, node_channels, config_channels, node_rate, config_rate, node_format, channel_map")
    return settings.resolved_stream(rows).select("id", "channels", "sample_rate", "error")


_CONFIG = {"config_version": "1", "user": "'me'", "backend": "'fake'", "seconds": "5", "sample_rate": "48000", "channels": "2", "channel_map": "array('a','b')", "sample_format": "'F32LE'", "output_dir": "'/out'", "headroom": "1.2D", "max_active_snapshots": "1", "chunk_frames": "CAST(NULL AS INT)", "control_permissions": "'0600'", "export_mode": "'per-channel'", "export_format": "'wav'", "split_when_over_bytes": "1073741824L"}
_BROKEN = [
    ({}, None),
    ({"config_version": "2"}, "configVersion 2 is not supported; expected 1"),
    ({"user": "'  '"}, "user must be non-empty"),
    ({"backend": "'jack'"}, "backend must be pipewire or fake"),
    ({"seconds": "0"}, "seconds must be > 0"),
    ({"sample_rate": "0"}, "sampleRate must be > 0"),
    ({"channels": "0"}, "channels must be > 0"),
    ({"channel_map": "array('a','b','c')"}, "channelMap length 3 must match channels 2"),
    ({"channel_map": "CAST(array() AS ARRAY<STRING>)", "channels": "CAST(NULL AS INT)"}, None),
    ({"sample_format": "'S16LE'"}, "sampleFormat S16LE is unsupported in v0.2; expected F32LE"),
    ({"output_dir": "'out'"}, "outputDir must be absolute in daemon config"),
    ({"headroom": "0.5D"}, "memory.headroom must be finite and >= 1.0"),
    ({"headroom": "double('NaN')"}, "memory.headroom must be finite and >= 1.0"),
    ({"max_active_snapshots": "0"}, "maxActiveSnapshots must be > 0"),
    ({"chunk_frames": "0"}, "chunkFrames must be > 0"),
    ({"control_permissions": "'0644'"}, "controlPermissions must be 0600 in v0.2"),
    ({"export_mode": "'mixed'"}, "export.mode must be per-channel"),
    ({"export_format": "'flac'"}, "export.format must be wav"),
    ({"split_when_over_bytes": "0L"}, "export.splitWhenOverBytes must be between 1 and 3999999999"),
    ({"split_when_over_bytes": "4000000000L", "export_format": "'flac'"}, "export.format must be wav"),
]


@query("config_first_error", "SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ("NULL" if e is None else f"'{e}'") + ")" for i, (_, e) in enumerate(_BROKEN)) + ") t(id, error)")
def config_first_error(spark, d):
    rows = ", ".join(f"({i}, " + ", ".join((_CONFIG | c).values()) + ")" for i, (c, _) in enumerate(_BROKEN))
    return _rows(spark, rows, "id, " + ", ".join(_CONFIG)).select("id", settings.config_error().alias("error"))


@query("profile_ports", "SELECT s_suppkey AS id, CAST(i AS INTEGER) AS position, CASE WHEN i % 2 = 0 THEN printf('ch%02d', CAST(i + 1 AS INTEGER)) ELSE s_name || '-' || i END AS name, 'system:' || i AS source FROM supplier, range(0, 3) r(i)")
def profile_ports(spark, d):
    s = _t(spark, d, "supplier")
    port = lambda i: F.struct((F.lit(None).cast("string") if i % 2 == 0 else F.concat("s_name", F.lit(f"-{i}"))).alias("name"), F.lit(f"system:{i}").alias("source"))
    profiles = s.select(F.col("s_suppkey").alias("id"), F.array(*(port(i) for i in range(3))).alias("ports"))
    return settings.ports(profiles, "id")


@query("active_profile", "SELECT o_orderkey AS request, n_name AS profile, CASE WHEN o_orderkey % 30 >= 25 THEN 'profile ' || CAST(o_orderkey % 30 AS VARCHAR) || ' does not exist' END AS error FROM orders LEFT JOIN nation ON o_orderkey % 7 > 0 AND o_orderkey % 30 = n_nationkey WHERE o_orderkey % 7 > 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0")
def active_profile(spark, d):
    active = F.when(F.col("o_orderkey") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), (F.col("o_orderkey") % 30).cast("string"), F.lit(" ")))
    req = _t(spark, d, "orders").select(F.col("o_orderkey").alias("request"), active.alias("active"))
    profiles = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("profile"))
    return settings.active_profile(req, profiles).select("request", "profile", "error")


_PROFILES = """CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN 'alsa' WHEN k % 2 = 0 THEN 'jack' ELSE 'pipewire' END AS backend, CASE WHEN k % 13 = 0 THEN '  ' WHEN k % 13 = 1 THEN NULL ELSE c_name END AS client_name,
 CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 3 ELSE 1 END AS n_ports, CASE WHEN k % 5 IN (2, 3) AND k % 3 > 0 THEN 1 ELSE 0 END AS n_sources, k % 17 = 0 AS blank, CASE WHEN k % 19 = 0 THEN 0 WHEN k % 19 = 1 THEN NULL ELSE 5 END AS seconds,
 CASE WHEN k % 23 = 0 THEN 'takes' WHEN k % 23 = 1 THEN NULL ELSE '/takes' END AS output_dir, CASE WHEN k % 29 = 0 THEN 'mixed' ELSE 'per-channel' END AS export_mode, CASE WHEN k % 31 = 0 THEN 'flac' ELSE 'wav' END AS export_format"""


@query("profile_rules", f"""WITH p AS (SELECT k, {_PROFILES} FROM (SELECT c_custkey AS k, c_name FROM customer)),
e AS (SELECT k, CASE WHEN backend IS NULL OR backend = 'alsa' THEN 'backend must be jack or pipewire'
 WHEN backend = 'jack' AND trim(coalesce(client_name, '')) = '' THEN 'clientName is required'
 WHEN backend = 'jack' AND n_ports > 0 AND n_sources > 0 THEN 'ports and sources are exclusive'
 WHEN backend = 'jack' AND blank AND n_ports + n_sources > 0 THEN 'a port source must be non-empty'
 WHEN backend = 'jack' AND n_ports + n_sources = 0 THEN 'ports or sources are required'
 WHEN coalesce(seconds, 0) = 0 THEN 'buffer.seconds must be > 0' WHEN output_dir IS NULL OR output_dir = 'takes' THEN 'outputDir must be absolute'
 WHEN export_mode = 'mixed' THEN 'export.mode must be per-channel' WHEN export_format = 'flac' THEN 'export.format must be wav' END AS error FROM p) SELECT error, count(*) AS n, min(k) AS first_id FROM e GROUP BY 1""")
def profile_rules(spark, d):
    """First broken rule of a profile a customer."""
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name").selectExpr("k", *_split_columns(_PROFILES))
    source = F.when(F.col("blank"), F.lit(" ")).otherwise(F.lit("system:1"))
    rows = rows.withColumn("ports", F.array_repeat(source, F.col("n_ports"))).withColumn("sources", F.array_repeat(source, F.col("n_sources")))
    return rows.select("k", settings.profile_error().alias("error")).groupBy("error").agg(F.count("*").alias("n"), F.min("k").alias("first_id"))


def _split_columns(text: str) -> list[str]:
    """Top-level items of a SELECT list."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query("app_rules", "SELECT mode, CASE WHEN coalesce(mode, 'manual') NOT IN ('manual', 'auto') THEN 'startMode must be manual or auto, not ' || mode END AS error, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'auto' WHEN 'O' THEN 'manual' WHEN 'P' THEN NULL ELSE 'later' END AS mode FROM orders UNION ALL SELECT lower(n_name) FROM nation) GROUP BY 1")
def app_rules(spark, d):
    mode = F.when(F.col("o_orderstatus") == "F", "auto").when(F.col("o_orderstatus") == "O", "manual").when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise("later")
    rows = _t(spark, d, "orders").select(mode.alias("start_mode")).union(_t(spark, d, "nation").select(F.lower("n_name")))
    return rows.select(F.col("start_mode").alias("mode"), settings.app_error().alias("error")).groupBy("mode", "error").agg(F.count("*").alias("n"))


@query("manifest_first_error", """SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN 'fields' WHEN p_partkey % 13 = 0 THEN 'version' WHEN p_partkey % 11 = 0 THEN 'uid' WHEN p_partkey % 7 = 0 THEN 'kind' WHEN p_partkey % 5 = 0 THEN 'entries'
 WHEN p_partkey % 4 = 3 THEN 'phase' WHEN p_partkey % 4 = 2 THEN 'index' WHEN p_partkey % 3 = 0 THEN 'traversal' WHEN p_partkey % 19 = 0 THEN 'twice' END AS error FROM part""")
def manifest_first_error(spark, d):
    """A manifest a part, with a rule broken here and there."""
    k = F.col("p_partkey")
    artifact = lambda path: F.struct(path.alias("path"), F.struct(F.lit(1).alias("device"), k.alias("inode")).alias("identity"))
    final = F.when(k % 3 == 0, F.concat(F.lit("/out/../"), "p_name")).otherwise(F.concat(F.lit("/out/"), "p_name"))
    entry = lambda path: F.struct(artifact(F.lit("/staging/t/a.wav")).alias("staged"), artifact(F.lit("/out/a.partial")).alias("partial"), artifact(path).alias("final_path"))
    entries = F.to_json(F.array(entry(final), entry(F.when(k % 19 == 0, final).otherwise(F.concat(final, F.lit("2"))))))
    phase = F.to_json(F.struct(F.when(k % 4 == 3, "unknown").when(k % 4 == 2, "publishing").otherwise("prepared").alias("state"), F.when(k % 4 == 2, 9).otherwise(0).alias("index")))
    extra = F.when(k % 17 == 0, F.lit(', "more": 1')).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"version": '), F.when(k % 13 == 0, "2").otherwise("1"), F.lit(', "uid": '), F.when(k % 11 == 0, "8").otherwise("7"), F.lit(', "transaction_id": "t", "kind": "'), F.when(k % 7 == 0, "move").otherwise("recall"),
        F.lit('", "phase": '), phase, F.lit(', "staging_root": {"path": "/staging/t"}, "output_root": "/out", "final_directory": null, "entries": '), F.when(k % 5 == 0, F.lit("[]")).otherwise(entries), extra, F.lit("}"),
    )
    table = publish.manifest_rows(_t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("value")))
    return publish.manifest_rules(table, 7).select(F.col("path").cast("bigint").alias("id"), "error")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
