"""Command logs: literal vectors, and windows against the step model on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from framesieve.operators import streams
from framesieve.streaming import replay as R
from framesieve.streaming import sinks

CASES = [
    (8, [("push", 2), ("recall", 0), ("push", 2), ("dump", 0), ("recall", 0)], [("written", 0, 2, 0, 0, 0), ("written", 2, 4, 0, 0, 0), ("no_new_audio", None, None, 0, 0, 0)]),
    (4, [("push", 6), ("recall", 0), ("recall", 0)], [("written", 2, 6, 2, 0, 0), ("no_new_audio", None, None, 0, 0, 0)]),
    (4, [("push", 6), ("clear", 0), ("recall", 0), ("recall", 0)], [("cleared", None, None, 0, 0, 0), ("no_new_audio", None, None, 2, 4, 0), ("no_new_audio", None, None, 0, 0, 0)]),
    (4, [("push", 2), ("recall", 0), ("push", 6), ("recall", 0)], [("written", 0, 2, 0, 0, 0), ("written", 4, 8, 2, 0, 0)]),
]


@pytest.mark.parametrize("retention,ops,expected", CASES)
def test_vectors(spark, retention, ops, expected):
    rows = [(1, i, op, n, True) for i, (op, n) in enumerate(ops)]
    log = spark.createDataFrame(rows, "session long, seq long, op string, n_frames long, sound boolean")
    got = streams.replay(log, 2, retention // 2, 1 << 20, 2).orderBy("seq").collect()
    assert [(r.kind, r.start_frame, r.end_frame, r.retention_lost, r.cleared_lost, r.dropped_lost) for r in got] == expected
    c = R.Coordinator()
    steps = [c.step(op, n, True, False, (2, retention // 2, 1 << 20, 2)) for op, n in ops]
    assert [s for s in steps if s] == expected


def test_failures():
    geometry = (2, 2, 1 << 20, 2)
    c, out = R.Coordinator(), []
    for op, n, bad in [("push", 2, 0), ("dump", 0, 0), ("push", 2, 0), ("dump", 0, 1), ("push", 8, 0), ("dump", 0, 0), ("recall", 0, 0)]:
        if got := c.step(op, n, True, bool(bad), geometry):
            out.append(got)
    assert [x[:3] for x in out] == [("written", 0, 2), ("error", 2, 4), ("written", 2, 4), ("written", 8, 12)]
    assert out[-1][3] == 4
    c, out = R.Coordinator(), []
    for op, n, bad in [("push", 2, 0), ("dump", 0, 0), ("push", 2, 0), ("dump", 0, 1), ("push", 3, 0), ("clear", 0, 0), ("recall", 0, 0)]:
        if got := c.step(op, n, True, bool(bad), (2, 8, 1 << 20, 2)):
            out.append(got)
    assert out[-1] == ("no_new_audio", None, None, 0, 5, 0)
    c, out = R.Coordinator(), []
    for op, n, bad in [("push", 8, 0), ("dump", 0, 1), ("push", 3, 0), ("clear", 0, 0), ("recall", 0, 0)]:
        if got := c.step(op, n, True, bool(bad), geometry):
            out.append(got)
    # Four frames were lost before the range that was given up.
    assert out == [("error", 4, 8, 0, 0, 0), ("cleared", None, None, 0, 0, 0), ("no_new_audio", None, None, 4, 7, 0)]


def random_log(seed: int, sessions: int = 30, length: int = 60):
    rng = random.Random(seed)
    return [(s, i, rng.choice(["push"] * 4 + ["recall", "dump", "clear"]), rng.randrange(0, 60), rng.random() < 0.6) for s in range(sessions) for i in range(length)]


def test_windows_equal_steps(spark):
    rows = random_log(7)
    log = spark.createDataFrame(rows, "session long, seq long, op string, n_frames long, sound boolean")
    want = []
    for s in {r[0] for r in rows}:
        c = R.Coordinator()
        for _, seq, op, n, sound in [r for r in rows if r[0] == s]:
            if got := c.step(op, n, sound, False, (8, 4, 5, 8)):
                want.append((s, seq, *got))
    got = streams.replay(log, 8, 4, 5, 8)
    assert sorted(map(str, want)) == sorted(str((r.session, r.seq, r.kind, r.start_frame, r.end_frame, r.retention_lost, r.cleared_lost, r.dropped_lost)) for r in got.collect())
    assert {r.balance for r in streams.conservation(log, got, 5, 8).collect()} == {0}


def test_stream_equals_batch(spark, tmp_path):
    rows = random_log(11, 6, 40)
    schema = "session long, seq long, op string, n_frames long, sound boolean"
    for k in range(4):
        spark.createDataFrame([r for r in rows if k * 10 <= r[1] < k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.replay_stream(log, 8, 4, 5, 8).writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("outcomes")
    want = streams.replay(spark.createDataFrame(rows, schema), 8, 4, 5, 8).select(*got.columns)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want) and got.count() > 50
    again = sinks.write_outcomes(R.replay_stream(log, 8, 4, 5, 8), str(tmp_path / "out"), str(tmp_path / "c2"), availableNow=True)
    again.awaitTermination()
    assert key(sinks.read_outcomes(spark, str(tmp_path / "out")).select(*got.columns)) == key(want)
    folded = R.replay_fold(spark.createDataFrame(rows, schema).withColumn("fails", F.lit(False)), 8, 4, 5, 8)
    assert key(folded.select(*got.columns)) == key(want)
