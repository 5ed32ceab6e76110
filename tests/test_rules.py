"""Literal vectors of the rules."""

import math

import pytest
from pyspark.sql import functions as F

from framesieve.functions import scalar as S
from framesieve.operators import memory, samples, settings, streams


def value(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize("chunk,chunks,head,cleared,expected", [(4, 3, 13, 0, 4), (2, 128, 288, 0, 32), (2, 2, 8, 0, 4), (4, 3, 13, 6, 6), (4, 3, 0, 0, 0)])
def test_oldest_frame(spark, chunk, chunks, head, cleared, expected):
    assert value(spark, S.oldest_frame(head, chunk, chunks, 0, cleared))[0] == expected


def test_oldest_frame_walk(spark):
    """The closed form against a walk over chunks."""
    rows = [(c, n, h) for c in (1, 3, 4) for n in (1, 2, 5) for h in range(40)]
    df = spark.createDataFrame(rows, "c long, n long, h long")
    got = {(r.c, r.n, r.h): r.o for r in df.withColumn("o", S.oldest_frame(F.col("h"), F.col("c"), F.col("n"))).collect()}
    for c, n, h in rows:
        held = sorted({f // c for f in range(h)})[-n:]
        assert got[c, n, h] == (held[0] * c if held else 0)


def test_quantise(spark):
    xs = [0.0, -0.0, 0.5, -0.5, -1.0, 1.0, 2.0, float("inf"), float("-inf"), float("nan"), 0.75, None]
    want = [0, 0, 4194304, -4194304, -8388608, 8388607, 8388607, 8388607, -8388608, 0, 6291455, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x float")
    assert [r.q for r in df.select("i", S.s24(F.col("x")).alias("q")).orderBy("i").collect()] == want
    assert list(value(spark, S.s24_hex(F.lit(4194304)), S.s24_hex(F.lit(-4194304)))) == ["000040", "0000C0"]


@pytest.mark.parametrize("xs,silent", [([0.0, -0.0], True), ([0.0, 1.1754943508222875e-38], False), ([0.0, math.nan], False), ([], True)])
def test_silence(spark, xs, silent):
    df = spark.createDataFrame([(xs,)], "x array<float>")
    assert df.select(S.silent(F.col("x"))).first()[0] is silent


def test_parts_and_names(spark):
    p = spark.range(1).select(S.parts(S.long(5), S.frames_per_part(50, 3)).alias("p")).first().p
    assert [(x.part, x.start_frame, x.frame_count) for x in p] == [(1, 0, 2), (2, 2, 2), (3, 4, 1)]
    assert value(spark, S.part_count(79380000, S.frames_per_part(390000, 3)))[0] > 10
    name = S.detailed_name("take", F.lit("20260818T120000"), F.lit("left"), F.lit(48000), S.long(2), S.long(4), F.lit(2))
    assert value(spark, name)[0] == "take-20260818T120000-left-48000Hz-000000002-000000004-part002.wav"
    assert value(spark, S.channel_name(F.lit(None).cast("string"), F.lit(0)))[0] == "ch01"
    bad = ["../left", "x/../../recording", "", ".", "..", "a\0b", "x/y"]
    df = spark.createDataFrame([(x,) for x in [*bad, "left", "a.wav"]], "x string")
    assert [r[0] for r in df.select(S.safe_name(F.col("x"))).collect()] == [False] * len(bad) + [True, True]


@pytest.mark.parametrize("split,text", [(44, "leave room"), (45, "too small")])
def test_split_errors(spark, split, text):
    with pytest.raises(Exception, match=text):
        value(spark, S.frames_per_part(F.lit(split).cast("bigint"), 3))


def test_saturation_and_texts(spark):
    big = S.long(S.LONG_MAX)
    assert value(spark, S.saturating_sum(big, S.long(1), S.long(1)))[0] == S.LONG_MAX
    assert value(spark, S.loss_text(S.long(1), S.long(0), S.long(3)))[0] == "retention 1, capture-dropped 3"
    assert value(spark, S.outcome_message(F.lit("no_new_audio"), S.long(0), S.long(4)))[0] == "no new audio; warning: 4 frames lost before persistence"
    assert value(spark, S.expand_runtime(F.lit("%t/x"), F.lit("/run/u")))[0] == "/run/u/x"


def test_interleave(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert df.select(samples.interleave(F.col("a"), F.col("b"))).first()[0] == [1, 3, 2, 4]
    with pytest.raises(Exception, match="differ"):
        df.select(samples.interleave(F.col("a"), F.slice("b", 1, 1))).collect()


def test_range_errors(spark):
    frames = spark.range(10).withColumnRenamed("id", "frame")
    assert streams.exact_range(frames, 4, 4, 0, 10).count() == 0
    for a, b in ((5, 2), (1, 9), (3, 11)):
        with pytest.raises(ValueError):
            streams.exact_range(frames, a, b, 2, 10)


def test_gaps(spark):
    for segments in ([(0, 4), (4, 4)], [(2, 3), (9, 1), (20, 30), (25, 2)], [], [(0, 100)], [(3, 40), (10, 2), (60, 1)]):
        df = spark.createDataFrame(segments, "s long, n long") if segments else spark.createDataFrame([], "s long, n long")
        covered = {f for s, n in segments for f in range(s, s + n)}
        got = {f for r in streams.gaps(df, 0, 64, "s", "n", width=8).collect() for f in range(r.gap_start, min(64, r.gap_end))}
        assert got == set(range(64)) - covered, segments


def test_memory_total(spark):
    g = spark.sql("SELECT 10L AS retention, 2L AS channels, 48000L AS rate, 4L AS chunk, 1L AS snapshots, 50L AS split, 3L AS control, 1024L AS stack, 3L AS queue, 4L AS slot_frames, 2048L AS capture_stack, 64L AS io, 128L AS path, 2L AS per_part")
    row = memory.plan(g).first()
    parts = {p["name"]: p["bytes"] for p in row["plan"]}
    assert row["committed"] == 270336 and len(parts) == 22
    assert parts["ring_samples"] == 192 and parts["persistence_workspace"] == 160
    assert memory.required_exact(10, 1.1) == 12
    assert memory.required_exact(2**53 + 1, math.nextafter(1.0, 2)) == 2**53 + 4
    assert memory.required_exact(2**64 - 1, 1.0) == 2**64 - 1
    for h in (0.99, math.nan, math.inf):
        with pytest.raises(ValueError):
            memory.required_exact(1, h)
    assert 1.5e9 < memory.ring_estimate(1800, 44100, 4, 1.25) < 1.7e9


def test_targets(spark):
    nodes = spark.createDataFrame([(1, 0, "Node", "Audio/Sink", "out", "Out"), (2, 1, "Node", "Audio/Source", "out.monitor", "x"), (3, 2, "Device", "Audio/Source", "d", "d"), (4, 3, "Node", "Audio/Source", "mic", "Mic")], "id int, position int, object_type string, media_class string, name string, description string")
    assert [r.ok for r in nodes.select("id", settings.input_source().alias("ok")).orderBy("id").collect()] == [False, False, False, True]
    req = spark.createDataFrame([(1, None), (2, "mic"), (3, "out"), (4, "zz")], "request int, target string")
    got = {r.request: (r.id, r.error) for r in settings.resolve(nodes, req).collect()}
    assert got == {1: (4, None), 2: (4, None), 3: (None, "target out is not an input source"), 4: (None, "target zz not found")}
