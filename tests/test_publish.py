"""WAV sink: round trip, crash sweep, recovery."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.errors import CleanupError, IndeterminatePublication, UnidentifiedStaging
from framesieve.functions import scalar as S
from framesieve.sources import publish as P
from framesieve.sources import scans


def test_round_trip(spark, tmp_path):
    xs = [[0, -1], [0.5, -0.5], [1, 0.25], [-0.25, 0.75], [0.125, -0.125]]
    rows = [(c, f, float(v)) for f, frame in enumerate(xs) for c, v in enumerate(frame)]
    df = spark.createDataFrame(rows, "channel int, frame long, sample float")
    names = S.simple_name(F.element_at(F.array(F.lit("left"), F.lit("right")), F.col("channel") + 1), F.col("part"), F.lit(3))
    parts = P.wav_parts(df, S.long(0), 2, 48000, names)
    spark.dataSource.register(P.WavSink)
    parts.select("name", "content").write.format("framesieve_wav").option("path", str(tmp_path)).mode("append").save()
    back = {os.path.basename(r.path): r for r in scans.wav_files(spark, str(tmp_path)).collect()}
    assert sorted(back) == sorted(f"{c}-part00{k}.wav" for c in ("left", "right") for k in (1, 2, 3))
    assert back["left-part001.wav"].samples == [0, 4194304] and back["right-part001.wav"].samples == [-8388608, -4194304]
    assert back["left-part003.wav"].data_bytes == 3 and back["left-part001.wav"].sample_rate == 48000
    with pytest.raises(Exception, match="exists|Exists"):
        parts.select("name", "content").write.format("framesieve_wav").option("path", str(tmp_path)).mode("append").save()
    assert len(list(tmp_path.glob("*.wav"))) == 6 and not list((tmp_path / ".staging").glob("*"))


def test_slices_make_the_same_files(spark, tmp_path):
    """Parts of any size: slices of a few frames, appended in order."""
    rng = np.random.default_rng(1)
    rows = [(c, f, float(v)) for c in (0, 1) for f, v in enumerate(rng.uniform(-1, 1, 1000), 50)]
    df = spark.createDataFrame(rows, "channel int, frame long, sample float").repartition(7)
    name = S.simple_name(S.channel_name(F.lit(None).cast("string"), F.col("channel")), F.col("part"), F.lit(3))
    whole = {r.name: bytes(r.content) for r in P.wav_parts(df, S.long(50), 400, 48000, name).collect()}
    pieces = P.wav_slices(df, S.long(50), 400, 48000, name, size=33)
    assert pieces.agg(F.max("slice")).first()[0] == 13
    spark.dataSource.register(P.WavSink)
    pieces.write.format("framesieve_wav").option("path", str(tmp_path)).mode("append").save()
    assert {p.name: p.read_bytes() for p in tmp_path.glob("*.wav")} == whole and len(whole) == 6
    bad = pieces.where("slice <> 2").coalesce(1).sortWithinPartitions("name", "slice")
    with pytest.raises(Exception, match="out of order"):
        bad.write.format("framesieve_wav").option("path", str(tmp_path / "bad")).mode("append").save()
    assert not list((tmp_path / "bad").rglob("*.wav"))


class Stop(Exception):
    pass


def staged(tmp_path, names=("a.wav", "b.wav")):
    staging, out = tmp_path / "s" / "t1", tmp_path / "o"
    staging.mkdir(parents=True)
    for n in names:
        (staging / n).write_bytes(b"x" + n.encode())
    return staging, out


def stop_at(at, index):
    def stop(point, i):
        if (point, i) == (at, index):
            raise Stop

    return stop


# A file that was copied, but not yet written down, isn't provably ours.
PER_FILE = {"recall_partial_created_before_manifest": "pending", "recall_partial_synced": "rolled_back", "recall_before_final_rename": "rolled_back", "recall_renamed_before_manifest": None, "recall_after_final_rename": None}
SWEEP = [
    *(("recall", at, i, want or ("complete" if i else "rolled_back")) for at, want in PER_FILE.items() for i in (0, 1)),
    ("recall", "recall_manifest_prepared", None, "rolled_back"),
    *(("recall", at, None, "complete") for at in ("recall_files_synced", "recall_output_synced", "recall_complete_recorded")),
    ("dump", "dump_manifest_prepared", None, "rolled_back"),
    *(("dump", at, None, "complete") for at in ("dump_after_rename", "dump_parent_synced", "dump_complete_recorded")),
]


def test_the_sweep_has_every_point():
    assert {at for _, at, _, _ in SWEEP} | {"dump_files_synced", "dump_directory_synced"} == {*P.RECALL_POINTS, *P.DUMP_POINTS} and len({*P.RECALL_POINTS, *P.DUMP_POINTS}) == 15


@pytest.mark.parametrize("kind,at,index,outcome", SWEEP)
def test_crash_sweep(tmp_path, kind, at, index, outcome):
    staging, out = staged(tmp_path)
    with pytest.raises(Stop):
        P.publish(kind, staging, out, ["a.wav", "b.wav"], "d", stop_at(at, index))
    found = P.recover(tmp_path / "s")
    assert found[outcome] == found["discovered"] == 1 and bool(found["issues"]) == (outcome == "pending")
    finals = sorted(p.name for p in out.rglob("*.wav"))
    assert finals == (["a.wav", "b.wav"] if outcome == "complete" else [])
    assert P.recover(tmp_path / "s")["discovered"] == (outcome == "pending")
    if outcome == "rolled_back":
        assert not staging.exists() and not list(out.iterdir())


@pytest.mark.parametrize("at", ["dump_files_synced", "dump_directory_synced"])
def test_crash_before_the_manifest(tmp_path, at):
    """Nothing is marked yet: the staging folder is as it was, and no name is claimed."""
    staging, out = staged(tmp_path)
    with pytest.raises(Stop):
        P.publish("dump", staging, out, ["a.wav", "b.wav"], "d", stop_at(at, None))
    assert P.recover(tmp_path / "s")["discovered"] == 0 and sorted(os.listdir(staging)) == ["a.wav", "b.wav"] and not (out / "d").exists()


@pytest.mark.parametrize("kind,at,index,outcome", SWEEP)
def test_publication_outcomes(tmp_path, kind, at, index, outcome):
    """Published, to be tried again, or indeterminate."""
    staging, out = staged(tmp_path)
    run = lambda: P.publish_settled(kind, staging, out, ["a.wav", "b.wav"], "d", stop_at(at, index))
    if outcome == "complete":
        assert sorted(map(os.path.basename, run())) == ["a.wav", "b.wav"]
    else:
        with pytest.raises(IndeterminatePublication if outcome == "pending" else Stop):
            run()
        assert not list(out.rglob("*.wav"))


def test_nothing_is_overwritten(tmp_path):
    staging, out = staged(tmp_path)
    (out / "d").mkdir(parents=True)
    (out / "b.wav").write_bytes(b"theirs")
    with pytest.raises(FileExistsError):
        P.publish_settled("dump", staging, out, ["a.wav", "b.wav"], "d")
    assert not staging.exists() and (out / "d").is_dir()
    staging, _ = staged(tmp_path)
    with pytest.raises(FileExistsError):
        P.publish_settled("recall", staging, out, ["a.wav", "b.wav"])
    assert (out / "b.wav").read_bytes() == b"theirs" and not (out / "a.wav").exists() and not staging.exists()


def test_plain_publishers(tmp_path):
    staging, out = staged(tmp_path)
    assert len(P.publish_plain("recall", staging, out, ["a.wav", "b.wav"])) == 2 and not staging.exists()
    staging, _ = staged(tmp_path, ("b.wav", "c.wav"))
    with pytest.raises(FileExistsError):
        P.publish_plain("recall", staging, out, ["c.wav", "b.wav"])
    assert sorted(os.listdir(out)) == ["a.wav", "b.wav"] and sorted(os.listdir(staging)) == ["b.wav", "c.wav"]
    P.publish_plain("dump", staging, out, ["b.wav", "c.wav"], "d")
    staging, _ = staged(tmp_path)
    with pytest.raises(FileExistsError):
        P.publish_plain("dump", staging, out, ["a.wav"], "d")


def test_unknown_staging_stays(tmp_path):
    staging, _ = staged(tmp_path)
    (staging / "theirs").write_bytes(b"1")
    with pytest.raises(UnidentifiedStaging):
        P.discard(staging, P.identity(staging), ["a.wav", "b.wav"])
    assert os.listdir(staging) == ["theirs"]
    with pytest.raises(UnidentifiedStaging):
        P.discard(staging, {"device": 0, "inode": 0}, ["theirs"])
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "d").mkdir()
    with pytest.raises(CleanupError, match="cleanup also failed"):
        P.publish_settled("dump", staging, tmp_path / "o", [], "d")


def test_links_and_large_manifests_fail(tmp_path, monkeypatch):
    staging, out = staged(tmp_path)
    with pytest.raises(Stop):
        P.publish("recall", staging, out, ["a.wav", "b.wav"], None, stop_at("recall_manifest_prepared", None))
    at = staging / P.MANIFEST
    at.rename(tmp_path / "elsewhere.json")
    at.symlink_to(tmp_path / "elsewhere.json")
    assert P.recover(tmp_path / "s")["failed"] == 1
    at.unlink()
    (tmp_path / "elsewhere.json").rename(at)
    monkeypatch.setattr(P, "MANIFEST_BYTES", 10)
    found = P.recover(tmp_path / "s")
    assert found["failed"] == 1 and "over 10 bytes" in found["issues"][0]["reason"]
    assert P.merge_summaries(found, found)["failed"] == 2 and len(P.merge_summaries(found, found)["issues"]) == 2


def test_foreign_files_stay(tmp_path):
    staging, out = tmp_path / "s" / "t1", tmp_path / "o"
    staging.mkdir(parents=True)
    (staging / "a.wav").write_bytes(b"1")

    with pytest.raises(Stop):
        P.publish("recall", staging, out, ["a.wav"], None, stop_at("recall_manifest_prepared", None))
    (staging / "foreign").write_bytes(b"2")
    assert P.recover(tmp_path / "s")["pending"] == 1
    assert (staging / "foreign").exists()


def test_manifest_rules(spark, tmp_path):
    staging = tmp_path / "s" / "t1"
    staging.mkdir(parents=True)
    (staging / "a.wav").write_bytes(b"1")
    m = P.new_manifest("recall", staging, tmp_path / "o", ["a.wav"])
    cases = {"t1": m, "t2": m | {"version": 2}, "t3": m | {"uid": m["uid"] + 1}, "t4": m | {"extra": 1}, "t5": m | {"entries": []}, "t6": m | {"phase": {"state": "publishing", "index": 99}}}
    for k, x in cases.items():
        (tmp_path / "s" / k).mkdir(exist_ok=True)
        (tmp_path / "s" / k / P.MANIFEST).write_text(json.dumps(x | {"transaction_id": k}))
    rules = P.manifest_rules(P.manifest_table(spark, str(tmp_path / "s")), os.geteuid()).select(F.regexp_extract("path", r"/(t\d)/", 1).alias("t"), "error")
    assert {r.t: r.error for r in rules.collect()} == {"t1": None, "t2": "version", "t3": "uid", "t4": "fields", "t5": "entries", "t6": "index"}
    assert P.recover(tmp_path / "s")["failed"] == 5


def test_scans(spark, tmp_path):
    data = np.array([99, 99, 1, 2, 3, 4, 88, 88], "<f4").tobytes()
    rows = [(1, data, 8, 16, 8, 2), (2, data, 8, 16, 4, 2), (3, data, 8, 999, 8, 2), (4, data, 24, 16, 8, 2), (5, data, 2, 16, 8, 2), (6, data, 0, 8, 0, 0)]
    df = spark.createDataFrame(rows, "id int, data binary, offset int, size int, stride int, channels int")
    got = {r.id: (r.samples, r.error) for r in scans.raw_buffers(df).collect()}
    assert got[1] == ([1, 2, 3, 4], None) and all(got[k][0] is None and got[k][1] for k in range(2, 7))
    sig = [r.samples[0] for r in scans.test_signal(spark, 4000).orderBy("frame").collect()]
    v, want = np.float32(0), []
    for _ in range(4000):
        want.append(float(v))
        v = np.float32(v + np.float32(0.001))
        if v > 1.0:
            v = np.float32(-1.0)
    assert sig == want
    (tmp_path / "x.toml").write_text("not = [valid")
    assert scans.load_toml(str(tmp_path / "none.toml")) == ({}, None)
    assert "failed to parse" in scans.load_toml(str(tmp_path / "x.toml"))[1]
    assert scans.is_runtime_config("configVersion = 1") and not scans.is_runtime_config("startMode = 'manual'")
