"""The session: operations while capture goes on, retries, bounds at rest; the application and its requests."""

import json
import os
import random
import stat
import threading

import numpy as np
import pytest

from framesieve.__main__ import main
from framesieve.errors import Busy, CaptureError, ConfigError, ControlError, IndeterminatePublication, ValidationError
from framesieve.plans import control
from framesieve.plans.app import App
from framesieve.plans.session import OperationLane, Session
from framesieve.sources import profiles, publish


def opened(spark, tmp_path, channels=1, chunk=4, chunks=4, **more):
    return Session(spark, str(tmp_path / "in"), str(tmp_path / "out"), channels, 100, chunk, chunks, **more)


@pytest.fixture
def light(spark, tmp_path, monkeypatch):
    """A session that notes what it would write."""
    written = []
    monkeypatch.setattr(Session, "_write", lambda self, op, label, start, end: (written.append((start, end)), [f"/x/{label}/{start}"])[1])
    s = opened(spark, tmp_path, chunk=50_000)
    s.written = written
    yield s
    s.stop()


def test_operations(spark, tmp_path):
    s = opened(spark, tmp_path, 2, names=["mic", "gtr"], slots=64)
    assert s.push(np.arange(1, 17) / 32) == {"enqueued": 8, "dropped": 0, "published_sequence": 2}
    first = s.recall()
    assert (first["kind"], first["frames"], len(first["files"])) == ("written", 8, 2)
    assert sorted(map(os.path.basename, first["files"])) == ["take-recall-000000000-gtr-100Hz-000000000-000000008-part001.wav", "take-recall-000000000-mic-100Hz-000000000-000000008-part001.wav"]
    assert s.recall()["kind"] == "no_new_audio"
    s.push(np.zeros(8))
    assert s.dump("d1")["kind"] == "skipped_silent"
    s.push(np.ones(4))
    assert s.dump("d2")["frames"] == 2 and (tmp_path / "out" / "d2" / "mic.wav").exists()
    s.push(np.ones(4))
    with pytest.raises(Exception, match="exist|Exist"):
        s.dump("d2")
    assert s.status()["frozen_pending"]
    s.push(np.ones(8))  # comes after the range that failed, and isn't merged into it
    again = s.dump("d3")
    assert (again["start_frame"], again["end_frame"]) == (14, 16)
    assert (s.dump("d4")["start_frame"], s.status()["head"]) == (16, 20)
    assert s.clear() == {"kind": "cleared"}
    s.push(np.ones(4))
    with s.snapshot(20, 22) as kept:
        assert kept.frames().count() == 4 and kept.frames(21, 22).count() == 2
        with pytest.raises(ValidationError):
            kept.frames(19, 22)
        with pytest.raises(Busy):
            s.snapshot(20, 21)
        with pytest.raises(Busy):
            s.reset()
    with pytest.raises(ControlError, match="released"):
        kept.frames()
    with pytest.raises(ControlError, match="released"):
        kept.release()
    with pytest.raises(ValidationError):
        s.snapshot(3, 22)
    assert s.last_frames(1).start == 21
    s.stop()
    with pytest.raises(Busy):
        s.recall()
    with pytest.raises(CaptureError):
        s.push(np.ones(2))
    assert s.stop() == {"unconsumed_frames": 2, "frozen_pending": False}


def test_reports_of_clears_are_handed_out_once(light):
    for k in range(3):
        light.push(np.ones(4))
        light.clear(f"c{k}")
    light.push(np.ones(3))
    assert [light.clear(f"c{k}")["kind"] for k in range(3)] == ["cleared"] * 3
    assert light.recall()["cleared_frames"] == 12 and light.written == [(12, 15)]
    light.push(np.ones(2))
    light.clear("c0")  # a new one: its report was handed out
    assert light.recall()["cleared_frames"] == 2
    light.reset()
    assert light.status()["head"] == 0


def test_pushes_during_a_persist_are_kept(spark, tmp_path, monkeypatch):
    """What the last round lost: capture goes on while files are written."""
    s = opened(spark, tmp_path)
    monkeypatch.setattr(Session, "_write", lambda self, op, label, start, end: (self.push(np.ones(3)), self.push(np.ones(1000)), [f"/x/{start}"])[2])
    s.push(np.ones(4))
    out = s.recall()
    # Drops during the publication belong to this outcome.
    assert (out["start_frame"], out["end_frame"], out["capture_dropped_frames"]) == (0, 4, 1000 - 256)
    assert s.status()["head"] == 4 + 3 + 256 and s.status()["last_overrun"]
    monkeypatch.setattr(Session, "_write", lambda self, op, label, start, end: [f"/x/{start}"])
    out = s.recall()
    assert (out["start_frame"], out["retention_lost_frames"], out["capture_dropped_frames"]) == (248, 244, 0)
    s.stop()


def test_concurrent_pushes_and_persists(light):
    """100 000 frames one by one against persists: no gap, no overlap, nothing lost."""
    done = threading.Event()

    def capture():
        for _ in range(100_000):
            light.push([1.0])
        done.set()

    light.block_frames = 20_000
    light.geometry = (200_000, 2, 1 << 20, 200_000)
    worker = threading.Thread(target=capture)
    worker.start()
    outcomes = []
    while not done.is_set():
        outcomes.append(light.recall())
    worker.join()
    outcomes.append(light.recall())
    ranges = [(o["start_frame"], o["end_frame"]) for o in outcomes if o["kind"] == "written"]
    assert ranges == light.written and len(ranges) > 3
    assert ranges[0][0] == 0 and ranges[-1][1] == 100_000 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sum(o["lost_frames"] for o in outcomes) == 0


def test_conservation_with_failures(light, monkeypatch):
    """Every frame pushed is written, silent, cleared, lost with a cause, or still there."""
    rng = random.Random(5)
    light.geometry, light.block_frames = (8, 4, 5, 8), 16
    write = Session._write

    def failing(self, op, label, start, end):
        if rng.random() < 0.3:
            raise OSError("no space")
        return write(self, op, label, start, end)

    monkeypatch.setattr(Session, "_write", failing)
    pushed = told = 0
    for _ in range(300):
        kind = rng.choice(["push"] * 4 + ["recall", "clear"])
        if kind == "push":
            n = rng.randrange(0, 60)
            pushed += n
            light.push(np.full(n, rng.choice([0.0, 1.0])))
        elif kind == "clear":
            light.clear()
        else:
            try:
                o = light.recall()
            except OSError:
                assert light.status()["frozen_pending"]
                continue
            told += o["frames"] + o["lost_frames"]
        assert len(light.blocks) <= 12
    while True:
        try:
            o = light.recall()
        except OSError:
            continue
        told += o["frames"] + o["lost_frames"]
        if o["kind"] == "no_new_audio":
            break
    assert told == pushed and light.status()["dropped"] > 0


def test_blocks_are_bounded_at_rest(light, tmp_path):
    light.geometry, light.block_frames = (8, 4, 64, 8), 8
    most = 0
    for _ in range(200):
        light.push(np.ones(8))
        most = max(most, len(list((tmp_path / "in").glob("block-*.parquet"))))
    assert most <= 6
    with light.snapshot() as kept:
        for _ in range(20):
            light.push(np.ones(8))
        assert [r.frame for r in kept.frames().orderBy("frame").collect()] == list(range(kept.start, kept.end))
    assert len(list((tmp_path / "in").glob("block-*.parquet"))) <= 5
    # Several pushes make one block.
    light.block_frames = 64
    light.reset()
    for _ in range(16):
        light.push(np.ones(4))
    assert [b[:2] for b in light.blocks] == [(0, 64)]


def test_frozen_ranges(light):
    light.push(np.ones(5))
    frozen = light.freeze()
    light.push(np.ones(4))
    with pytest.raises(Busy):
        light.freeze()
    assert (frozen.start, frozen.end, frozen.frames().count()) == (0, 5, 5) and light.status()["frozen_pending"]
    with pytest.raises(ValidationError):
        frozen.frames(0, 6)
    assert light.commit(frozen)["end_frame"] == 5
    with pytest.raises(ControlError):
        light.commit(frozen)
    with pytest.raises(ControlError):
        frozen.frames()
    nothing = light.freeze()
    assert (nothing.start, nothing.end) == (5, 9)
    light.clear()  # gives the range up with the rest
    with pytest.raises(ControlError, match="frozen"):
        light.commit(nothing)
    assert light.freeze() is None and light.recall()["cleared_frames"] == 4


def test_indeterminate_publications_block_until_settled(light, monkeypatch):
    outcomes = [publish.merge_summaries({"discovered": 1, "pending": 1})] * 3 + [publish.merge_summaries()] * 5
    monkeypatch.setattr(publish, "recover", lambda root: outcomes.pop(0))
    write = Session._write
    monkeypatch.setattr(Session, "_write", lambda *a: (_ for _ in ()).throw(OSError("power")))
    light.push(np.ones(4))
    with pytest.raises(IndeterminatePublication, match="power"):
        light.recall()
    for operation in (light.clear, light.recall, light.recall):
        with pytest.raises(IndeterminatePublication):
            operation()
    monkeypatch.setattr(Session, "_write", write)
    assert light.status()["publication_pending"] and light.recall()["end_frame"] == 4 and not light.status()["publication_pending"]


def test_exact_silence(light):
    light.geometry = (2, 2, 64, 2)
    light.push([1.0, 1.0, 0.0, 0.0, 0.0, 0.0])  # what sounded is behind the retained range
    assert light.recall()["kind"] == "skipped_silent" and light.written == []


def test_construction(spark, tmp_path):
    with pytest.raises(ValueError, match="must match"):
        opened(spark, tmp_path, 2, names=["a"])
    with pytest.raises(ValidationError, match="duplicate"):
        opened(spark, tmp_path, 2, names=["a", "a"])
    with pytest.raises(ValidationError, match="component"):
        opened(spark, tmp_path, 2, names=["a", "../b"])
    s = Session.for_seconds(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1, 44_100, 5)
    assert s.geometry[:2] == (11_025, 20) and s.export  # whole chunks of a quarter second
    s.push(np.ones(1000))
    assert len(s.export(100, 200, "part")) == 1 and s.status()["head"] == 1000 and s.recall()["start_frame"] == 0
    s.stop()


def test_lane_is_bounded():
    gate, lane = threading.Event(), OperationLane(1)
    running = lane.submit(gate.wait)
    while lane.jobs.qsize():
        pass
    waiting = lane.submit(int)
    with pytest.raises(Busy):
        lane.submit(int)
    closing = threading.Thread(target=lane.close)  # with a full queue
    closing.start()
    with pytest.raises(Busy, match="shutting down"):
        waiting.result(10)
    gate.set()
    closing.join(10)
    assert running.result() and not closing.is_alive()
    lane.close()


# --- the application ----------------------------------------------------------------------------

PROFILE = {"backend": "jack", "clientName": "c", "capture": {"sources": ["system:1", "system:2"]}, "buffer": {"seconds": 2}, "export": {"outputDir": "/takes", "mode": "per-channel", "format": "wav"}}


@pytest.fixture
def app(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Session, "_write", lambda self, op, label, start, end: [f"/takes/{label}/{start}.wav"])
    path = str(tmp_path / "app.toml")
    profiles.save(path, {"daemon": {"startMode": "manual", "activeProfile": " one "}, "profiles": {"one": PROFILE, "bad": {"backend": "alsa"}, "two words": PROFILE | {"backend": "pipewire", "pipewire": {"channelMap": ["l"], "sampleRate": 8000, "target": "7"}}}})
    a = App(spark, path, str(tmp_path / "blocks"))
    yield a
    a.stop()


def test_states(app):
    ask = lambda command, **more: app.handle({"command": command} | more)
    assert app.state == "idle" and app.status()["active_profile"] == "one"
    assert not ask("recall")["ok"] and "capture is not running" in ask("recall")["message"]
    assert ask("start-capture")["message"] == "capturing one" and app.state == "capturing" and app.session.channels == 2
    app.session.push(np.ones(20))
    got = ask("recall")
    assert got["ok"] and got["message"] == "written" and got["persistence_outcome"]["frames"] == 10 and got["status"]["head"] == 10
    assert ask("clear", id="x")["message"] == "cleared" and "persistence_outcome" not in ask("clear")
    assert not ask("recall", runtime="another")["ok"] and ask("dump", runtime=app.session.runtime)["ok"]
    assert "does not exist" in ask("start-capture", profile="none")["message"] and app.state == "capturing"
    assert "backend" in ask("start-capture", profile="bad")["message"]
    assert ask("start-capture", profile="two words", activate=True)["ok"] and app.session.rate == 8000 and app.status()["target"] == "7"
    assert profiles.load_for_change(app.config_path)["daemon"]["activeProfile"] == "two words"
    assert ask("stop-capture")["ok"] and app.state == "idle" and app.session is None
    assert not ask("sing")["ok"] and not json.loads(app.respond("[]"))["ok"] and not json.loads(app.respond("{"))["ok"]
    app.open_session = lambda r: (_ for _ in ()).throw(CaptureError("no device"))
    assert not ask("start-capture")["ok"] and (app.state, app.last_error) == ("faulted", "capture error: no device")
    assert ask("reload")["message"] == "idle"
    app.open_session = lambda r: (_ for _ in ()).throw(KeyError("broken"))
    assert not ask("start-capture")["ok"] and app.state == "poisoned"
    assert not ask("reload")["ok"] and ask("status")["ok"] and ask("stop")["message"] == "stopping" and not ask("recall")["ok"]


def test_reload(app):
    document = profiles.load_for_change(app.config_path)
    document["daemon"]["startMode"] = "auto"
    profiles.save(app.config_path, document)
    assert app.reload() == "capturing"
    before = app.session.runtime
    assert app.reload() == "capturing" and app.session.runtime != before
    app.open_session = lambda r: (_ for _ in ()).throw(CaptureError("gone"))
    assert app.reload() == "faulted" and app.session is None
    document["daemon"]["startMode"] = "later"
    profiles.save(app.config_path, document)
    assert app.reload() == "unconfigured" and "startMode" in app.last_error
    with open(app.config_path, "w") as f:
        f.write("broken = [")
    assert app.reload() == "unconfigured" and "failed to parse" in app.last_error
    os.unlink(app.config_path)
    assert app.reload() == "unconfigured" and "not found" in app.last_error
    profiles.save(app.config_path, {"daemon": {}})
    assert app.reload() == "unconfigured" and app.last_error == "no active profile configured"


def test_profile_changes(tmp_path):
    path, doc = tmp_path / "a" / "p.toml", {}
    profiles.create(doc, "odd \"name\"", "jack")
    for field, value in (("clientName", "cl\\ient"), ("buffer.seconds", "30"), ("export.outputDir", "/o"), ("export.mode", "per-channel"), ("export.format", "wav")):
        profiles.set_field(doc, "odd \"name\"", field, value)
    profiles.add_port(doc, "odd \"name\"", "system:1", "left\ttab")
    profiles.save(path, doc)
    assert profiles.load_for_change(path) == doc
    got = profiles.resolve(doc, "odd \"name\"")
    assert got.ports == (("system:1", "left\ttab"),) and got.seconds == 30 and got.sample_rate == 44_100
    for bad in (lambda: profiles.create(doc, "x", "alsa"), lambda: profiles.create(doc, " ", "jack"), lambda: profiles.set_field(doc, "odd \"name\"", "buffer.seconds", "-1"), lambda: profiles.set_field(doc, "odd \"name\"", "pipewire.target", "1"), lambda: profiles.add_port(doc, "odd \"name\"", " ", "n"), lambda: profiles.set_field(doc, "odd \"name\"", "clientName", "  ")):
        with pytest.raises(ValidationError):
            bad()
    for bad in (lambda: profiles.create(doc, "odd \"name\"", "jack"), lambda: profiles.set_field(doc, "none", "backend", "jack")):
        with pytest.raises(ConfigError):
            bad()
    doc["profiles"]["s"] = PROFILE
    with pytest.raises(ValidationError, match="sources"):
        profiles.add_port(doc, "s", "a", "b")
    changes = [("capture", {"ports": [{"source": "a", "name": "b"}], "sources": ["c"]}), ("capture", {}), ("capture", {"sources": [" "]}), ("capture", {"ports": [{"source": "a"}]}), ("clientName", ""), ("buffer", {}), ("buffer", {"seconds": 0}), ("export", {"outputDir": "o", "mode": "per-channel", "format": "wav"}), ("export", {"outputDir": "/o", "mode": "mixed", "format": "wav"}), ("export", {"outputDir": "/o", "mode": "per-channel"})]
    for key, value in changes:
        with pytest.raises(ValidationError):
            profiles.resolve({"profiles": {"s": PROFILE | {key: value}}}, "s")
    assert profiles.resolve({"profiles": {"s": PROFILE}}, "s").ports == (("system:1", "ch01"), ("system:2", "ch02"))


def test_requests_over_a_socket(app, tmp_path, capsys):
    path = str(tmp_path / "s.sock")
    server = control.Server(path, app.respond)
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert main(["start-capture", "one", "--socket", path]) == 0
    app.session.push(np.ones(8))
    capsys.readouterr()
    assert main(["dump", "--label", "d", "--socket", path]) == 0
    assert capsys.readouterr().out.splitlines() == ["written: 4 frames", "/takes/d/0.wav"]
    app.session.push(np.ones(10))
    app.session.clear()
    assert main(["recall", "--socket", path]) == 0
    assert capsys.readouterr().out == "no new audio; warning: 5 frames lost before persistence (cleared 5)\n"
    assert main(["status", "--json", "--socket", path]) == 0
    assert json.loads(capsys.readouterr().out)["status"]["state"] == "capturing"
    assert control.request(path, "status", 10)["ok"] and main(["stop-capture", "--socket", path]) == 0 and main(["clear", "--socket", path]) == 1
    server.close()
    assert main(["status", "--socket", path]) == 1
    (tmp_path / "file").write_text("x")
    with pytest.raises(ControlError):
        control.Server(str(tmp_path / "file"), app.respond)


def test_profiles_by_command_line(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert main(["config", "create-profile", "one", "jack"]) == 0 and main(["config", "set", "one", "clientName", "me"]) == 0
    assert main(["config", "add-port", "one", "system:1", "left"]) == 0 and main(["config", "create-profile", "one", "jack"]) == 1
    main(["config", "show"])
    assert json.loads(capsys.readouterr().out)["config"]["profiles"]["one"] == {"backend": "jack", "clientName": "me", "capture": {"ports": [{"source": "system:1", "name": "left"}]}}
