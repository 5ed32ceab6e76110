"""A capture session over Spark: push, recall, dump, clear, status, one operation at a time.

Pushes go on while a persist runs.  A persist freezes its range under the lock,
writes it without the lock, and commits under the lock again: cursor, losses and
release, never the head.  A range that fails stays frozen and is what the next
persist publishes; it can't be read once it is released.

What is retained is bounded at rest too: blocks behind the oldest frame that the ring, a
frozen range or a snapshot still has are deleted.  ``folder``, ``output`` and their
staging folders have to be on a file system with POSIX renames that the driver and
all executors share; blocks of an earlier session in ``folder`` are removed.
"""

from __future__ import annotations

import contextlib
import os
import queue
import threading
import time
import uuid
from collections import OrderedDict
from concurrent.futures import Future
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from framesieve.errors import Busy, CaptureError, ControlError, ExportError, IndeterminatePublication, ValidationError
from framesieve.functions.scalar import channel_name, detailed_name, long, part_count, simple_name
from framesieve.operators.samples import deinterleave
from framesieve.sources import publish
from framesieve.streaming.replay import Coordinator

CLEARS_KEPT = 16
_BLOCKS = "start_frame long, n_frames long, samples array<float>"


class OperationLane:
    """Bounded FIFO of jobs with one worker; closing cancels what still waits."""

    def __init__(self, capacity: int = 16):
        self.jobs: queue.Queue = queue.Queue(capacity)
        self.closed = False
        self.worker = threading.Thread(target=self._run, daemon=True)
        self.worker.start()

    def submit(self, job, *args) -> Future:
        if self.closed:
            raise Busy("operation queue is busy or shutting down")
        done: Future = Future()
        try:
            self.jobs.put_nowait((done, job, args))
        except queue.Full:
            raise Busy("operation queue is busy or shutting down") from None
        return done

    def _run(self) -> None:
        while True:
            item = self.jobs.get()
            if item is None:
                return
            done, job, args = item
            if self.closed:
                done.set_exception(Busy("shutting down"))
                continue
            try:
                done.set_result(job(*args))
            except Exception as e:  # noqa: BLE001 - it is the caller's
                done.set_exception(e)

    def close(self) -> None:
        """Again and again, at no cost; waits for the job that runs."""
        self.closed = True
        with contextlib.suppress(queue.Empty):
            while True:
                if item := self.jobs.get_nowait():
                    item[0].set_exception(Busy("shutting down"))
        self.jobs.put(None)
        if threading.current_thread() is not self.worker:
            self.worker.join()


class Retained:
    """A range of frames that stays readable until it is released; a context manager."""

    def __init__(self, session: Session, start: int, end: int, done):
        self.session, self.start, self.end, self._done, self.released = session, start, end, done, False

    def frames(self, start: int | None = None, end: int | None = None):
        """(start_frame, frame, channel, sample) of the range, or of a part of it."""
        start, end = self.start if start is None else start, self.end if end is None else end
        if self.released:
            raise ControlError("the range has been released")
        if not self.start <= start <= end <= self.end:
            raise ValidationError(f"range {start}..{end} lies outside {self.start}..{self.end}")
        return self.session._frames(start, end)

    def release(self) -> None:
        if self.released:
            raise ControlError("the range has been released")
        self.released = True
        self._done()

    def __enter__(self) -> Retained:
        return self

    def __exit__(self, *_) -> None:
        if not self.released:
            self.release()


class Session:
    """Frames live as Parquet blocks in ``folder``; outcomes go to ``output``.

    A block holds the pushes of ``block_frames`` frames; a selection reads the blocks that it
    overlaps and no others.  ``prefix`` names recalled files in detail.
    """

    def __init__(
        self, spark: SparkSession, folder: str, output: str, channels: int, rate: int, chunk: int, chunks: int, slots: int = 64, names: list[str] | None = None,
        split: int = 3_900_000_000, snapshots: int = 1, block_frames: int | None = None, prefix: str = "take",
    ):
        if names and len(names) != channels:
            raise ValueError(f"channelMap length {len(names)} must match channels {channels}")
        own = [n or f"ch{i + 1:02d}" for i, n in enumerate(names or [None] * channels)]
        if len(set(own)) != len(own):
            raise ValidationError(f"duplicate channel names {sorted(n for n in set(own) if own.count(n) > 1)}")
        if any("/" in n or "\0" in n for n in own):
            raise ValidationError("a channel name has to be one path component")
        self.spark, self.folder, self.output, self.prefix = spark, Path(folder), Path(output), prefix
        self.channels, self.rate, self.geometry, self.names = channels, rate, (chunk, chunks, slots, chunk), own
        self.per_part = (split - publish.HEADER) // 3
        if self.per_part <= 0:
            raise ValueError("split threshold must leave room for WAV data")
        self.block_frames = max(1, block_frames or rate)
        self.folder.mkdir(parents=True, exist_ok=True)
        for block in self.folder.glob("block-*.parquet"):
            block.unlink()
        self.runtime = uuid.uuid4().hex
        self.state, self.coordinator, self.lane, self.lock = "capturing", Coordinator(), OperationLane(), threading.RLock()
        self.cleared: OrderedDict[str, dict] = OrderedDict()
        self.pins: dict[object, int] = {}
        self.snapshots = threading.BoundedSemaphore(snapshots)
        self.blocks: list[tuple[int, int, Path]] = []
        self.waiting: list[tuple[int, np.ndarray]] = []
        self.published = 0
        self.last_overrun: float | None = None
        self.indeterminate: IndeterminatePublication | None = None
        self.recovered = publish.recover(self._staging())

    @classmethod
    def for_seconds(cls, spark: SparkSession, folder: str, output: str, channels: int, rate: int, seconds: int, chunk: int | None = None, **more) -> Session:
        """With a ring of so many seconds: chunks of a quarter second, unless a size is asked for."""
        chunk = chunk or max(rate * 250 // 1000, 1)
        return cls(spark, folder, output, channels, rate, chunk, max(1, -(-seconds * rate // chunk)), **more)

    def _staging(self) -> Path:
        path = self.folder / ".staging"
        path.mkdir(exist_ok=True)
        return path

    # --- frames -----------------------------------------------------------------------------------

    def push(self, samples) -> dict:
        """Frame-major samples; never waits for a persist."""
        x = np.asarray(samples, np.float32)
        if len(x) % self.channels:
            raise ValueError("samples must be whole frames")
        n = len(x) // self.channels
        with self.lock:
            if self.state != "capturing":
                raise CaptureError("capture is not running")
            before, slots, size = self.coordinator.head, *self.geometry[2:]
            took = min(n, slots * size)
            kept = x[: took * self.channels]
            self.coordinator.step("push", n, False, False, self.geometry)
            loud = np.flatnonzero(kept != 0)
            if len(loud):
                self.coordinator.heard = before + int(loud[-1]) // self.channels + 1
            if took < n:
                self.last_overrun = time.time()
            self.published += -(-took // size)
            if took:
                self.waiting.append((before, kept))
            if self.waiting and self.coordinator.head - self.waiting[0][0] >= self.block_frames:
                self._flush()
                self._expire()
            return {"enqueued": took, "dropped": n - took, "published_sequence": self.published}

    def _flush(self) -> None:
        """Write the pushes that wait as one block; the lock is held."""
        if not self.waiting:
            return
        start, end = self.waiting[0][0], self.coordinator.head
        starts, parts = zip(*self.waiting, strict=True)
        block = pa.table({"start_frame": pa.array(starts, pa.int64()), "n_frames": pa.array([len(p) // self.channels for p in parts], pa.int64()), "samples": pa.array(list(parts), pa.list_(pa.float32()))})
        path = self.folder / f"block-{start:020d}.parquet"
        new = path.with_name(f".{path.name}.new")
        pq.write_table(block, new)
        os.replace(new, path)
        self.blocks.append((start, end, path))
        self.waiting = []

    def _expire(self) -> None:
        """Delete blocks that nothing can read any more; the lock is held."""
        c = self.coordinator
        keep = min([c.oldest(*self.geometry[:2]), *self.pins.values(), *([c.frozen_start] if c.frozen_start >= 0 else [])])
        for _, end, path in self.blocks:
            if end <= keep:
                path.unlink(missing_ok=True)
        self.blocks = [b for b in self.blocks if b[1] > keep]

    def _frames(self, start: int, end: int):
        with self.lock:
            self._flush()
            paths = [str(path) for a, b, path in self.blocks if a < end and b > start]
        blocks = self.spark.read.schema(_BLOCKS).parquet(*paths) if paths else self.spark.createDataFrame([], _BLOCKS)
        blocks = blocks.where((F.col("start_frame") < end) & (F.col("start_frame") + F.col("n_frames") > start))
        return deinterleave(blocks, "start_frame", F.col("start_frame"), self.channels).where((F.col("frame") >= start) & (F.col("frame") < end))

    def snapshot(self, start: int | None = None, end: int | None = None) -> Retained:
        """A retained range, all of it by default; a bounded number of them at a time."""
        with self.lock:
            c = self.coordinator
            oldest = c.oldest(*self.geometry[:2])
            start, end = oldest if start is None else start, c.head if end is None else end
            if start > end or start < oldest or end > c.head:
                raise ValidationError(f"range {start}..{end} is not retained ({oldest}..{c.head})")
            if not self.snapshots.acquire(blocking=False):
                raise Busy("export already active")
            key = object()
            self.pins[key] = start

        def done() -> None:
            with self.lock:
                del self.pins[key]
                self.snapshots.release()
                self._expire()

        return Retained(self, start, end, done)

    def last_frames(self, n: int) -> Retained:
        """The trailing n frames, or what is retained of them."""
        with self.lock:
            return self.snapshot(max(self.coordinator.head - n, self.coordinator.oldest(*self.geometry[:2])))

    def export(self, start: int, end: int, name: str) -> list[str]:
        """A retained range as WAV files of its own, beside cursor and losses: one file a channel and part."""
        with self.snapshot(start, end) as kept:
            return self._write("dump", name, kept.start, kept.end)

    def reset(self) -> None:
        """Forget everything; refused while a snapshot or a failed range is held."""
        with self.lock:
            if self.coordinator.frozen_start >= 0 or self.pins:
                raise Busy("the session is in use")
            for _, _, path in self.blocks:
                path.unlink(missing_ok=True)
            self.blocks, self.waiting = [], []
            self.coordinator, self.published, self.last_overrun = Coordinator(), 0, None
            self.cleared.clear()

    # --- operations -------------------------------------------------------------------------------

    def recall(self, label: str = "recall", timeout: float | None = None) -> dict:
        return self.lane.submit(self._persist, "recall", label).result(timeout)

    def dump(self, label: str, timeout: float | None = None) -> dict:
        return self.lane.submit(self._persist, "dump", label).result(timeout)

    def clear(self, clear_id: str | None = None, timeout: float | None = None) -> dict:
        """A clear of a known id isn't run again: its first report is the answer, once."""
        return self.lane.submit(self._clear, clear_id).result(timeout)

    def _clear(self, clear_id: str | None) -> dict:
        if self.indeterminate:
            raise self.indeterminate
        with self.lock:
            if clear_id in self.cleared:
                return self.cleared.pop(clear_id)
            self.coordinator.step("clear", 0, False, False, self.geometry)
            self._expire()
            report = {"kind": "cleared"}
            if clear_id is not None:
                self.cleared[clear_id] = report
                while len(self.cleared) > CLEARS_KEPT:
                    self.cleared.popitem(last=False)
            return report

    def freeze(self) -> Retained | None:
        """What is new since the cursor, kept until it is released; None if nothing is.  One at a time; ``commit`` moves the cursor."""
        with self.lock:
            if self.coordinator.frozen_start >= 0:
                raise Busy("a frozen range is pending")
            return self._frozen() if self.coordinator.freeze(*self.geometry[:2]) else None

    def _frozen(self) -> Retained:
        c = self.coordinator
        return Retained(self, c.frozen_start, c.frozen_end, self._expire)

    def commit(self, frozen: Retained) -> dict:
        """Outcome of a frozen range that is out; the range is released."""
        with self.lock:
            c = self.coordinator
            if frozen.session is not self:
                raise ControlError("the range is of another session")
            if frozen.released or (c.frozen_start, c.frozen_end) != (frozen.start, frozen.end):
                raise ControlError("the range isn't frozen any more")
            kind, start, end, *lost = c.commit()
            frozen.release()
        return self._outcome(kind, start, end, lost)

    def _outcome(self, kind: str, start: int | None, end: int | None, lost: list[int], files: list[str] | None = None) -> dict:
        frames = 0 if start is None else end - start
        causes = dict(zip(("retention_lost_frames", "cleared_frames", "capture_dropped_frames"), lost, strict=True))
        out = {"kind": kind, "start_frame": start, "end_frame": end, "frames": frames, "duration_seconds": frames / self.rate, "lost_frames": sum(lost), **causes, "files": files or []}
        return out | ({"output_directory": str(Path(files[0]).parent)} if files else {})

    def _persist(self, op: str, label: str) -> dict:
        if self.indeterminate:
            self._settle()
        with self.lock:
            c = self.coordinator
            if c.frozen_start < 0 and not c.freeze(*self.geometry[:2]):
                return self._outcome("no_new_audio", None, None, c._losses(0))
            frozen, silent = self._frozen(), c.frozen_silent
        files = [] if silent else self._published(op, label, frozen)
        # The head, and what was dropped meanwhile, are those of now.
        return self.commit(frozen) | ({"files": files, "output_directory": str(Path(files[0]).parent)} if files else {})

    def _published(self, op: str, label: str, frozen: Retained) -> list[str]:
        """Files of a range; it stays frozen if that fails, and the session waits for recovery if the outcome can't be told."""
        try:
            return self._write(op, label, frozen.start, frozen.end)
        except Exception as e:
            settled = publish.recover(self._staging())
            if settled["pending"] or settled["failed"]:
                self.indeterminate = IndeterminatePublication(e)
                raise self.indeterminate from e
            if settled["complete"]:
                return self._files(op, label, frozen.start, frozen.end)
            raise

    def _settle(self) -> None:
        settled = publish.recover(self._staging())
        if settled["pending"] or settled["failed"]:
            raise self.indeterminate
        self.indeterminate = None

    def _files(self, op: str, label: str, start: int, end: int) -> list[str]:
        where, pattern = (self.output / label, "*.wav") if op == "dump" else (self.output, f"{self.prefix}-{label}-{start:09d}-*.wav")
        return sorted(str(p) for p in where.glob(pattern))

    def _write(self, op: str, label: str, start: int, end: int) -> list[str]:
        # The lane's thread has no active session of its own, and the sink is looked up there.
        self.spark._get_j_spark_session_class(self.spark._jvm).setActiveSession(self.spark._jsparkSession)
        rows = self._frames(start, end)
        named = channel_name(F.get(F.array(*map(F.lit, self.names)), F.col("channel")), F.col("channel"))
        part, first = F.col("part"), (F.col("part").cast("bigint") - 1) * long(self.per_part)
        if op == "dump":
            name = simple_name(named, part, part_count(long(end - start), long(self.per_part)))
        else:
            # The label tells the selection's first frame, so that a retry has the same names and two recalls have different ones.
            last = F.least(first + long(self.per_part), long(end - start))
            name = detailed_name(self.prefix, F.lit(f"{label}-{start:09d}"), named, self.rate, first, last, part)
        pieces = publish.wav_slices(rows, long(start), self.per_part, self.rate, name)
        self.spark.dataSource.register(publish.WavSink)
        write = pieces.write.format(publish.WavSink.name()).option("path", str(self.output)).option("staging", str(self._staging())).option("kind", op)
        (write.option("folder", label) if op == "dump" else write).mode("append").save()
        files = self._files(op, label, start, end)
        if not files:
            raise ExportError("nothing was published")
        return files

    # --- state ------------------------------------------------------------------------------------

    def status(self) -> dict:
        with self.lock:
            c = self.coordinator
            oldest = c.oldest(*self.geometry[:2])
            capacity = self.geometry[0] * self.geometry[1]
            return {
                "state": self.state, "runtime": self.runtime, "head": c.head, "oldest": oldest, "retained_frames": c.head - oldest, "retained_seconds": (c.head - oldest) / self.rate, "capacity_frames": capacity,
                "capacity_seconds": capacity / self.rate, "dropped": c.dropped, "frozen_pending": c.frozen_start >= 0, "active_snapshots": len(self.pins), "last_overrun": self.last_overrun,
                "publication_pending": self.indeterminate is not None, "blocks": len(self.blocks),
            }

    def stop(self) -> dict:
        """Close the gate, let the running operation end; what no persist took is told.  Again: the same."""
        with self.lock:
            self.state = "stopping"
        self.lane.close()
        with self.lock:
            return {"unconsumed_frames": self.coordinator.head - max(self.coordinator.cursor, self.coordinator.oldest(*self.geometry[:2])), "frozen_pending": self.coordinator.frozen_start >= 0}


__all__ = ["Busy", "OperationLane", "Retained", "Session"]
