"""The coordinator as a stateful stream: outcomes of command logs, micro-batch by micro-batch.

State is a handful of numbers a session (never samples), so it stays small
however long the retention is.  Results equal ``operators.streams.replay``; failed
publications, which windows can't express, are handled here too: a failed range is
kept frozen and is what the next persist publishes.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framesieve.shipping import ship

OUTCOME = "session long, seq long, op string, kind string, start_frame long, end_frame long, frames long, retention_lost long, cleared_lost long, dropped_lost long"
STATE = "head long, dropped long, base long, mark long, cursor long, heard long, pend_retention long, pend_cleared long, acked long, frozen_start long, frozen_end long, frozen_silent long"


@dataclass
class Coordinator:
    """One session's numbers; -1 as frozen_start: nothing is frozen."""

    head: int = 0
    dropped: int = 0
    base: int = 0
    mark: int = 0
    cursor: int = 0
    heard: int = 0
    pend_retention: int = 0
    pend_cleared: int = 0
    acked: int = 0
    frozen_start: int = -1
    frozen_end: int = -1
    frozen_silent: int = 0

    def oldest(self, chunk: int, chunks: int) -> int:
        own = self.head - self.base
        kept = max(0, ((own - 1) // chunk - chunks + 1) * chunk) if own > 0 else 0
        return max(self.base + kept, self.mark)

    def step(self, op: str, n: int, sound: bool, fails: bool, geometry: tuple[int, int, int, int]):
        """Outcome (kind, start, end, retention, cleared, dropped), or None for a push."""
        chunk, chunks, slots, slot_frames = geometry
        if op == "push":
            took = min(n, slots * slot_frames)
            self.head += took
            self.dropped += n - took
            if sound and took:
                self.heard = self.head
            return None
        if op == "clear":
            old = self.oldest(chunk, chunks)
            expected = self.cursor
            if self.frozen_start >= 0:
                # A range that failed to publish is given up with the rest; what was lost before it is still to be told.
                self.pend_retention += self.frozen_start - self.cursor
                self.pend_cleared += self.frozen_end - self.frozen_start
                expected, self.frozen_start = self.frozen_end, -1
            self.pend_retention += max(0, old - expected)
            self.pend_cleared += max(0, self.head - max(expected, old))
            self.mark = self.cursor = self.head
            return ("cleared", None, None, 0, 0, 0)
        if self.frozen_start < 0 and not self.freeze(chunk, chunks):
            return ("no_new_audio", None, None, *self._losses(0))
        if fails and not self.frozen_silent:
            return ("error", self.frozen_start, self.frozen_end, 0, 0, 0)
        return self.commit()

    def freeze(self, chunk: int, chunks: int) -> bool:
        """Keep what is new for a persist and begin another epoch, even if nothing is new; False if nothing is."""
        start = max(self.cursor, self.oldest(chunk, chunks))
        silent, self.base = self.heard <= start, self.head
        if start >= self.head:
            return False
        self.frozen_start, self.frozen_end, self.frozen_silent = start, self.head, int(silent)
        return True

    def commit(self):
        """Outcome of the frozen range; the cursor moves behind it, what came in meanwhile stays, and losses up to now are told."""
        start, end, kind = self.frozen_start, self.frozen_end, "skipped_silent" if self.frozen_silent else "written"
        lost = self._losses(start - self.cursor)
        self.cursor, self.frozen_start = end, -1
        return (kind, start, end, *lost)

    def _losses(self, retention: int) -> tuple[int, int, int]:
        out = (retention + self.pend_retention, self.pend_cleared, self.dropped - self.acked)
        self.pend_retention = self.pend_cleared = 0
        self.acked = self.dropped
        return out


def step_rows(session, rows: pd.DataFrame, c: Coordinator, geometry) -> list[tuple]:
    out = []
    fails = rows["fails"] if "fails" in rows else [False] * len(rows)
    for seq, op, n, sound, bad in zip(rows["seq"].tolist(), rows["op"].tolist(), rows["n_frames"].tolist(), rows["sound"].tolist(), list(fails), strict=True):
        got = c.step(op, int(n), bool(sound), bool(bad), geometry)
        if got:
            kind, start, end, *lost = got
            out.append((session, seq, op, kind, start, end, 0 if start is None else end - start, *lost))
    return out


_NAMES = [x.split()[0] for x in OUTCOME.split(", ")]
_KINDS = [pa.string() if x.split()[1] == "string" else pa.int64() for x in OUTCOME.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({c: "Int64" for c in _NAMES if c not in ("op", "kind")})


def replay_stream(log: DataFrame, chunk: int, chunks: int, slots: int, slot_frames: int) -> DataFrame:
    """Outcomes of a streaming log (session, seq, op, n_frames, sound[, fails]); rows of a session arrive in order of seq, in any split."""
    ship(log.sparkSession)
    geometry = (chunk, chunks, slots, slot_frames)

    def run(key, batches, state: GroupState):
        c = Coordinator(*state.get) if state.exists else Coordinator()
        rows = pd.concat(list(batches)).sort_values("seq")
        out = step_rows(key[0], rows, c, geometry)
        state.update(astuple(c))
        yield _frame(out)

    return log.groupBy("session").applyInPandasWithState(run, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def replay_fold(log: DataFrame, chunk: int, chunks: int, slots: int, slot_frames: int) -> DataFrame:
    """The same as a batch, for logs with failed publications (column ``fails``).

    Sessions stream through their task in order of seq: it holds one batch of
    rows and one session's numbers, however long a session is.
    """
    ship(log.sparkSession)
    geometry = (chunk, chunks, slots, slot_frames)
    columns = ["session", "seq", "op", "n_frames", "sound", "fails"]
    rows = log if "fails" in log.columns else log.withColumn("fails", F.lit(False))
    ordered = rows.select(*columns).repartition("session").sortWithinPartitions("session", "seq")

    def run(batches):
        now, c = object(), Coordinator()
        for batch in batches:
            out = []
            for session, seq, op, n, sound, bad in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if session != now:
                    now, c = session, Coordinator()
                if got := c.step(op, n, bool(sound), bool(bad), geometry):
                    kind, start, end, *lost = got
                    out.append((session, seq, op, kind, start, end, 0 if start is None else end - start, *lost))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * len(_NAMES), _KINDS, strict=True)], names=_NAMES)

    return ordered.mapInArrow(run, OUTCOME)


assert [f.name for f in fields(Coordinator)] == [x.split()[0] for x in STATE.split(", ")]
