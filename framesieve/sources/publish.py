"""WAV parts as a transactional sink, and recovery of interrupted transactions.

``wav_parts`` turns frames into whole files, one row each; ``wav_slices`` into ordered
slices of files, for parts of any size.  The data source ``framesieve_wav`` stages
either from the executors and publishes in the driver's commit: a manifest
first, then no-overwrite renames, then its phase "complete".  A run
that stops in between is settled by ``recover``: complete if every final file is
there with the identity recorded for it, else rolled back; what can't be proved
to be ours stays, and the transaction is pending.

Staging and output are folders with POSIX renames that the driver and all executors share.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from framesieve.errors import CleanupError, IndeterminatePublication, UnidentifiedStaging
from framesieve.functions.scalar import HEADER, div, header_hex, long, s24
from framesieve.shipping import ship

VERSION = 1
MANIFEST = "manifest.json"
MANIFEST_BYTES = 64 << 20
#: Frames of a slice: what one task gathers at a time.
SLICE_FRAMES = 1 << 22
# Where a publication can be interrupted; recall's per-file points come once a file.
RECALL_POINTS = (
    "recall_manifest_prepared", "recall_partial_created_before_manifest", "recall_partial_synced", "recall_before_final_rename", "recall_renamed_before_manifest",
    "recall_after_final_rename", "recall_files_synced", "recall_output_synced", "recall_complete_recorded",
)
DUMP_POINTS = ("dump_files_synced", "dump_directory_synced", "dump_manifest_prepared", "dump_after_rename", "dump_parent_synced", "dump_complete_recorded")
FIELDS = {"version", "uid", "transaction_id", "kind", "phase", "staging_root", "output_root", "final_directory", "entries"}
MANIFEST_SCHEMA = (
    "version int, uid long, transaction_id string, kind string, phase struct<state:string,index:int>, "
    "staging_root struct<path:string,identity:struct<device:long,inode:long>>, output_root string, "
    "final_directory struct<path:string,identity:struct<device:long,inode:long>>, "
    "entries array<struct<staged:struct<path:string,identity:struct<device:long,inode:long>>,"
    "partial:struct<path:string,identity:struct<device:long,inode:long>>,final_path:struct<path:string,identity:struct<device:long,inode:long>>>>"
)


def wav_parts(samples: DataFrame, start: Column, per_part: int, rate: int, name: Column, by: str = "channel") -> DataFrame:
    """(channel, part, name, frames, content): whole files of long-form (channel, frame, sample) rows.

    Shuffles by channel and part only; a group is one file, so its size is
    bounded by the split threshold.
    """
    ship(samples.sparkSession)
    rows = samples.select(by, (div(F.col("frame") - start, per_part) + long(1)).cast("int").alias("part"), "frame", s24(F.col("sample")).alias("q"))

    def body(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("frame").to_numpy(), kind="stable")
        q = table.column("q").to_numpy()[order].astype("<i4")
        data = q.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        return pa.table({by: table.column(by)[:1], "part": table.column("part")[:1], "frames": pa.array([len(q)], pa.int64()), "data": pa.array([data], pa.binary())})

    schema = T.StructType([samples.schema[by], T.StructField("part", T.IntegerType()), T.StructField("frames", T.LongType()), T.StructField("data", T.BinaryType())])
    files = rows.groupBy(by, "part").applyInArrow(body, schema)
    return files.select(by, "part", name.alias("name"), "frames", F.concat(F.unhex(header_hex(F.col("frames"), F.lit(rate))), F.col("data")).alias("content"))


def wav_slices(samples: DataFrame, start: Column, per_part: int, rate: int, name: Column, by: str = "channel", size: int = SLICE_FRAMES) -> DataFrame:
    """(name, slice, content): files as ordered slices, the header first (slice 0), each file's rows together and in order.

    ``name`` is an expression of ``by`` and part.  A group has ``size`` frames at most, and a
    writer appends: no task holds a part.
    """
    ship(samples.sparkSession)
    at = F.col("frame") - start
    rows = samples.select(by, (div(at, per_part) + long(1)).cast("int").alias("part"), (div(F.pmod(at, long(per_part)), size) + long(1)).cast("int").alias("slice"), "frame", s24(F.col("sample")).alias("q"))

    def body(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("frame").to_numpy(), kind="stable")
        data = table.column("q").to_numpy()[order].astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        return pa.table({by: table.column(by)[:1], "part": table.column("part")[:1], "slice": table.column("slice")[:1], "content": pa.array([data], pa.binary())})

    schema = T.StructType([samples.schema[by], T.StructField("part", T.IntegerType()), T.StructField("slice", T.IntegerType()), T.StructField("content", T.BinaryType())])
    bodies = rows.groupBy(by, "part", "slice").applyInArrow(body, schema)
    heads = rows.groupBy(by, "part").agg(F.count("*").alias("n")).select(by, "part", F.lit(0).alias("slice"), F.unhex(header_hex(F.col("n"), F.lit(rate))).alias("content"))
    return heads.unionByName(bodies).select(name.alias("name"), "slice", "content").repartition("name").sortWithinPartitions("name", "slice")


def identity(path: str | Path) -> dict | None:
    try:
        s = os.lstat(path)
    except FileNotFoundError:
        return None
    return {"device": s.st_dev, "inode": s.st_ino}


def _sync(path: str | Path) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def write_manifest(path: Path, manifest: dict) -> None:
    """Durably, by rename in the same folder."""
    new = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    fd = os.open(new, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600)
    with os.fdopen(fd, "w") as f:
        json.dump(manifest, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(new, path)
    _sync(path.parent)


def rename_new(source: str | Path, target: str | Path) -> None:
    """Rename that never overwrites: a link fails where the target exists."""
    os.link(source, target, follow_symlinks=False)
    os.unlink(source)


def new_manifest(kind: str, staging: Path, output: Path, names: list[str], final_directory: Path | None = None) -> dict:
    base = final_directory or output
    entry = lambda n: {"staged": {"path": str(staging / n), "identity": identity(staging / n)}, "partial": None, "final_path": {"path": str(base / n), "identity": None}}
    return {
        "version": VERSION, "uid": os.geteuid(), "transaction_id": staging.name, "kind": kind, "phase": {"state": "prepared", "index": None},
        "staging_root": {"path": str(staging), "identity": identity(staging)}, "output_root": str(output),
        "final_directory": {"path": str(final_directory), "identity": None} if final_directory else None, "entries": [entry(n) for n in names],
    }


def _copy_new(source: str, target: str) -> None:
    with open(source, "rb") as a, open(target, "xb") as b:
        while part := a.read(1 << 20):
            b.write(part)


def publish(kind: str, staging: Path, output: Path, names: list[str], folder: str | None = None, checkpoint: Callable[[str, int | None], None] = lambda *_: None) -> list[str]:
    """Publish staged files: flat into ``output`` (recall), or as one new folder of it (dump).

    ``checkpoint`` is called with a name of ``RECALL_POINTS`` or ``DUMP_POINTS``, and the file's index.
    """
    output.mkdir(parents=True, exist_ok=True)
    for n in names:
        _sync(staging / n)
    if kind == "dump":
        checkpoint("dump_files_synced", None)
        _sync(staging)
        checkpoint("dump_directory_synced", None)
        at = staging.parent / f".{staging.name}.manifest.json"
        final = output / (folder or staging.name)
        # Claimed by making it: fails where anything stands, and only our own empty folder is replaced.
        os.mkdir(final)
        m = new_manifest(kind, staging, output, names, final)
        m["final_directory"]["identity"] = identity(final)
        write_manifest(at, m)
        checkpoint("dump_manifest_prepared", None)
        os.rename(staging, final)
        checkpoint("dump_after_rename", None)
        _sync(output)
        checkpoint("dump_parent_synced", None)
        m["final_directory"]["identity"] = identity(final)
    else:
        at = staging / MANIFEST
        m = new_manifest(kind, staging, output, names)
        write_manifest(at, m)
        checkpoint("recall_manifest_prepared", None)
        for i, e in enumerate(m["entries"]):
            m["phase"] = {"state": "publishing", "index": i}
            write_manifest(at, m)
            partial = f"{e['final_path']['path']}.{staging.name}.partial"
            _copy_new(e["staged"]["path"], partial)
            checkpoint("recall_partial_created_before_manifest", i)
            _sync(partial)
            e["partial"] = {"path": partial, "identity": identity(partial)}
            write_manifest(at, m)
            checkpoint("recall_partial_synced", i)
            checkpoint("recall_before_final_rename", i)
            rename_new(partial, e["final_path"]["path"])
            checkpoint("recall_renamed_before_manifest", i)
            e["final_path"]["identity"] = e["partial"]["identity"]
            write_manifest(at, m)
            checkpoint("recall_after_final_rename", i)
        for e in m["entries"]:
            _sync(e["final_path"]["path"])
        checkpoint("recall_files_synced", None)
        _sync(output)
        checkpoint("recall_output_synced", None)
    m["phase"] = {"state": "complete", "index": None}
    write_manifest(at, m)
    checkpoint(f"{kind}_complete_recorded", None)
    _clean(m, at)
    return [e["final_path"]["path"] for e in m["entries"]]


def publish_settled(kind: str, staging: Path, output: Path, names: list[str], folder: str | None = None, checkpoint: Callable[[str, int | None], None] = lambda *_: None) -> list[str]:
    """``publish`` with its outcome: the files, or an error that may be tried again, or ``IndeterminatePublication``.

    A failure is recovered at once.  If that shows all files out, they are published;
    if it leaves nothing behind, the failure is raised; else nobody can tell.
    """
    own = identity(staging)
    try:
        return publish(kind, staging, output, names, folder, checkpoint)
    except Exception as e:
        at = staging.parent / f".{staging.name}.manifest.json" if kind == "dump" else staging / MANIFEST
        if not os.path.lexists(at):
            try:
                discard(staging, own, names)
            except (OSError, UnidentifiedStaging) as cleanup:
                raise CleanupError(e, cleanup) from e
            raise
        outcome = recover_one(at)
        if outcome == "complete":
            base = output / (folder or staging.name) if kind == "dump" else output
            return [str(base / n) for n in names]
        if outcome == "rolled_back":
            raise
        raise IndeterminatePublication(e) from e


def publish_plain(kind: str, staging: Path, output: Path, names: list[str], folder: str | None = None) -> list[str]:
    """Publish without a manifest: renames that never overwrite; what was renamed is taken back if one fails."""
    output.mkdir(parents=True, exist_ok=True)
    if kind == "dump":
        final = output / (folder or staging.name)
        os.mkdir(final)
        os.rename(staging, final)
        return [str(final / n) for n in names]
    done: list[str] = []
    try:
        for n in names:
            partial = str(output / f"{n}.{staging.name}.partial")
            _copy_new(str(staging / n), partial)
            try:
                rename_new(partial, output / n)
            except OSError:
                os.unlink(partial)
                raise
            done.append(str(output / n))
    except OSError:
        for path in done:
            os.unlink(path)
        raise
    for n in names:
        os.unlink(staging / n)
    os.rmdir(staging)
    return done


def discard(staging: Path, own: dict | None, names: list[str]) -> None:
    """Remove a staging folder with what this transaction put there; anything else stays, and is an error."""
    now = identity(staging)
    if now is None:
        return
    if own is None or now != own:
        raise UnidentifiedStaging(str(staging))
    for p in staging.iterdir():
        if (p.name in names or re.fullmatch(r"\.[0-9a-f]{32}", p.name)) and p.is_file() and not p.is_symlink():
            p.unlink()
    try:
        os.rmdir(staging)
    except OSError as e:
        raise UnidentifiedStaging(str(staging)) from e


def _clean(m: dict, at: Path) -> None:
    if m["kind"] == "recall":
        for e in m["entries"]:
            _remove(e["staged"])
    with contextlib.suppress(FileNotFoundError):
        os.unlink(at)
    with contextlib.suppress(FileNotFoundError, OSError):
        if m["kind"] == "recall":
            os.rmdir(m["staging_root"]["path"])


def _remove(artifact: dict | None) -> bool:
    """Remove what is provably ours; True if nothing of ours is left there."""
    if not artifact or not artifact.get("identity"):
        return artifact is None or identity(artifact["path"]) is None
    now = identity(artifact["path"])
    if now == artifact["identity"]:
        os.unlink(artifact["path"])
    return True


def manifest_error(m: dict, at: Path) -> str | None:
    """First broken rule of a manifest."""
    if set(m) != FIELDS:
        return f"fields {sorted(set(m) ^ FIELDS)}"
    if m["version"] != VERSION:
        return f"version {m['version']}"
    if m["uid"] != os.geteuid():
        return f"uid {m['uid']}"
    if m["kind"] not in ("recall", "dump"):
        return f"kind {m['kind']}"
    name = at.parent.name if m["kind"] == "recall" else at.name.removeprefix(".").removesuffix(".manifest.json")
    if m["transaction_id"] != name or Path(name).name != name:
        return "the transaction's id isn't its folder's name"
    if not m["entries"]:
        return "no entry"
    phase = m["phase"]
    if phase["state"] not in ("prepared", "publishing", "complete") or (m["kind"] == "dump" and phase["state"] == "publishing"):
        return f"phase {phase['state']}"
    if phase["state"] == "publishing" and not 0 <= phase["index"] < len(m["entries"]):
        return f"index {phase['index']}"
    staging, output = Path(m["staging_root"]["path"]), Path(m["output_root"])
    finals = [e["final_path"]["path"] for e in m["entries"]]
    for e in m["entries"]:
        base = Path(m["final_directory"]["path"]) if m["kind"] == "dump" else output
        for path, parent in ((e["staged"]["path"], staging), (e["final_path"]["path"], base)):
            if ".." in Path(path).parts or Path(path).parent != parent:
                return f"{path} is outside {parent}"
            if parent.is_symlink() or Path(path).is_symlink():
                return f"{path} is a link"
    if len(set(finals)) != len(finals):
        return "a final path twice"
    own = [tuple(e["staged"]["identity"].values()) for e in m["entries"] if e["staged"]["identity"]]
    if len(set(own)) != len(own):
        return "an identity twice"
    return None


def read_manifest(at: Path) -> dict:
    """Of a regular file of bounded size, never by a link."""
    fd = os.open(at, os.O_RDONLY | os.O_NOFOLLOW)
    with os.fdopen(fd, "rb") as f:
        text = f.read(MANIFEST_BYTES + 1)
    if len(text) > MANIFEST_BYTES:
        raise ValueError(f"a manifest of over {MANIFEST_BYTES} bytes")
    return json.loads(text)


def _settle(at: Path) -> tuple[str, str | None]:
    """Outcome of a transaction, and why it isn't settled."""
    try:
        m = read_manifest(at)
        if error := manifest_error(m, at):
            return "failed", error
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
        return "failed", str(e)
    outcome = _recover_dump(m, at) if m["kind"] == "dump" else _recover_recall(m, at)
    return outcome, "what is there isn't provably ours" if outcome in ("pending", "failed") else None


def recover_one(at: Path) -> str:
    """complete, rolled_back, pending or failed."""
    return _settle(at)[0]


def _recover_recall(m: dict, at: Path) -> str:
    phase = m["phase"]
    for i, e in enumerate(m["entries"]):
        # Renamed, but not yet written down: the partial is gone and was ours.
        if phase["state"] == "publishing" and i == phase["index"] and e["partial"] and not e["final_path"]["identity"] and identity(e["partial"]["path"]) is None:
            e["final_path"]["identity"] = e["partial"]["identity"]
    if all(e["final_path"]["identity"] and identity(e["final_path"]["path"]) == e["final_path"]["identity"] for e in m["entries"]):
        # The manifest goes last: once it is gone, the files have to be durable.
        for e in m["entries"]:
            _sync(e["final_path"]["path"])
        _sync(m["output_root"])
        _clean(m, at)
        return "complete"
    settled = True
    for e in m["entries"]:
        if e["final_path"]["identity"]:
            _remove(e["final_path"])
        unrecorded = f"{e['final_path']['path']}.{m['transaction_id']}.partial"
        if e["partial"] is None and identity(unrecorded):
            settled = False  # a partial file that the manifest doesn't own
        settled &= _remove(e["partial"])
    if not settled:
        return "pending"
    for e in m["entries"]:
        _remove(e["staged"])
    staging = Path(m["staging_root"]["path"])
    if [p for p in staging.iterdir() if p != at]:
        return "pending"
    _clean(m, at)
    return "rolled_back"


def _recover_dump(m: dict, at: Path) -> str:
    final, staging, claimed = Path(m["final_directory"]["path"]), Path(m["staging_root"]["path"]), m["final_directory"]["identity"]
    now = identity(final)
    if now and now == m["staging_root"]["identity"]:
        if not all(identity(e["final_path"]["path"]) == e["staged"]["identity"] for e in m["entries"]):
            return "pending"
        for e in m["entries"]:
            _sync(e["final_path"]["path"])
        _sync(final.parent)
        os.unlink(at)
        return "complete"
    if now and now == claimed:
        try:
            os.rmdir(final)  # the folder that was made to claim the name
        except OSError:
            return "pending"
    elif now:
        return "pending" if identity(staging) else "failed"
    if identity(staging) == m["staging_root"]["identity"]:
        for e in m["entries"]:
            _remove(e["staged"])
        if list(staging.iterdir()):
            return "pending"
        os.rmdir(staging)
    os.unlink(at)
    return "rolled_back"


def manifests(root: Path) -> list[Path]:
    """Manifests of marked transactions under a staging root."""
    return sorted([*root.glob(f"*/{MANIFEST}"), *root.glob(".*.manifest.json")])


OUTCOMES = ("complete", "rolled_back", "pending", "failed")


def recover(root: str | Path) -> dict:
    """Settle every transaction under a staging root; counts by outcome, and ``issues`` (path, outcome, reason)."""
    out = merge_summaries()
    for at in manifests(Path(root)):
        outcome, reason = _settle(at)
        one = {"discovered": 1, outcome: 1, "issues": [{"path": str(at), "outcome": outcome, "reason": reason}] if reason else []}
        out = merge_summaries(out, one)
    return out


def merge_summaries(*summaries: dict) -> dict:
    """Summaries of several roots as one."""
    return {k: sum(s.get(k, 0) for s in summaries) for k in ("discovered", *OUTCOMES)} | {"issues": [i for s in summaries for i in s.get("issues", [])]}


def manifest_table(spark, root: str) -> DataFrame:
    """(path, manifest, unknown): manifests of a folder as rows."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*manifest.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return manifest_rows(files)


def manifest_rows(texts: DataFrame) -> DataFrame:
    """(path, manifest, unknown) of (path, value); from_json ignores unknown keys, so they are listed."""
    unknown = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, sorted(FIELDS))))
    return texts.select("path", F.from_json("value", MANIFEST_SCHEMA).alias("manifest"), unknown.alias("unknown"))


def manifest_rules(table: DataFrame, uid: int) -> DataFrame:
    """One boolean a rule (true: broken), and ``error``, the first broken one's name."""
    m = F.col("manifest")
    rules = {
        "fields": F.size("unknown") > 0,
        "version": m["version"] != VERSION,
        "uid": m["uid"] != uid,
        "kind": ~m["kind"].isin("recall", "dump"),
        "entries": F.coalesce(F.size(m["entries"]), F.lit(0)) == 0,
        "phase": ~m["phase"]["state"].isin("prepared", "publishing", "complete") | ((m["kind"] == "dump") & (m["phase"]["state"] == "publishing")),
        "index": (m["phase"]["state"] == "publishing") & ((m["phase"]["index"] < 0) | (m["phase"]["index"] >= F.size(m["entries"]))),
        "traversal": F.exists(m["entries"], lambda e: e["final_path"]["path"].contains("/../") | e["staged"]["path"].contains("/../")),
        "twice": F.size(F.array_distinct(F.transform(m["entries"], lambda e: e["final_path"]["path"]))) < F.size(m["entries"]),
    }
    out = table.withColumns({k: F.coalesce(v, F.lit(True)) for k, v in rules.items()})
    return out.withColumn("error", F.coalesce(*(F.when(F.col(k), F.lit(k)) for k in rules)))


class _Staged(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WavWriter(DataSourceWriter):
    """Rows (name, content) of whole files, or (name, slice, content), a file's slices together and in order; options: path, staging, kind, folder."""

    def __init__(self, options: dict):
        self.output, self.kind, self.folder = options["path"], options.get("kind", "recall"), options.get("folder")
        root = options.get("staging") or os.path.join(self.output, ".staging")
        self.staging = os.path.join(root, uuid.uuid4().hex)
        os.makedirs(self.staging, mode=0o700)
        self.own = identity(self.staging)

    def write(self, rows) -> _Staged:
        names: list[str] = []
        own: list[tuple[str, dict | None]] = []
        new, f, before = "", None, -1

        def done() -> None:
            if f:
                f.close()
                # A retried task writes its files again: by rename, so that the last one stands whole.
                path = os.path.join(self.staging, names[-1])
                own.append((path, identity(new)))
                os.replace(new, path)

        try:
            for row in rows:
                name, piece = row["name"], row["slice"] if "slice" in row.__fields__ else 0
                if name in ("", ".", "..") or "/" in name or "\0" in name:
                    raise ValueError(f"unsafe file name {name!r}")
                if not piece:
                    done()
                    f = None
                    names.append(name)
                    new = os.path.join(self.staging, f".{uuid.uuid4().hex}")
                    f = open(new, "xb")  # noqa: SIM115 - closed by done()
                elif f is None or name != names[-1] or piece != before + 1:
                    raise ValueError(f"slice {piece} of {name!r} is out of order")
                before = piece
                f.write(bytes(row["content"]))
            done()
        except BaseException:
            if f and not f.closed:
                f.close()
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(new)
            for path, mine in own:
                if identity(path) == mine:  # not what another attempt has put there
                    os.unlink(path)
            raise
        return _Staged(names)

    def commit(self, messages) -> None:
        names = sorted(n for m in messages if m for n in m.names)
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("duplicate file names")
        if not names:
            self.abort(messages)
            return
        publish_settled(self.kind, Path(self.staging), Path(self.output), names, self.folder)

    def abort(self, messages) -> None:
        """Only what tasks of this job staged goes; a task that failed has taken its own files away or left them under their temporary names."""
        known = [n for m in messages if m for n in m.names]
        discard(Path(self.staging), self.own, known)


class WavSink(DataSource):
    """``df.write.format("framesieve_wav").option("path", ...).mode("append").save()``"""

    @classmethod
    def name(cls) -> str:
        return "framesieve_wav"

    def schema(self) -> str:
        return "name string, slice int, content binary"

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(dict(self.options))


def space(frames: int) -> int:
    return HEADER + 3 * frames
