"""Word bigram language model with deleted interpolation.

P(w | h) = a_b c(h, w) / c(h) + u_b c(w) / N + z_b / (V + 1), where b is the
bucket of c(h) (by powers of two) and (a, u, z) of each bucket come from
expectation-maximisation on deleted counts: every token of the tuning fold is
held out in turn, i.e. taken off the counts that predict it.

Counting follows the data, not the driver.  Texts are packed once into chunks of
``CHUNK`` bytes (checkpointed, so that a chunk stays the same).  A chunk sends its
distinct word and bigram hashes with their training counts to hash buckets; a
bucket adds them up over all chunks and answers each chunk in the order it asked.
Only N, V and the tuning histogram, which is of a fixed size, reach the driver.

Words count as equal if their 64-bit hashes are (bigrams: 48 bits and the
bucket's).

Edge cases: a null text is one end token; an id of null counts as fold 0, held
out; repeated rows are scored and learned from one by one; if nothing can be
learned from, every token has probability 1 (V = 0); an empty table gives an empty
one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm.common import checkpointed, planned_bytes, ship, shuffle_partitions
from framesieve.llm.substring import WordHashes, _from_planes, _from_tight, _planes, _tight

FOLDS = 10
TUNING = 1
CHUNK = 6_000_000
BUCKET = 8 << 20
END, BEGIN = np.uint64(0xE7D5F0A1B2C3D4E5), np.uint64(0xB3610000C0FFEE11)
BUCKETS = 32  # of context frequency: 0, 1, 2-3, 4-7, ...
BINS = 48  # of log probability, for tuning only
ROUNDS = 60
_WORD, _PAIR = 0, 1


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 10; null ids count as 0."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _packed(limit: int):
    """Chunks (chunk, blob) of some ``limit`` bytes: rows of (id, fold, text) as a compressed Arrow stream; odd chunk numbers hold the tuning fold."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def out(tuning: bool) -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held[tuning])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table.combine_chunks())
            made += 1
            held[tuning], size[tuning] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([(task << 24 | made) << 1 | tuning], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "blob"])

        for batch in batches:
            fold_of = batch.column(1).to_numpy(zero_copy_only=False)
            for tuning in (False, True):
                own = batch.filter(pa.array((fold_of == TUNING) == tuning))
                lengths = pa.compute.binary_length(own.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
                start = 0
                for i, n in enumerate(lengths.tolist()):
                    size[tuning] += n + 1
                    if size[tuning] >= limit:
                        held[tuning].append(own.slice(start, i + 1 - start))
                        start = i + 1
                        yield out(tuning)
                if start < own.num_rows:
                    held[tuning].append(own.slice(start))
        for tuning in (False, True):
            if held[tuning]:
                yield out(tuning)

    return run


def _pairs(before: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) + (words ^ words >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x & ~np.uint64((1 << max(0, 16 - bits)) - 1)


class Tokens:
    """Hashes of a chunk's tokens, document after document."""

    def __init__(self, blob: bytes, bits: int, known: WordHashes):
        self.table = pa.ipc.open_stream(blob).read_all()
        self.ids = self.table.column(0)
        self.fold = self.table.column(1).to_numpy()
        parts, n = [], []
        for text in self.table.column(2):
            words = known.of((text.as_py() or "").encode().lower().split())
            parts += [words, np.array([END], np.uint64)]
            n.append(len(words) + 1)
        self.lengths = np.array(n, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.ends - self.lengths] = BEGIN
        self.kinds = [np.unique(x, return_inverse=True) for x in (self.words, _pairs(before, self.words, bits))]
        self.trained = np.repeat(self.fold != 0, self.lengths)


def _requests(bits: int):
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    low = np.uint64((1 << 64 - bits) - 1)

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = Tokens(blob.as_py(), bits, known)
                rows = []
                for kind, (keys, inverse) in enumerate(t.kinds):
                    counts = np.bincount(inverse, t.trained, len(keys)).astype(np.uint32)
                    # A bucket's keys are sorted: their gaps need fewer bits than they do.
                    rest = (keys & low) >> np.uint64(max(0, 16 - bits) if kind == _PAIR else 0)
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    rows += [(b, chunk, kind, _tight(np.diff(rest[lo:hi], prepend=np.uint64(0))), _tight(counts[lo:hi])) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                names, types = ("bucket", "chunk", "kind", "keys", "counts"), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return run


_ANSWER = "chunk long, bucket int, kind int, totals binary, distinct long, total long"
_zip = pa.Codec("zstd")


def _totals(table: pa.Table) -> pa.Table:
    """Answers of one bucket, and (chunk -1) what its words add to V and N."""
    out = []
    every = table.to_pylist()
    for kind in (_WORD, _PAIR):
        rows = [r for r in every if r["kind"] == kind]
        if not rows:
            continue
        keys = [np.cumsum(_from_tight(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        counts = np.concatenate([_from_tight(r["counts"], np.uint32) for r in rows])
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts, len(found)).astype(np.int64)
        if kind == _WORD:
            out.append((-1, rows[0]["bucket"], kind, b"", int((total > 0).sum()), int(total.sum())))
        at = 0
        for r, k in zip(rows, keys, strict=True):
            own = _planes(total[inverse[at : at + len(k)]])
            at += len(k)
            out.append((r["chunk"], r["bucket"], kind, _zip.compress(own, asbytes=True), len(k), 0))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "bucket", "kind", "totals", "distinct", "total"])


def _counted(left: pa.Table, right: pa.Table, bits: int) -> list[tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, c(w), c(h), c(h, w)) of the chunks of a group (one, as a rule)."""
    answers: dict[tuple[int, int], list] = {}
    for c, b, kind, totals, n in zip(*(right.column(x).to_pylist() for x in ("chunk", "bucket", "kind", "totals", "distinct")), strict=True):
        answers.setdefault((c, kind), []).append((b, totals, n))
    out = []
    for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("blob"), strict=True):
        t, per_token = Tokens(blob.as_py(), bits, WordHashes()), []
        for kind, (keys, inverse) in enumerate(t.kinds):
            totals = [_from_planes(_zip.decompress(x, n * 8, asbytes=True), np.int64) for _, x, n in sorted(answers.get((chunk, kind), []))]
            totals = np.concatenate(totals) if totals else np.zeros(0, np.int64)
            if len(totals) != len(keys):
                raise ValueError(f"chunk {chunk}: {len(totals)} answers to {len(keys)} questions")
            per_token.append(totals[inverse])
        word, pair = per_token
        context = np.empty_like(word)
        context[1:] = word[:-1]
        if len(t.lengths):
            context[t.ends - t.lengths] = word[t.ends[0] - 1]  # texts begin as often as they end
        out.append((t, word, context, pair))
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0))


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for 0, else quarter powers of ten from 1 down."""
    return np.where(p > 0, np.clip(np.round(-4 * np.log10(np.maximum(p, 1e-300))).astype(np.int64), 0, BINS - 2) + 1, 0)


def _value(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 10.0 ** (-(b - 1) / 4), 0.0)


def tune(cells: dict[int, float], vocabulary: int) -> np.ndarray:
    """(a, u, z) of each bucket, from a histogram of (bucket, bigram bin, unigram bin)."""
    uniform = 1.0 / (vocabulary + 1)
    weights = np.tile(np.array([0.0, 0.9, 0.1]), (BUCKETS, 1))
    keys = np.array(sorted(cells), np.int64)
    n = np.array([cells[k] for k in keys.tolist()])
    for b in range(BUCKETS):
        own = keys // (BINS * BINS) == b
        if not own.any():
            if b:
                weights[b] = weights[b - 1]
            continue
        p = np.stack((_value(keys[own] // BINS % BINS), _value(keys[own] % BINS), np.full(own.sum(), uniform)), axis=1)
        w = np.array([0.4 if b else 0.0, 0.4, 0.2])
        w /= w.sum()
        for _ in range(ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[own, None]).sum(axis=0) / n[own].sum()
            w = np.maximum(w, [0.0, 1e-6, 1e-6])
            w /= w.sum()
        weights[b] = w
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    # So many buckets that what one holds stays small, by partitions and by the table's size.
    bits = max(9, (8 * shuffle_partitions(spark) - 1).bit_length(), (planned_bytes(docs) // BUCKET).bit_length())
    rows = docs.select(docs[f"`{id_col}`"], fold(docs[f"`{id_col}`"]).cast("int").alias("_fs_fold"), docs[f"`{text}`"].alias("_fs_text"))
    chunks = checkpointed(rows.mapInArrow(_packed(CHUNK), "chunk long, blob binary"))
    asked = chunks.mapInArrow(_requests(bits), "bucket int, chunk long, kind int, keys binary, counts binary")
    answers = checkpointed(asked.groupBy("bucket").applyInArrow(_totals, _ANSWER))
    v, n = answers.where("chunk = -1").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    answers = answers.where("chunk >= 0")

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros(0, np.int64)
        for _, word, context, pair in _counted(left, right, bits):
            # Deleted counts: without the token that is being predicted.
            cell = (bucket_of(context - 1) * BINS + _bin(_ratio(pair - 1, context - 1))) * BINS + _bin((word - 1) / max(1, n - 1))
            out = np.concatenate((out, cell))
        keys, counts = np.unique(out, return_counts=True)
        return pa.table([pa.array(keys), pa.array(counts.astype(np.int64))], names=["cell", "n"])

    tuning = F.col("chunk").bitwiseAND(F.lit(1).cast("bigint")) == 1
    cells = chunks.where(tuning).groupBy("chunk").cogroup(answers.where(tuning).groupBy("chunk")).applyInArrow(histogram, "cell long, n long")
    # At most BUCKETS x BINS x BINS rows, however large the corpus.
    weights = tune({r["cell"]: float(r["n"]) for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()}, v)
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for t, word, context, pair in _counted(left, right, bits):
            w = weights[bucket_of(context)]
            p = w[:, 0] * _ratio(pair, context) + w[:, 1] * (word / max(1, n)) + w[:, 2] / (v + 1)
            # Without counts for the context its share goes to the others.
            p = np.where(context > 0, p, p / np.maximum(1e-12, 1 - w[:, 0]))
            base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
            first = t.ends - t.lengths
            add = lambda x, first=first: np.add.reduceat(x, first) if len(first) else np.zeros(0)
            tables.append(pa.table([
                t.ids, pa.array(t.fold == 0), pa.array(t.lengths), pa.array(add((word > 0).astype(np.int64)).astype(np.int64)),
                pa.array(np.full(len(first), n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p) if n else np.zeros(len(p)))),
            ], names=schema.names))
        return pa.concat_tables(tables) if tables else pa.Table.from_pylist([], schema=pa.schema([(id_col, pa.null())]))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, schema)
