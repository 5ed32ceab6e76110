"""Exact removal of repeated passages: windows of 50 words that an earlier document has.

1. Each map task hashes every window of its documents (Rabin-Karp polynomials of two
   bases, modulo 2^64, from prefix sums: all bits of one and the top 8 of the
   other) in flushes of ``FLUSH`` words.  Within a flush a
   window whose hash has a smaller doc_id is settled at once, so that a passage
   of many documents is sent once a flush: the map-side combine.
2. The rest goes to hash buckets as packed arrays: per window 8 bytes of hash
   (the bucket holds the others) and about 2 of position.  A bucket finds the
   smallest doc_id of each hash and answers with the windows of larger ones.
3. The answers, packed by document, meet the texts, which are sent compressed;
   overlapping windows merge into maximal removal intervals.

Two different windows count as equal if their 72 bits of hash agree: expected
for w windows are w^2 / 2^73 such pairs (10^-6 for 10^8 windows, 0.003 for the
5 x 10^9 of some 30 GB).

Edge cases: a null text has no words.  Rows that share a doc_id don't remove
each other's words.  A row without doc_id is kept whole and removes nothing.  An
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm.common import planned_bytes, ship, shuffle_partitions, small_batches, trimmed

WINDOW = 50
FLUSH = 1_200_000
BUCKET = 16 << 20
WORDS = 150_000
#: Powers of the bases at first; they grow with the longest document.
POWERS = 4096
BASE = 0x9E3779B97F4A7C15 | 1
SECOND = 0xC2B2AE3D27D4EB4F | 1

PACKED = "part int, settled boolean, docs binary, signs binary, runs binary, at binary, more binary"


class WordHashes(dict):
    """Word to 64-bit hash; emptied by its user at ``WORDS`` entries."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of like weight together: high ones are mostly zero and compress away."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(b: bytes, kind) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(n, -1).T).reshape(-1).view(kind)


_zip = pa.Codec("zstd")


def _tight(x: np.ndarray) -> bytes:
    """Byte planes, compressed, behind their count of bytes."""
    b = _planes(x)
    return len(b).to_bytes(4, "little") + _zip.compress(b, asbytes=True)


def _from_tight(b: bytes, kind) -> np.ndarray:
    return _from_planes(_zip.decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True), kind)


def _pack(docs: np.ndarray, signs: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Document runs, their signs (which tell rows of one doc_id apart), run lengths, and positions as gaps within a run."""
    first = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (signs[1:] != signs[:-1]))))
    runs = np.diff(np.append(first, len(docs))).astype(np.int32)
    gaps = np.diff(at, prepend=0).astype(np.int32)
    gaps[first] = at[first]
    return _tight(docs[first]), _tight(signs[first]), _tight(runs), _tight(gaps)


def _unpack(docs: bytes, signs: bytes, runs: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, n, g = _from_tight(docs, np.int64), _from_tight(runs, np.int32), _from_tight(gaps, np.int32).astype(np.int64)
    total = np.cumsum(g)
    first = np.cumsum(n) - n
    before = total[first] - g[first]
    return np.repeat(ids, n), np.repeat(_from_tight(signs, np.uint32), n), total - np.repeat(before, n)


def prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def window_hashes(words: np.ndarray, window: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each run of ``window`` consecutive word hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[0][: len(words)], dtype=np.uint64)))
    h = (sums[window:] - sums[:-window]) * powers[1][:n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _flush(ids: list[int], own: list[int], hashes: list[np.ndarray], seconds: list[np.ndarray], buckets: int):
    """Rows for the windows of a flush; empties the lists of hashes.  Windows are told by their positions in the flush, what else is known of them is looked up where it is used."""
    lengths = np.fromiter(map(len, hashes), np.int64, len(hashes))
    if not lengths.sum():
        return
    h, second = np.concatenate(hashes), np.concatenate(seconds)
    hashes.clear()
    seconds.clear()
    docs, signs, starts = np.array(ids, np.int64), np.array(own, np.uint32), np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
    settled = _settled(h, second, docs, row)
    if settled.any():
        i = np.flatnonzero(settled)
        r, at = row[i], i - starts[row[i]]
        start = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1))))
        yield from _answers(docs[r[start]], signs[r[start]], at[start], np.diff(np.append(start, len(r))), buckets)
        del i, r, at, start
    keep = np.flatnonzero(~settled)
    bucket = (h[keep] % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    keep, bucket = keep[order], bucket[order]
    del order
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keep) else [0]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        i = keep[a:b]
        r, rest = row[i], (h[i] // np.uint64(buckets)) | second[i].astype(np.uint64) << np.uint64(56)
        yield int(bucket[a]), False, *_pack(docs[r], signs[r], i - starts[r]), rest.astype("<u8").tobytes()


def _settled(h: np.ndarray, second: np.ndarray, docs: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether the flush has a window's hash in a document of smaller id."""
    order = np.argsort(h, kind="stable")
    x, y = h[order], second[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    del x, y
    d = docs[row[order]]
    least = np.minimum.reduceat(d, first)
    settled = np.zeros(len(h), bool)
    settled[order] = d > np.repeat(least, np.diff(np.append(first, len(h))))
    return settled


def _answers(docs: np.ndarray, signs: np.ndarray, at: np.ndarray, counts: np.ndarray, parts: int):
    """Rows for the documents' parts: runs of windows to remove."""
    part = docs % parts
    order = np.lexsort((at, signs, docs, part))
    part, docs, signs, at, counts = part[order], docs[order], signs[order], at[order], counts[order].astype(np.int32)
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(part[a]), True, *_pack(docs[a:b], signs[a:b], at[a:b]), _tight(counts[a:b])


_COLUMNS = ["part", "settled", "docs", "signs", "runs", "at", "more"]


def _rows(rows) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_COLUMNS)


def _hash_windows(window: int, buckets: int):
    def run(batches):
        powers, other, known = _powers(POWERS), _powers(POWERS, SECOND), WordHashes()
        ids, signs, hashes, seconds, held = [], [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if doc is None or not text:
                    continue
                raw = text.encode()
                words = known.of(raw.split())
                if len(words) > len(powers[0]):
                    n = max(len(words), min(2 * len(powers[0]), FLUSH))
                    powers, other = _powers(n), _powers(n, SECOND)
                found = window_hashes(words, window, powers)
                if not len(found):
                    continue
                if held and held + len(found) > FLUSH:
                    if rows := list(_flush(ids, signs, hashes, seconds, buckets)):
                        yield _rows(rows)
                    ids, signs, hashes, seconds, held = [], [], [], [], 0
                ids.append(doc)
                signs.append(xxhash.xxh32_intdigest(raw))
                hashes.append(found)
                seconds.append((window_hashes(words, window, other) >> np.uint64(56)).astype(np.uint8))
                held += len(found)
        if rows := list(_flush(ids, signs, hashes, seconds, buckets)):
            yield _rows(rows)

    return run


def _judge(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        out, docs, signs, at, keys = [], [], [], [], []
        for row in table.to_pylist():
            if row["settled"]:
                out.append(tuple(row[c] for c in _COLUMNS))
                continue
            d, g, a = _unpack(row["docs"], row["signs"], row["runs"], row["at"])
            docs.append(d)
            signs.append(g)
            at.append(a)
            keys.append(np.frombuffer(row["more"], "<u8"))
        if docs:
            d, g, a, k = (np.concatenate(x) for x in (docs, signs, at, keys))
            order = np.argsort(k, kind="stable")
            d, g, a, k = d[order], g[order], a[order], k[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(k))))
            late = d > least
            if late.any():
                out += _answers(d[late], g[late], a[late], np.ones(int(late.sum()), np.int64), buckets)
        return pa.Table.from_batches([_rows(out)]) if out else _EMPTY

    return run


_EMPTY = pa.table({"part": pa.array([], pa.int32()), "settled": pa.array([], pa.bool_()), **{c: pa.array([], pa.binary()) for c in _COLUMNS[2:]}})


def _squeezed(batches):
    """(id, text) as (id, part's key, compressed text)."""
    for batch in small_batches(batches, 2):
        raw = [None if t is None else t.encode() for t in batch.column(2).to_pylist()]
        body = [None if b is None else len(b).to_bytes(4, "little") + _zip.compress(b, asbytes=True) for b in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.binary())], names=batch.schema.names)


def _loose(body: bytes | None) -> bytes:
    return b"" if body is None else _zip.decompress(body[4:], int.from_bytes(body[:4], "little"), asbytes=True)


def _cut(window: int, id_col: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in right.to_pylist():
            found.append((*_unpack(row["docs"], row["signs"], row["runs"], row["at"]), _from_tight(row["more"], np.int32)))
        d, g, a, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        order = np.argsort(d, kind="stable")
        d, g, a, n = d[order], g[order], a[order], n[order]
        kept, n_words, n_removed, spans = [], [], [], []
        ids = left.column(id_col)
        for doc, text in zip(ids.to_pylist(), left.column("_fs_text"), strict=True):
            raw = _loose(text.as_py())
            words = raw.split()
            lo, hi = (np.searchsorted(d, doc), np.searchsorted(d, doc, "right")) if doc is not None else (0, 0)
            mine = np.arange(lo, hi)
            mine = mine[g[lo:hi] == xxhash.xxh32_intdigest(raw)]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, a[mine], 1)
            np.add.at(change, a[mine] + n[mine] - 1 + window, -1)
            gone = np.cumsum(change)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_removed``, ``removed`` (word intervals), ``kept`` (kept words, one space between)."""
    spark = docs.sparkSession
    ship(spark)
    # So many buckets that what one holds stays small, by partitions and by the table's size.
    buckets = prime_from(max(256, 8 * shuffle_partitions(spark), planned_bytes(docs) // BUCKET))
    texts = docs.select(docs[f"`{id_col}`"].cast("bigint").alias(id_col), docs[f"`{text}`"].alias("_fs_text"))
    windows = texts.mapInArrow(trimmed(_hash_windows(window, buckets)), PACKED)
    answers = windows.groupBy("part").applyInArrow(_judge(buckets), PACKED)
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType())])
    part = F.pmod(F.coalesce(F.col(id_col), F.xxhash64("_fs_text")), F.lit(buckets)).cast("int")
    left = texts.select(id_col, part.alias("part"), "_fs_text").mapInArrow(trimmed(_squeezed), T.StructType([texts.schema[id_col], T.StructField("part", T.IntegerType()), T.StructField("_fs_text", T.BinaryType())]))
    return left.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_cut(window, id_col), schema)
