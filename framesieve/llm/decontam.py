"""Benchmark decontamination with spaced seeds.

Words are lower-cased runs without ASCII punctuation.  An overlap is a passage of
``WINDOW`` aligned words (all of the item's, if it has fewer) of which ``SIMILARITY``
are equal: 11 of 13, 10 of 12, 8 of 9, 4 of 5; items of one to four words have to
stand there word for word.  A seed mask hashes only some positions of its span, so
that substituted words may fall into its holes; the masks of a length (``masks_for``)
are such that every passage with as many substitutions as the rule allows has a
hit of one of them.  A hit fixes a diagonal, and the words around it are compared.
Overlapping passages of one item in a document merge into one maximal span.

A benchmark of at most ``SLICE_BYTES`` (checked) is joined inside the map task, from a
broadcast.  A larger one is joined by a shuffle: seeds of documents pass a bitmap of
the benchmark's seeds (at most ``BITMAP`` bits, broadcast), meet the items' seeds by hash,
and the candidates are verified after joins with both texts.  Both give the same rows.

Edge cases: null texts and items, and those without words, overlap nothing; repeated
rows and items are judged one by one; a null id is carried like any other; an
empty table on either side gives no overlap.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm.common import checkpointed, ship, small_batches, trimmed
from framesieve.llm.nearcopies import row_id
from framesieve.llm.substring import WordHashes

#: Of 13 words with up to two substitutions; tests/llm shows that each mask alone hits them all.
MASKS = ("11010011", "11001011")
WINDOW = 13
SIMILARITY = 0.8
SLICE_BYTES = 8 << 20
BITMAP = 1 << 29
SEGMENT = 1 << 20
_CELLS = 1 << 20
_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPACES).split()


def least_equal(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


def masks_for(length: int, window: int = WINDOW, similarity: float = SIMILARITY) -> tuple[str, ...]:
    """Masks of an item of so many words.

    With up to s substitutions, one of s + 1 masks that share out the positions has
    none of them; the default window has two denser masks.
    """
    n = min(length, window)
    spare = n - least_equal(n, similarity)
    if (n, spare) == (13, 2):
        return MASKS
    return tuple("".join("1" if i % (spare + 1) == r else "0" for i in range(n)) for r in range(spare + 1))


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Of the words under the mask's ones, at each position of a word-hash array."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int("1" + mask, 2) * int(_MULTIPLIER) % (1 << 64), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out + h[i : i + n]) * _MULTIPLIER
            out ^= out >> np.uint64(29)
    return out


def verified(item: np.ndarray, h: np.ndarray, diagonals: np.ndarray, window: int, similarity: float) -> list[tuple[int, int, int]]:
    """(start, stop, matching) of the item's maximal spans in a document; ``matching`` is the most equal words that one diagonal has there."""
    size = min(len(item), window)
    need, found = least_equal(size, similarity), []
    at = np.arange(len(item))
    step = max(1, _CELLS // len(item))
    for k in range(0, len(diagonals), step):
        d = diagonals[k : k + step]
        where = d[:, None] + at
        inside = (where >= 0) & (where < len(h))
        same = inside & (h[np.clip(where, 0, len(h) - 1)] == item)
        total, whole = (np.concatenate((np.zeros((len(d), 1), np.int64), np.cumsum(x, axis=1)), axis=1) for x in (same, inside))
        good = (total[:, size:] - total[:, :-size] >= need) & (whole[:, size:] - whole[:, :-size] == size)
        rows = np.flatnonzero(good.any(axis=1))
        first = good[rows].argmax(axis=1)
        last = good.shape[1] - 1 - good[rows][:, ::-1].argmax(axis=1) + size
        found.append(np.stack((d[rows] + first, d[rows] + last, total[rows, last] - total[rows, first]), axis=1))
    spans: list[list[int]] = []
    for start, stop, equal in sorted(np.concatenate(found).tolist()) if found else []:
        if spans and start < spans[-1][1]:
            spans[-1][1], spans[-1][2] = max(spans[-1][1], stop), max(spans[-1][2], equal)
        else:
            spans.append([start, stop, equal])
    return [tuple(x) for x in spans]


class Items:
    """Test items: word hashes, and seeds sorted by hash for each mask."""

    def __init__(self, rows: list[tuple[int, str]], window: int, similarity: float):
        known, self.window, self.similarity = WordHashes(), window, similarity
        words = [(i, known.of(words_of(t))) for i, t in rows]
        self.ids, self.words = [i for i, w in words if len(w)], [w for _, w in words if len(w)]
        by_mask: dict[str, list] = {}
        for k, w in enumerate(self.words):
            for mask in masks_for(len(w), window, similarity):
                s = seed_hashes(w, mask)
                by_mask.setdefault(mask, []).append((s, np.full(len(s), k), np.arange(len(s))))
        self.seeds = []
        for mask, parts in by_mask.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << 22, bool)
            maybe[h >> np.uint64(42)] = True
            self.seeds.append((mask, h[order], item[order], at[order], maybe))

    def overlaps(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item index, start, stop, matching words) of each verified span, sorted."""
        found = np.zeros((0, 2), np.int64)
        for mask, keys, item, at, maybe in self.seeds:
            s = seed_hashes(h, mask)
            p = np.flatnonzero(maybe[s >> np.uint64(42)])
            lo, hi = np.searchsorted(keys, s[p]), np.searchsorted(keys, s[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(n)
            # Positions by so many candidates at a time.
            cuts = np.unique(np.concatenate(([0, len(n)], np.searchsorted(ends, np.arange(_CELLS, ends[-1], _CELLS))))) if len(n) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                first = np.repeat(lo[a:b] - (ends[a:b] - n[a:b]), n[a:b]) + np.arange(ends[a] - n[a], ends[b - 1])
                pairs = np.stack((item[first], np.repeat(p[a:b], n[a:b]) - at[first]), axis=1)
                found = np.unique(np.concatenate((found, pairs)), axis=0)
        out = []
        edges = np.flatnonzero(np.concatenate(([True], found[1:, 0] != found[:-1, 0], [True]))) if len(found) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = int(found[a, 0])
            out += [(k, *x) for x in verified(self.words[k], h, found[a:b, 1], self.window, self.similarity)]
        return sorted(out, key=lambda x: (x[1], x[0]))


def _plain(benchmark: DataFrame, id_col: str, text: str) -> DataFrame:
    return benchmark.select(benchmark[f"`{id_col}`"].alias("item_id"), benchmark[f"`{text}`"].alias("item")).where("item is not null")


def _small(items: DataFrame) -> list[tuple[int, str]] | None:
    """All items, if they are few enough to be broadcast."""
    size = items.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0
    return [tuple(r) for r in items.collect()] if size <= SLICE_BYTES else None


def _schema(docs: DataFrame, id_col: str, items: DataFrame) -> T.StructType:
    return T.StructType([docs.schema[id_col], T.StructField("item_id", items.schema["item_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "stop", "matching"))])


def _seeds(known: WordHashes, text: str | None, masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and (seed, position) under all masks."""
    h = known.of(words_of(text))
    s = [seed_hashes(h, m) for m in masks(len(h))] if len(h) else []
    return h, np.concatenate(s) if s else np.zeros(0, np.uint64), np.concatenate([np.arange(len(x)) for x in s]) if s else np.zeros(0, np.int64)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bits of all seeds; its size is fixed by ``bits``, not by the seeds."""
    size = min(SEGMENT, bits) // 8

    def partial(batches):
        every = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            bit = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(every, bit >> np.uint64(3), np.uint8(128) >> (bit & np.uint64(7)).astype(np.uint8))
        used = np.flatnonzero(every.reshape(-1, size).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([every[k * size : (k + 1) * size].tobytes() for k in used], pa.binary())], names=["segment", "bits"])

    def either(table: pa.Table) -> pa.Table:
        rows = table.column("bits").to_pylist()
        out = np.frombuffer(rows[0], np.uint8).copy()
        for r in rows[1:]:
            out |= np.frombuffer(r, np.uint8)
        return pa.table([table.column("segment").slice(0, 1), pa.array([out.tobytes()], pa.binary())], names=["segment", "bits"])

    found = seeds.select("seed").coalesce(64).mapInArrow(partial, "segment int, bits binary").groupBy("segment").applyInArrow(either, "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in found.toLocalIterator():
        out[r["segment"] * size :][:size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _joined(texts: DataFrame, items: DataFrame, window: int, similarity: float) -> DataFrame:
    """(row, item_id, start, stop, matching) for a benchmark of any size; ``texts`` is (row, text)."""
    spark = texts.sparkSession
    items = checkpointed(items.withColumn("n", F.monotonically_increasing_id()))

    def of_items(batches):
        known = WordHashes()
        for batch in batches:
            found = [_seeds(known, t, lambda k: masks_for(k, window, similarity)) for t in batch.column(1).to_pylist()]
            n = pa.array(np.repeat(np.arange(len(found)), [len(s) for _, s, _ in found]))
            size = np.array([min(len(h), window) for h, _, _ in found], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for _, s, _ in found]).view(np.int64)), batch.column(0).take(n), pa.array(np.concatenate([x for _, _, x in found])), pa.array(size).take(n)], names=["seed", "n", "at", "size"])

    own = checkpointed(items.select("n", "item").mapInArrow(of_items, "seed long, n long, at long, size long"))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # at most ``window`` of them
    every = tuple(dict.fromkeys(m for k in sizes for m in masks_for(k, window, similarity)))
    bits = min(BITMAP, 1 << max(16, (8 * own.count()).bit_length()))
    held = spark.sparkContext.broadcast(_bitmap(own, bits))
    row = texts.schema["row"]

    def of_texts(batches):
        known = WordHashes()
        for batch in batches:
            rows, seeds, places = [], [], []
            for k, text in enumerate(batch.column(1)):
                _, s, at = _seeds(known, text.as_py(), lambda n: every)
                bit = s & np.uint64(bits - 1)
                keep = np.flatnonzero(held.value[bit >> np.uint64(3)] & (np.uint8(128) >> (bit & np.uint64(7)).astype(np.uint8)))
                rows.append(np.full(len(keep), k))
                seeds.append(s[keep])
                places.append(at[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(places))], names=["row", "seed", "p"])

    hits = texts.mapInArrow(of_texts, T.StructType([row, T.StructField("seed", T.LongType()), T.StructField("p", T.LongType())]))
    pairs = checkpointed(hits.join(own, "seed").groupBy("row", "n").agg(F.collect_set(F.col("p") - F.col("at")).alias("diagonals")))
    wanted = texts.join(pairs.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    both = pairs.join(items, "n").select("row", "item_id", "item", "diagonals").join(wanted, "row")
    kind = T.StructType([row, T.StructField("item_id", items.schema["item_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "stop", "matching"))])

    def judged(batches):
        known = WordHashes()
        for batch in batches:
            of, out = [], []
            for k, (item, d, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True)):
                spans = verified(known.of(words_of(item)), known.of(words_of(text.as_py())), np.unique(d.values.to_numpy()), window, similarity)
                of += [k] * len(spans)
                out += spans
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array([x[c] for x in out], pa.int64()) for c in range(3))], names=kind.names)

    return both.select("row", "item_id", "item", "diagonals", "text").mapInArrow(judged, kind)


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(row_id(id_col, text).alias("row"), F.col(f"`{text}`").alias("text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """One row per maximal span of an item in a document: ``id_col``, ``item_id``, start, stop (words of the document), matching."""
    spark = docs.sparkSession
    ship(spark)
    items = _plain(benchmark, item_id, item_text)
    schema = _schema(docs, id_col, items)
    rows = _small(items)
    if rows is None:
        every = _keyed(docs, id_col, text)
        found = _joined(every, items, window, similarity)
        # Repeated rows have the same overlaps each.
        again = every.groupBy("row").agg(F.count("*").alias("m"))
        return found.join(again, "row").withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m")))).select(F.col("row.id").alias(id_col), *schema.names[1:])
    held = spark.sparkContext.broadcast(rows)

    def run(batches):
        found_in, known = Items(held.value, window, similarity), WordHashes()
        kind = pa.array([i for i, _ in held.value]).type if held.value else pa.int64()
        for batch in small_batches(batches, 1):
            found = [found_in.overlaps(known.of(words_of(t))) for t in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [x for f in found for x in f]
            columns = [pa.array([found_in.ids[x[0]] for x in flat], kind), *(pa.array([x[c] for x in flat], pa.int64()) for c in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], names=schema.names)

    return docs.select(docs[f"`{id_col}`"], docs[f"`{text}`"].alias("_fs_text")).mapInArrow(trimmed(run), schema)


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that have no overlap; no shuffle if the benchmark is small."""
    spark = docs.sparkSession
    ship(spark)
    items = _plain(benchmark, item_id, item_text)
    rows = _small(items)
    if rows is None:
        gone = _joined(_keyed(docs, id_col, text), items, window, similarity).select(F.col("row").alias("_fs_row")).distinct()
        kept = docs.withColumn("_fs_row", row_id(id_col, text)).join(gone, "_fs_row", "left_anti")
        return kept.select(*(f"`{c}`" for c in docs.columns))
    at = docs.columns.index(text)
    held = spark.sparkContext.broadcast(rows)

    def run(batches):
        found_in, known = Items(held.value, window, similarity), WordHashes()
        for batch in small_batches(batches, at):
            yield batch.filter(pa.array([not found_in.overlaps(known.of(words_of(t))) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
