"""SimHash fingerprints and exact Hamming links through vantage-point shards.

Equal fingerprints collapse first, so copies cost one row each and no pair.

Sharding.  Two fingerprints that differ in at most 3 bits differ in at most 1
bit of one 32-bit half (pigeonhole).  Each half has a vantage-point tree: level
k measures the Hamming distance to a vantage point over bits of its own (a
pseudo-metric, for which the triangle inequality holds), and a branch is the
ring of one distance.  As the levels' bits are disjoint, the differences of ring
numbers add up to at most the distance: pairs within radius 1 lie in one leaf,
or in leaves that differ by one ring at one level.  So each fingerprint goes to
its leaf, and as a visitor to the leaves one ring further out at one level; every other
branch is pruned.  A leaf compares its residents with each other and with its
visitors, exactly, over all 64 bits, and passes on a spanning forest of what it
found instead of all pairs.  Leaves of over ``HOT`` rows are dealt out as pairs
of blocks.

A tree has more levels the more fingerprints there are, of 4, 2 or 1 bit each, so
that leaves stay small; any number of levels finds the same links.

Components are those of fingerprints.  Edge cases: no words give fingerprint 0,
linked like any other.  A null doc_id joins its neighbours like any other row but
names no component (a component without any id is named null); rows that
share a doc_id are members one by one, whatever their texts; an empty table gives
an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm import nearcopies
from framesieve.llm.common import checkpointed, ship, small_batches, trimmed
from framesieve.llm.components import components, forest

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Levels of a tree, by the most fingerprints that they are meant for.
LEVELS = ((20_000_000, 8), (2_000_000_000, 16), (1 << 62, 32))
HOT = 8192
VANTAGE = 0x5DEECE66D1CE4E5B
_CHUNK = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes.lower(): A-Z only; bytes.split(): space and 9-13
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        pairs = zip(starts[i : i + _CHUNK].tolist(), (ends[i : i + _CHUNK] - 1).tolist(), strict=True)
        h = np.array([hash64(joined[a:b], SEED) for a, b in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``id_col`` and ``fp``, the fingerprint's 64 bits as a long."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in small_batches(batches, 1):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])
    return docs.select(docs[f"`{id_col}`"], docs[f"`{text}`"].alias("_fs_text" if text == id_col else text)).mapInArrow(trimmed(run), schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def levels_for(n: int) -> int:
    return next(levels for most, levels in LEVELS if n <= most)


def _leaf(fp: Column, half: int, levels: int) -> list[Column]:
    """Ring numbers of the fingerprint at each level of a half's tree."""
    width = 32 // levels
    away = fp.bitwiseXOR(F.lit(_signed(VANTAGE)))
    return [F.bit_count(F.shiftrightunsigned(away, 32 * half + width * k).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))) for k in range(levels)]


def shards(fps: DataFrame, levels: int) -> DataFrame:
    """(leaf, fp, home): each distinct fingerprint in its leaves and, as a visitor, in the overlapping ones."""
    base, rows = 32 // levels + 1, []
    for half in (0, 1):
        rings = _leaf(F.col("fp"), half, levels)
        own = F.lit(half * base**levels).cast("bigint")
        for k, r in enumerate(rings):
            own = own + r * F.lit(base**k).cast("bigint")
        rows.append(F.struct(own.alias("leaf"), F.lit(True).alias("home")))
        for k, r in enumerate(rings):
            rows.append(F.when(r < base - 1, F.struct((own + F.lit(base**k).cast("bigint")).alias("leaf"), F.lit(False).alias("home"))))
    return fps.select("fp", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("x.leaf", "fp", "x.home")


def _dealt(rows: DataFrame) -> DataFrame:
    """Give each row its shard: the leaf, or for hot leaves one row for each pair of blocks that it meets in."""
    hot = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("leaf", F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    sized = rows.join(hot, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meets = sized.select("leaf", "fp", "home", "blocks", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return meets.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "home")


def close_pairs(fps: np.ndarray, home: np.ndarray, radius: int, block: int = 1024):
    """Index pairs within the radius, one resident at least in each, block by block."""
    n = len(fps)
    for i in range(0, n, block):
        for j in range(i, n, block):
            away = np.bitwise_count(fps[i : i + block, None] ^ fps[None, j : j + block])
            good = (away <= radius) & (home[i : i + block, None] | home[None, j : j + block])
            a, b = np.nonzero(good)
            keep = a + i < b + j
            yield a[keep] + i, b[keep] + j


def _links_of(shard: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int):
    """Links (fp, fp) of whole shards that lie one after another; a forest for each."""
    edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
    sizes = np.diff(edges)
    out_a, out_b = [], []
    small = np.repeat(sizes <= 48, sizes)
    at = np.flatnonzero(small)
    if len(at):
        # Small shards together: each row against the one s places further.
        c, f, h = shard[at], fps[at], home[at]
        for s in range(1, int(sizes[sizes <= 48].max())):
            same = (c[s:] == c[:-s]) & (h[s:] | h[:-s])
            same &= np.bitwise_count(f[s:] ^ f[:-s]) <= radius
            i = np.flatnonzero(same)
            out_a.append(at[i])
            out_b.append(at[i + s])
    for k in np.flatnonzero(sizes > 48):
        lo, hi = edges[k], edges[k + 1]
        for a, b in close_pairs(fps[lo:hi], home[lo:hi], radius):
            # Keep a forest of each block only: links stay linear in the rows.
            nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
            label = forest(index[: len(a)], index[len(a) :], len(nodes))
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            out_a.append(nodes[moved] + lo)
            out_b.append(nodes[label[moved]] + lo)
    if not out_a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = forest(index[: len(a)], index[len(a) :], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return fps[nodes[moved]], fps[nodes[label[moved]]]


def links(fps: DataFrame, radius: int = RADIUS, levels: int | None = None) -> DataFrame:
    """(a, b): fingerprints whose links have the components of all pairs within ``radius`` (3 at most)."""
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3")
    ship(fps.sparkSession)
    dealt = _dealt(shards(fps, levels or levels_for(fps.count())))
    key = ("leaf", "i", "j")
    sorted_rows = dealt.repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        def ready(shard, f, h):
            a, b = _links_of(shard, f, h, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held = None
        for batch in batches:
            leaf, i, j, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            rows = (np.stack((leaf, i.astype(np.int64), j.astype(np.int64)), axis=1), f.view(np.uint64), batch.column(4).to_numpy(zero_copy_only=False))
            held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            k = held[0]
            new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            if len(new):
                cut = new[-1]  # the last shard may go on in the next batch
                number = np.searchsorted(new, np.arange(cut), "right")
                yield ready(number, held[1][:cut], held[2][:cut])
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[1]):
            yield ready(np.zeros(len(held[1]), np.int64), held[1], held[2])

    return sorted_rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: ``id_col``, ``fp``, ``component_id``: the smallest id that links of at most ``radius`` bits reach."""
    fps = checkpointed(fingerprints(docs, id_col, text))
    groups = checkpointed(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    pairs = links(groups.select("fp"), radius).distinct()
    found = components(pairs).withColumnsRenamed({"a": "fp", "b": "low"})
    named = groups.join(found, "fp", "left").select("fp", "rep", F.coalesce("low", "fp").alias("low"))
    least = named.groupBy("low").agg(F.min("rep").alias("component_id"))
    names = named.join(least, "low").select("fp", "component_id")
    return fps.join(names, "fp").select(id_col, "fp", "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less near copies: texts whose 5-word shingles have a similarity of 0.8 or more.

    Candidates come from SimHash fingerprints, as ``near_duplicates``' do, and are verified
    exactly.  64 bits can't decide that: at 0.8 they differ in some 10 bits (up
    to 20), a radius at which vantage-point rings prune nothing.  So fingerprints are
    longer and tables of their bits take the rings' place, see ``nearcopies``;
    ``near_duplicates`` keeps to its 3 bits.
    """
    return nearcopies.without_copies(docs, id_col, text)
