"""Near copies by SimHash tables, each link verified by exact Jaccard similarity.

A text's shingles are its runs of ``SHINGLE`` words (all of its words, if they
are fewer).  Texts of equal shingle sets collapse first and make no pairs.

Search.  A set's fingerprint has 64 x ``WORDS`` bits; each is the majority of one bit of
all its shingles' hashes.  Two sets of similarity s differ in a share of bits that
grows with their angle: 0.15 at s = 0.8, 0.19 at most (4 shingles of 5), 0.5 if they have
nothing in common.  No radius in 64 bits tells 0.8 and prunes, so there are tables
instead of rings: each takes some bits of the fingerprint, and sets that agree in them share its bucket.
``TABLES`` has their number for a table's size; of the pairs at 0.8 a share of 2e-6 meets in
none (of 4 shingles and 5: 2e-4 to 5e-3).  Within a bucket, the distance over
``CHECKED`` words that no table takes, at most ``FAR`` bits, joins sets to families,
components over all buckets; only families of two or more go on.  Buckets of over ``HOT``
rows are dealt out as pairs of blocks.

No family emits its pairs.  Its smallest row is its leader, and every other row is
verified against the leader alone, over whole shingle sets: one candidate a row
at all.  That joins most of a family of copies, whatever its size.  What it can't
tell is whether two rows are close that both differ from the leader: families with such rows go on, by family and class of size
(sets of similarity s have sizes within s), to shards that compare blocks with
blocks in memory and pass on a spanning forest.  So all pairs of a family that
could still join two groups are compared; shards of over ``BLOCK`` shingles or ``BLOCK_ROWS``
rows are dealt out as pairs of blocks.

Rows are told apart by id and a hash of the text, shingle sets by 64 bits of hash.

Edge cases: a row without id or words belongs to no group and stays; of rows that
are equal in id and text one stays, if any does.  Empty tables give empty ones.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm.common import checkpointed, ship, small_batches, trimmed
from framesieve.llm.components import components, forest
from framesieve.llm.substring import WordHashes

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint; the first few measure distances, the others deal to buckets.
WORDS = 16
CHECKED = 3
FAR = 60
#: Bits of a table and number of tables, by the most rows that they are meant for.
TABLES = ((1 << 18, 10, 64), (1 << 22, 13, 104), (1 << 26, 16, 176), (1 << 62, 20, 340))
HOT = 1 << 16
#: A table of at most so many row names is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, WORDS, np.uint64)
_SAMPLE = 16
_CHUNK = 256
#: Shingles that a block of a shard holds on average, and columns that a comparison takes at a time.
BLOCK = 1 << 20
#: Rows of a block on average: a comparison holds numbers for each pair of rows of two blocks.
BLOCK_ROWS = 768
_COLUMNS = 1024


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of the text's distinct shingles, in order."""
    h = known.of((text or "").encode().lower().split())
    k = min(SHINGLE, len(h))
    if not k:
        return h
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mixed(out + h[i : i + len(out)])
    return np.unique(out)


def fingerprint(s: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles: a bit is 1 if it is in over half the hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(s), 255):  # a byte counts to 255
        h = s[i : i + 255, None] ^ _SEEDS
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
        h ^= h >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(s), bitorder="little").view(np.uint64)


def tables_for(n: int) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    return next((bits, tables) for most, bits, tables in TABLES if n <= most)


@lru_cache
def _places(bits: int, tables: int) -> np.ndarray:
    """The bits of each table; none serves twice until all have served."""
    rng, free = np.random.default_rng(43), 64 * (WORDS - CHECKED)
    turns = [rng.permutation(free) for _ in range(-(-bits * tables // free))]
    return np.concatenate(turns)[: bits * tables].reshape(tables, bits)


def buckets(f: np.ndarray, bits: int = TABLES[0][1], tables: int = TABLES[0][2]) -> np.ndarray:
    """One bucket number a table for a fingerprint."""
    taken = np.unpackbits(f[CHECKED:].view(np.uint8), bitorder="little")[_places(bits, tables)]
    return (np.arange(tables, dtype=np.uint64) << np.uint64(bits)) + taken @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))


def row_id(id_col: str, text: str) -> Column:
    return F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("sig"))


def _arrow(rows: DataFrame, kind: str, values) -> DataFrame:
    """``rows`` (row, text) as (row, *kind); ``values`` of each text's shingles, None for no row."""
    ship(rows.sparkSession)
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(kind).fields])
    types = [pa.binary() if f.dataType == T.BinaryType() else pa.list_(pa.int64()) for f in schema.fields[1:]]

    def run(batches):
        known = WordHashes()
        for batch in small_batches(batches, 1):
            found = [values(s) if len(s := shingles(t, known)) else None for t in batch.column(1).to_pylist()]
            kept = [i for i, x in enumerate(found) if x is not None]
            columns = [pa.array([found[i][c] for i in kept], k) for c, k in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *columns], names=schema.names)

    return rows.mapInArrow(trimmed(run), schema)


def _small(names: DataFrame) -> DataFrame:
    """A checkpointed table of row names, to be broadcast if it is small."""
    return F.broadcast(names) if names.count() <= BROADCAST_ROWS else names


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, shingles) of the wanted rows, once each, checkpointed."""
    texts = rows.join(_small(wanted), "row", "left_semi").dropDuplicates(["row"])
    return checkpointed(_arrow(texts.select("row", "text"), "shingles array<long>", lambda s: (s.view(np.int64),)))


def _enough(shared: Column, a: Column, b: Column, similarity: float) -> Column:
    return shared >= F.lit(similarity) * (a + b - shared) - 1e-9


def _dealt(groups: DataFrame, n: int) -> DataFrame:
    """(shard, node, f0, ...): fingerprints in the buckets of all tables; a hot one is dealt out as pairs of blocks."""
    bits, tables = tables_for(n)
    find = buckets if (bits, tables) == TABLES[0][1:] else partial(buckets, bits=bits, tables=tables)
    names = ["bucket", "node", *(f"f{k}" for k in range(CHECKED))]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                node = part.column(0).to_numpy()
                prints = part.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
                found = [find(f) for f in prints]
                times = np.fromiter(map(len, found), np.int64, len(found))
                columns = [np.concatenate(found).view(np.int64), np.repeat(node, times)]
                columns += [np.repeat(prints[:, k], times).view(np.int64) for k in range(CHECKED)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    kind = ", ".join(f"{c} long" for c in names)
    rows = groups.select("node", "print").mapInArrow(trimmed(run), kind)
    if n <= HOT:
        return rows.withColumnRenamed("bucket", "shard")
    # A sixteenth of the rows says which buckets are hot; the split changes no link.
    some = groups.where(F.pmod("node", F.lit(_SAMPLE)) == 0).select("node", "print").mapInArrow(trimmed(run), kind)
    hot = some.groupBy("bucket").agg((F.count("*") * _SAMPLE).alias("m")).where(F.col("m") > HOT)
    hot = checkpointed(hot.select("bucket", F.ceil(F.col("m") / HOT).cast("int").alias("blocks")))
    if hot.isEmpty():
        return rows.withColumnRenamed("bucket", "shard")
    sized = rows.join(F.broadcast(hot), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shard = F.when(F.col("blocks") > 1, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("bucket"))
    return meets.select(shard.alias("shard"), *names[1:])


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the fingerprints a (rows) and b (columns) over the checked words."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, CHECKED):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def family_of(prints: np.ndarray, small: int = 768, step: int = 256) -> np.ndarray:
    """A number for each fingerprint, equal for those that chains of near ones join.

    A large bucket is peeled family by family, so that a family costs its rows times
    those outside it.
    """
    out, rest = np.arange(len(prints)), np.arange(len(prints))
    while len(rest) > small:
        near = _away(prints[rest[:1]], prints[rest])[0] <= FAR
        family, rest = [rest[near]], rest[~near]
        for new in family:  # grows while it is read
            for i in range(0, len(new), step):
                if not len(rest):
                    break
                near = (_away(prints[new[i : i + step]], prints[rest]) <= FAR).any(axis=0)
                if near.any():
                    family.append(rest[near])
                    rest = rest[~near]
        for part in family:
            out[part] = family[0][0]
    if len(rest):
        a, b = np.nonzero(np.triu(_away(prints[rest], prints[rest]) <= FAR, 1))
        if len(a):
            out[rest] = rest[forest(a, b, len(rest))]
    return out


def families(groups: DataFrame, n: int) -> DataFrame:
    """(family, node): ``groups`` (node, print) that chains of near ones in the same bucket join, families of at least two."""
    ordered = _dealt(groups, n).repartition("shard").sortWithinPartitions("shard")

    def joined(node, prints, edges):
        pairs = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                # In the nodes' order, so that a family's first is its least and the same in many buckets.
                at = lo + np.argsort(node[lo:hi])
                family = family_of(prints[at])
                moved = np.flatnonzero(family != np.arange(hi - lo))
                if len(moved):
                    pairs.append((node[at[moved]], node[at[family[moved]]]))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs, strict=True)], names=["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            shard, *rest = (batch.column(c).to_numpy() for c in range(2 + CHECKED))
            new = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            if held and len(shard) and held[-1][0][-1] != shard[0]:
                new = np.concatenate(([0], new))
            held.append((shard, rest[0], np.stack(rest[1:], axis=1).view(np.uint64)))
            if len(new):  # the last shard may go on in the next batch
                last = int(new[-1])
                tail = tuple(x[last:] for x in held[-1])
                held[-1] = tuple(x[:last] for x in held[-1])
                shard, node, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
                yield from joined(node, prints, edges)
                held = [tail]
        if held:
            shard, node, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from joined(node, prints, [0, len(node)])

    # A node has one link a bucket at most: all but its least end are joined to that instead, which most nodes do alike.
    ends = ordered.mapInArrow(trimmed(run), "a long, b long").groupBy("a").agg(F.collect_set("b").alias("b"))
    least = F.array_min("b")
    near = ends.select(least.alias("b"), F.explode(F.concat(F.array("a"), F.array_except("b", F.array(least)))).alias("a"))
    found = components(near.select("a", "b").distinct())
    return found.select(F.col("b").alias("family"), F.col("a").alias("node")).union(found.select("b", "b").distinct())


def links(rows: DataFrame, groups: DataFrame, similarity: float, n: int) -> DataFrame:
    """(a, b): links with the components of all pairs of ``groups`` (row, n, node, print) that share a family and are similar enough; ``n`` rows at most."""
    at = checkpointed(families(groups, n).join(groups.select("node", "row", "n"), "node").select("family", "row", "n"))
    members = at.join(_small(at.groupBy("family").agg(F.min("row").alias("leader"))), "family")
    apart = members.where("row <> leader")
    pairs = checkpointed(apart.select(F.col("row").alias("a"), F.col("leader").alias("b")))
    sets = _sets(rows, at.select("row"))
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb")), "b")
    near = F.least(F.size("sa"), F.size("sb")) >= F.lit(similarity) * F.greatest(F.size("sa"), F.size("sb")) - 1e-9
    shared = F.size(F.array_intersect("sa", "sb"))
    stars = checkpointed(both.where(near).where(_enough(shared, F.size("sa"), F.size("sb"), similarity)).select("a", "b"))
    label = stars.select(F.col("a").alias("row"), F.col("b").alias("label"))
    rest = apart.join(label, "row", "left").select("family", "row", "n", F.coalesce("label", "row").alias("label"))
    return stars.unionByName(_across(rest, sets, similarity))


def _across(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between rows of different labels that share a family and a class of size, or classes next to each other."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(similarity)) + 1e-9)
    both = F.array(F.struct(size.alias("size"), F.lit(True).alias("home")), F.struct((size + 1).alias("size"), F.lit(False).alias("home")))
    placed = rest.select("family", "row", "n", "label", F.explode(both).alias("x")).select("family", "x.size", "x.home", "row", "n", "label")
    open_ = placed.groupBy("family", "size").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("home").alias("home"), F.greatest(F.sum("n") / BLOCK, F.count("*") / BLOCK_ROWS).alias("blocks"))
    open_ = checkpointed(open_.where("home and lo <> hi").select("family", "size", F.ceil("blocks").cast("int").alias("blocks")))
    dealt = placed.join(open_, ["family", "size"]).withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["family", "size", "i", "j"]
    shards = dealt.select("family", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "home", "row").join(sets, "row")
    ordered = shards.repartition(*key).sortWithinPartitions(*key).select(F.struct(*key).alias("shard"), "home", "row", "shingles")
    kind = shards.schema["row"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches):
        shard, home, rows, held = None, [], [], []

        def ready():
            a, b = close(held, np.array(home, bool), similarity)
            t = pa.concat_arrays(rows)
            return pa.RecordBatch.from_arrays([t.take(pa.array(a)), t.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            where = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1]), len(where)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                if shard != where[lo]:
                    if len(held) > 1:
                        yield ready()
                    shard, home, rows, held = where[lo], [], [], []
                home += batch.column(1).slice(lo, hi - lo).to_pylist()
                rows.append(batch.column(2).slice(lo, hi - lo))
                held += [batch.column(3)[k].values.to_numpy(zero_copy_only=False).copy() for k in range(lo, hi)]
        if len(held) > 1:
            yield ready()

    return ordered.mapInArrow(trimmed(run), schema)


def close(sets: list[np.ndarray], home: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (index, smaller index) of the sets that are similar enough, one at least of each pair at home."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of a single set are in no intersection.
    number = np.cumsum(count > 1) - 1
    kept = count[column] > 1
    row, column = row[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, (c, c + _COLUMNS))
        own, inverse = np.unique(row[lo:hi], return_inverse=True)
        x = np.zeros((len(own), _COLUMNS), np.float32)
        x[inverse, column[lo:hi] - c] = 1
        for i in range(0, len(own), _CHUNK):
            shared[np.ix_(own[i : i + _CHUNK], own)] += x[i : i + _CHUNK] @ x.T
    found = []
    for i in range(0, len(sets), _CHUNK):
        some = shared[i : i + _CHUNK]
        good = some * (1 + similarity) >= similarity * (n[i : i + _CHUNK, None] + n[None, :]) - 1e-6
        a, b = np.nonzero(np.triu(good & (home[i : i + _CHUNK, None] | home[None, :]), i + 1))
        found.append((a + i, b))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    label = forest(a, b, len(sets))
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return moved, label[moved]


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` less all rows but the smallest of each group that links of at least the similarity join."""
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(row_id(id_col, text).alias("row"), F.col(f"`{text}`").alias("text"))
    marks = checkpointed(_arrow(rows, "digest binary, n array<long>, print array<long>", lambda s: (xxhash.xxh3_128_digest(s.tobytes()), np.array([len(s)]), fingerprint(s).view(np.int64))))
    marks = marks.withColumn("n", F.col("n")[0])
    groups = marks.groupBy("digest").agg(F.min(F.struct("row", "n", "print")).alias("x"), F.count("*").alias("m"))
    groups = checkpointed(groups.select("digest", F.xxhash64("digest").alias("node"), "x.row", "x.n", "x.print", "m"))
    found = links(rows, groups.select("row", "n", "node", "print"), similarity, groups.count())
    found = checkpointed(components(found).select(F.col("a").alias("row")))
    # Gone are the smallest rows that link to a smaller one, and all rows that equal another's shingles.
    equal = marks.join(groups.where("m > 1").select("digest", F.col("row").alias("least")), "digest").where("row <> least").select("row")
    gone = checkpointed(found.union(equal).distinct())
    twice = checkpointed(marks.groupBy("row").count().where("count > 1").select("row"))
    names = [f"`{c}`" for c in docs.columns]
    named = docs.withColumn("_fs_row", row_id(id_col, text))
    kept = named.join(_small(gone.withColumnRenamed("row", "_fs_row")), "_fs_row", "left_anti")
    if not twice.isEmpty():
        twice = _small(twice.withColumnRenamed("row", "_fs_row"))
        kept = kept.join(twice, "_fs_row", "left_anti").unionByName(kept.join(twice, "_fs_row", "left_semi").dropDuplicates(["_fs_row"]))
    return kept.select(*names)
