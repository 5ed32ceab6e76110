"""The pipeline against its stages' brute-force versions, on whole small tables."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framesieve.llm import langid, nearcopies, simhash
from framesieve.llm.common import checkpointed

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Of (id, text): the smallest of each group, by all pairs; rows without id or words aside."""
    rows = sorted({r for r in rows if r[0] is not None and shingles(r[1])}, key=lambda r: r[0])
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    close = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while True:
        old = list(label)
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
        if old == label:
            return [rows[i] for i in sorted(set(label))]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names, kept = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        before, rows = {r.doc_id: r for r in kept.collect()}, out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "language ID":
            assert set(after) == {d for d, r in before.items() if r.text and langid._LETTER.search(r.text)}
        if name.startswith("SimHash"):
            assert set(after) == {d for d, _ in survivors([(d, r.text) for d, r in before.items()])} and len(after) < len(before)
        if name.startswith("benchmark"):
            gone = {d for d, r in before.items() if any(b in " ".join(r.text.split()) for b in bench)}
            assert gone and set(before) - set(after) == gone
        if name == "PII":
            assert set(after) == set(before) and any("[EMAIL]" in r.text for r in rows) and not any("@mail" in r.text for r in rows)
        names.append(name)
        kept = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id: r.text for r in last} == {r.doc_id: r.text for r in kept.collect()}
    whole = corpus_pipeline.run(spark, SF)
    key = lambda rows: sorted((r.doc_id, zlib.crc32(r.text.encode()), r.n_tokens) for r in rows)
    assert key(whole.collect()) == key(last)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.first()
    odd = [(None, clean.text, "en", "s", 1), (900001, None, None, None, None), (900002, "", "en", None, 0), (900003, "123", "en", "s", 3), (clean.doc_id, clean.text, "en", "s", 1)]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("row", F.lit("clash")).withColumn("token_ids", F.lit(7))
    kept = both
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(clean.doc_id) == 1 and ids.count(None) == 1 and not {900001, 900002, 900003} & set(ids)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_near_copies_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    first = docs.orderBy("doc_id").limit(1).first()
    words = first.text.split()
    more = [(first.doc_id, "one doc_id with another text stays"), (None, first.text), (900001, first.text), (900002, " ".join([*words[:-3], "changed", *words[-2:]])), (900003, None), (900004, ""), (900005, "one row"), (900005, "one row")]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    got = [tuple(r) for r in nearcopies.without_copies(docs.withColumn("row", F.lit("clash"))).drop("row").collect()]
    assert sorted(got, key=str) == sorted([*survivors([tuple(r) for r in docs.collect()]), (None, first.text), (900003, None), (900004, "")], key=str)
    assert nearcopies.without_copies(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_links_beside_the_leader(spark, monkeypatch, block):
    """Families whose members aren't all close to their bucket's leader: chains, stars and strangers that share a passage; all in one bucket."""
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "buckets", lambda s: np.zeros(1, np.uint64))
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for family in range(6):
        base = list(rng.choice(words, 120))
        for step in range(14):
            # Chains drift away from their start, stars stay about it, strangers keep one half only.
            kind = family % 3
            text = list(base)
            for _ in range(2):
                text[rng.integers(len(text))] = str(rng.choice(words))
            if kind == 0:
                base = text
            if kind == 2:
                text = base[:60] + list(rng.choice(words, 60))
            rows.append((int(rng.integers(1, 1 << 40)), " ".join(text)))
    rows += [(1000 + i, " ".join(words[:n])) for i, n in enumerate((1, 2, 4, 5, 6, 5, 30, 31, 37, 38))]
    seen = []
    across = nearcopies._across
    monkeypatch.setattr(nearcopies, "_across", lambda *a: (seen.append(checkpointed(across(*a))), seen[-1])[1])
    got = [tuple(r) for r in nearcopies.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(survivors(rows))
    assert seen[0].count()  # links that no leader has


def test_wide_fingerprints():
    """A bit is the majority of its hashes' bits; pairs of similarity 0.8 stay within FAR and share a table."""
    rng = np.random.default_rng(6)
    s = np.unique(rng.integers(0, 1 << 63, 600, np.uint64))
    ones = np.sum([np.unpackbits(nearcopies.fingerprint(x[None]).view(np.uint8)) for x in s], axis=0)
    assert (np.unpackbits(nearcopies.fingerprint(s).view(np.uint8)) == (2 * ones > len(s))).all()
    apart = []
    for n in (4, 9, 40, 400):
        for _ in range(40):
            h = rng.integers(0, 1 << 63, 2 * n, np.uint64)
            # n of n + n/4 shingles are shared: the larger set has them all.
            a, b, c = (nearcopies.fingerprint(np.unique(x)) for x in (h[:n], h[: n + n // 4], h[n:]))
            away = nearcopies._away(np.stack((a, b, c))[:, : nearcopies.CHECKED], np.stack((a, b, c))[:, : nearcopies.CHECKED])
            assert away[0, 1] <= nearcopies.FAR
            apart.append(away[0, 2] > nearcopies.FAR)
            for _, bits, tables in nearcopies.TABLES:
                x, y = nearcopies.buckets(a, bits, tables), nearcopies.buckets(b, bits, tables)
                assert len(x) == tables and (x >> np.uint64(bits) == np.arange(tables)).all() and (x == y).any()
    assert np.mean(apart) > 0.95
    assert [nearcopies.tables_for(n) for n in (0, 1 << 18, (1 << 18) + 1, 1 << 40)] == [(10, 64), (10, 64), (13, 104), (20, 340)]


def test_families_of_a_bucket():
    """Peeling a large bucket joins what all pairs of fingerprints join."""
    rng = np.random.default_rng(7)
    starts = rng.integers(0, 1 << 63, (12, nearcopies.CHECKED), np.uint64)
    f = starts[rng.integers(0, 12, 300)]
    for _ in range(20):  # chains: up to 20 bits from the start
        f[np.arange(300), rng.integers(0, nearcopies.CHECKED, 300)] ^= np.uint64(1) << rng.integers(0, 63, 300, np.uint64)
    f = np.concatenate((f, rng.integers(0, 1 << 63, (100, nearcopies.CHECKED), np.uint64)))
    whole, peeled = nearcopies.family_of(f), nearcopies.family_of(f, small=5, step=7)
    sets = lambda x: {tuple(np.flatnonzero(x == k)) for k in set(x.tolist())}
    assert sets(whole) == sets(peeled) and len(sets(whole)) == 112


@pytest.mark.parametrize("hot", [1 << 16, 20])
def test_near_copies_come_from_simhash(spark, monkeypatch, hot):
    """All links come from the fingerprints' tables: without them only equal sets go; hot buckets as pairs of blocks give the same."""
    monkeypatch.setattr(nearcopies, "HOT", hot)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(5):
        base = list(rng.choice(words, 150))
        for _ in range(40):
            text = list(base)
            for at in rng.integers(0, 150, int(rng.integers(0, 5))):
                text[at] = str(rng.choice(words))
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in simhash.without_near_copies(docs).collect())
    assert got == sorted(survivors(rows))
    if hot > 20:
        monkeypatch.setattr(nearcopies, "fingerprint", lambda s: rng.integers(0, 1 << 63, 16, np.uint64))
        assert simhash.without_near_copies(docs).count() == len({frozenset(shingles(t)) for _, t in rows}) > len(got)


def test_texts_are_sent_once(spark):
    """Language ID's worker gets each text in its row alone, not beside it again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = langid.predict(docs, langid.fit([("a", "some text"), ("b", "weiterer satz")]))._jdf.queryExecution().optimizedPlan().children().head()
    assert [f.name() for f in plan.schema().fields()] == ["row"]


def test_close_memory():
    """A comparison holds about one number for each pair of rows."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2000, 60)) for _ in range(1600)]
    tracemalloc.start()
    nearcopies.close(sets, np.ones(len(sets), bool), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(sets) ** 2


def test_close_sets():
    rng = np.random.default_rng(4)
    base = rng.choice(1 << 40, 30_000, replace=False).astype(np.int64)
    sets = [np.unique(np.concatenate((base[: n - k], rng.integers(1 << 50, 1 << 60, k)))) for n, k in ((100, 0), (100, 20), (100, 12), (100, 10), (79, 0), (80, 0), (9000, 100), (9000, 900), (9000, 3000))]
    home = np.array([True, False, False, True, True, True, False, True, True])
    label = list(range(len(sets)))
    for _ in sets:
        for i in range(len(sets)):
            for j in range(i):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if (home[i] or home[j]) and len(x & y) >= 0.8 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    a, b = nearcopies.close(sets, home, 0.8)
    found = list(range(len(sets)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        found[x] = y
    assert found == label and len(a) > 2
