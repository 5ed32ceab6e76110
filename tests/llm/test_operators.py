"""Each operator against brute force, and its edge cases: nulls, empties, ties, repeats, clashing names."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesieve.llm import bpe, components, decontam, langid, license, lm, media, pii, queries, simhash, substring, tokcount, vocabulary

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- 1: PII -------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text: str) -> str:
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text) if good(k, m[0]))


def test_pii_base(spark, texts):
    rows = queries.op1_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == sha(personal(texts[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(f"{k}:", personal(texts[r.doc_id]))) for k in KINDS]


def test_pii_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "a@b.c_x@d.e a@b.c@d.e"), (4, "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.1.1"), (5, "x" * 100_000), (6, "a@b" + ".c" * 20_000), (7, "1 " * 20_000), (8, "+1 2 +3"), (8, "+1 2 +3"),
        (9, "é@a.b-c.d- 4111-1111-1111-1111"), (10, "😀é+1 (888) 555-1234 4918187128635271 53.121.55.90 DE89370400440532013000 ssn 123-45-6789"),
    ]
    df = spark.createDataFrame(rows, TEXTS).withColumn("spans", F.lit("clash"))
    got = pii.detect(df).select("doc_id", pii.render(F.col("base")).alias("b"), pii.render(F.col("spans")).alias("s")).collect()
    assert sorted((r.doc_id, r.b) for r in got) == sorted((i, personal(t or "")) for i, t in rows)
    last = next(r.s for r in got if r.doc_id == 10)
    assert last == "ip:37:49,card:20:36,phone:2:19,iban:50:72,ssn:77:88"
    red = pii.redact(df.where("doc_id in (1, 3, 9, 10)"))
    assert red.columns == df.columns
    assert {r.doc_id: r.text for r in red.collect()} == {1: None, 3: "[EMAIL][EMAIL] [EMAIL]@d.e", 9: "é@a.b-c.d- [CARD]", 10: "😀é[PHONE] [CARD] [IP] [IBAN] ssn [SSN]"}


def redacted(text, spans):
    """By the rendered spans: those that overlap merge and take the first one's kind."""
    out, at = "", 0
    for s, e, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            out += text[at:s] + f"[{k.upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_pii_of_many_matches(spark):
    """Positions and placeholders across blocks; a table of 200,000 numbers takes seconds."""
    rng = np.random.default_rng(2)
    odd = "".join(str(rng.choice(["a@b.co ", "é 1.2.3.4, ", "4111 1111 1111 1111;", "+1 888 555 1234 x ", "4918187128635271 4918187128635271 4918187128635271,", "12, ", "ß", "+1 888 555 1234a@b.co"])) for _ in range(3000))
    rows = [(1, odd), (2, " , ".join(["12"] * 200_000)), (3, " ".join(["1234"] * 100_000)), (4, ",".join(["4111111111111111"] * 20_000)), (5, "a@b.c " * 130)]
    df = spark.createDataFrame(rows, TEXTS)
    began = time.time()
    got = {r.doc_id: r for r in pii.detect(df).select("doc_id", pii.render(F.col("base")).alias("b"), pii.render(F.col("spans")).alias("s")).collect()}
    assert {i: r.b for i, r in got.items()} == {i: personal(t) for i, t in rows}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {i: redacted(t, got[i].s) for i, t in rows}
    assert time.time() - began < 60
    assert got[1].s.count("card") > got[1].b.count("card") and pii.detect(df.limit(0)).collect() == [] == pii.redact(df.limit(0)).collect()


def test_pii_is_native(docs):
    assert not re.search("Python|Pandas|Arrow", pii.redact(docs)._jdf.queryExecution().executedPlan().toString())


# --- 2 and 5: tokens ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary.default_path())


ODD = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 3000, "a" * 2001, " " * 999, "-" * 700, "\n\n \t a  b\r\n", "😀👩‍👩‍👧 é́ don't", "ab" * 900 + "\u0085　"]


def test_bpe(spark, texts, library):
    cases = [*texts.values(), *ODD]
    df = spark.createDataFrame([*enumerate(cases), (-1, None)], TEXTS).withColumn("token_ids", F.lit(1))
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(df)).collect()}
    for i, t in enumerate(cases):
        want = library.encode(t, add_special_tokens=False).ids
        assert rows[i].token_ids == want and rows[i].decoded == library.decode(want, skip_special_tokens=False) == t
    assert rows[-1].token_ids == [] and rows[-1].decoded == ""
    once = bpe.encode(df.drop("token_ids"), decoded="decoded")
    assert {r.doc_id: (r.token_ids, r.decoded) for r in once.collect()} == {i: (r.token_ids, r.decoded) for i, r in rows.items()}


def test_token_counts(spark, texts, library):
    cases = [*texts.values(), *ODD]
    df = spark.createDataFrame([*enumerate(cases), (-1, None), (-1, None)], TEXTS)
    rows = tokcount.token_counts(df).collect()
    assert len(rows) == len(cases) + 2
    for r in rows:
        t = cases[r.doc_id] if r.doc_id >= 0 else ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)


@pytest.mark.parametrize("limit", [700, 10**9])
def test_texts_over_a_slice(spark, library, monkeypatch, limit):
    """Texts longer than a slice, clashing columns, empty tables."""
    monkeypatch.setattr(bpe, "SLICE", limit)
    monkeypatch.setattr(tokcount, "SLICE", limit)
    cases = ["word " * 3000, "", "x" * 2500, "é😀 " * 900, "a"]
    df = spark.createDataFrame([*enumerate(cases), (None, "lost")], TEXTS).withColumns({c: F.lit("clash") for c in ("n_tokens", "n_bytes", "over_limit", "token_ids", "decoded")})
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in [*enumerate(cases), (None, "lost")]}
    assert {r.doc_id: r.n_tokens for r in tokcount.token_counts(df).collect()} == want
    both = {r.doc_id: (len(r.token_ids), r.decoded) for r in bpe.encode(df, decoded="decoded").collect()}
    assert both == {i: (want[i], t) for i, t in [*enumerate(cases), (None, "lost")]}
    empty = df.limit(0)
    assert tokcount.token_counts(empty).collect() == bpe.encode(empty).collect() == bpe.decode(bpe.encode(empty)).collect() == []


def test_bounded_tables_change_nothing(texts):
    v = vocabulary.unpacked(vocabulary.packed(None))
    whole = bpe.TrieEncoder(v)
    small, old = bpe.TrieEncoder(v), bpe.KNOWN
    cases = list(texts.values())[:20]
    want = whole.encode_text(cases)[1].tolist()
    try:
        bpe.KNOWN = 50
        got = [x for t in cases for x in small.encode_text([t])[1].tolist()]
    finally:
        bpe.KNOWN = old
    assert got == want


# --- 3: substrings ------------------------------------------------------------------------------


def cut(rows, w):
    first: dict = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, x in split:
        for i in range(len(x) - w + 1):
            first[tuple(x[i : i + w])] = min(first.get(tuple(x[i : i + w]), d), d)
    out = []
    for d, x in split:
        gone = {j for i in range(len(x) - w + 1) if first[tuple(x[i : i + w])] < d for j in range(i, i + w)}
        out.append((d, len(x), len(gone), b" ".join(y for j, y in enumerate(x) if j not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("flush", [1_200_000, 60])
def test_substrings(spark, docs, monkeypatch, flush):
    monkeypatch.setattr(substring, "FLUSH", flush)
    tiny = [(1, "a b c d e f"), (2, "x a b c y b c d"), (2, "a b c"), (-3, None), (4, ""), (5, "a a a a a a"), (6, "a a a a b c d"), (7, "d e f g"), (8, "a\x1cb c d\te\nf"), (9, "a\x1cb c d e f")]
    lost = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(tiny, TEXTS).withColumn("part", F.lit("clash"))
    key = lambda df: sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())
    assert key(substring.remove_repeats(df, window=3)) == cut(tiny, 3)
    assert substring.remove_repeats(df.limit(0)).collect() == []
    both = df.union(spark.createDataFrame(lost, TEXTS).withColumn("part", F.lit("clash")))
    rows = substring.remove_repeats(both, window=3).collect()
    assert sorted((r.n_removed, r.kept) for r in rows if r.doc_id is None) == [(0, ""), (0, "a b c d e f"), (0, "a b c d e f")]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows if r.doc_id is not None) == cut(tiny, 3)
    if flush > 60:
        assert key(substring.remove_repeats(docs)) == cut([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_substrings_memory():
    """A worker's memory goes by its texts, and a flush takes few bytes a window."""
    import tracemalloc

    texts = pa.record_batch({"doc_id": pa.array(range(20), pa.int64()), "text": [" ".join(f"{d} {i}" for i in range(100)) for d in range(20)]})
    r = np.random.default_rng(1)
    own = [r.integers(0, 1 << 60, 3000).astype(np.uint64) for _ in range(100)]
    hashes, seconds = [*own, *(h.copy() for h in own)], [np.zeros(3000, np.uint8) for _ in range(200)]
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in substring._hash_windows(50, 7)(iter([texts]))) == 7
        assert tracemalloc.get_traced_memory()[1] < 20e6
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        rows = list(substring._flush(list(range(200)), list(range(200)), hashes, seconds, 7))
        assert tracemalloc.get_traced_memory()[1] - before < 65 * 600_000
    finally:
        tracemalloc.stop()
    assert sum(settled for _, settled, *_ in rows) == 7
    assert sum(len(rest) // 8 for _, settled, *_, rest in rows if not settled) == 300_000


# --- 4: SimHash ---------------------------------------------------------------------------------


def slow_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(fps):
    """Smallest index reachable by links of at most 3 bits."""
    label = list(range(len(fps)))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    while True:
        old = label[:]
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == old:
            return label


def test_fingerprints(texts):
    for t in [*list(texts.values())[:60], None, " ", "a", "A b", "a b C", "É b c d"]:
        assert simhash.fingerprint(t) == slow_print(t)


@pytest.mark.parametrize("hot", [8192, 40])
def test_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 2**63, 120, dtype=np.uint64)}
    for x in list(fps)[:60]:
        for _ in range(3):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    base = next(iter(fps))
    for _ in range(250):
        y = base
        for b in rng.choice(10, rng.integers(1, 5), replace=False):
            y ^= 1 << int(b) * 6
        fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    at = {x: i for i, x in enumerate(signed)}
    for levels in (8, 16, 32) if hot == 40 else (None,):
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), levels=levels).collect()
        a, b = (np.array([at[r[k]] for r in found], np.int64) for k in (0, 1))
        assert components.forest(a, b, len(fps)).tolist() == reach(fps)


def test_levels_follow_the_count():
    assert [simhash.levels_for(n) for n in (0, 20_000_000, 20_000_001, 10**10)] == [8, 8, 16, 32]


def test_components_of_repeated_and_null_ids(spark, monkeypatch):
    """Links are between fingerprints: ids only name what they join."""
    prints = {"a": 0, "b": 0b111, "c": 0xFFFF0000, "d": 0xFFFF0001, "e": 0b111000, "n": 0b111111 << 40, "m": 0b111 << 40}
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle=3: prints[text])
    monkeypatch.setattr(simhash, "ship", lambda spark: None)
    rows = [(1, "a"), (5, "b"), (5, "c"), (7, "d"), (None, "e"), (None, "n"), (None, "m"), (None, "m")]
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *a: spark.createDataFrame([(i, prints[t]) for i, t in rows], "doc_id long, fp long"))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == {(1, 0): 1, (5, 0b111): 1, (5, 0xFFFF0000): 5, (7, 0xFFFF0001): 5, (None, 0b111000): 1, (None, prints["n"]): 1, (None, prints["m"]): 1}
    alone = [(None, "d"), (3, "a")]
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *a: spark.createDataFrame([(i, prints[t]) for i, t in alone], "doc_id long, fp long"))
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(alone, TEXTS)).collect()} == {(None, None), (3, 3)}


def test_near_duplicates(spark, docs):
    rows = queries.op4_simhash(spark, SF).orderBy("doc_id").collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    ids = [r.doc_id for r in rows]
    assert [r.component_id for r in rows] == [ids[i] for i in reach(fps)]
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d"), (3, "a b c d"), (3, "a b c d")], TEXTS).withColumn("fp", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7), (101, 102)], "a long, b long")
    got = {r.a: r.b for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


# --- 6: licences --------------------------------------------------------------------------------


def phrases(text):
    w = re.findall(license.WORD, text.encode().lower().decode())
    at = [(i, k) for k, p in license.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at}))


def test_license(spark, texts):
    odd = {-1: None, -2: "", -3: "MIT License mit license. licensed under THE gnu General Public License, version 2", -4: "Licensed under CC BY-NC 4.0.", -5: "general public licence É license"}
    df = spark.createDataFrame([*texts.items(), *odd.items(), (-3, "MIT"), (-3, "MIT")], TEXTS).withColumn("sig", F.lit("clash"))
    rows = license.scan(df).collect()
    assert len(rows) == len(texts) + len(odd) + 2
    for r in rows:
        if r.doc_id != -3:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == phrases((texts | odd)[r.doc_id] or "")
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
    assert [r.labels for r in rows if r.doc_id == -4] == ["cc-by-nc"]
    assert Counter(r.n_base for r in rows if r.doc_id == -3) == {3: 1, 0: 2}
    plan = license.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    ends = [(None, "mit license"), (None, "mit license"), (None, None), (1, None), (1, "a")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_base) for r in license.scan(spark.createDataFrame(ends, TEXTS)).collect())
    assert got == [(0, 0, 0), (0, 2, 1), (0, 2, 1), (1, 0, 0), (1, 1, 0)]
    assert license.scan(df.limit(0)).collect() == []


def test_license_tolerates_changes(spark):
    """Words put in, left out or changed; but no notice stands for another licence, nor a cut one for a whole one."""
    granted = license.NOTICES[1][1]
    cases = {
        "permission is hereby granted free of charge to every person who is obtaining a copy of this software and associated documentation files": ("mit", 0.9),
        granted: ("mit", 1.0),
        granted.replace("hereby ", "").replace("a copy", "one copy"): ("mit", None),
        " ".join(granted.split()[:12]): ("", 0.0),
        "licensed under the MIT license version 2 0": ("mit", 1.0),
        "licensed under the apache license, in version 2.0": ("apache", 1.0),
        "licensed under the other license version 2 0": ("", 0.0),
        "Licensed under CC BY-ND 4.0": ("cc-by-nd", 1.0),
        "Licensed under CC BY-NC-SA 4.0": ("cc-by-nc-sa", 1.0),
        "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": ("cc-by-nc-sa", 1.0),
        "licensed under a Creative Commons Attribution 4.0 International License": ("cc-by", 1.0),
        "redistribution and use in source or binary forms with and without modification are permitted provided that the following conditions are met": ("bsd", None),
        "this source code is subject to the terms of the mozilla public license": ("mpl", None),
        "this source code is subject to the terms of the other public license": ("", 0.0),
        "": ("", 0.0),
    }
    rows = {r.doc_id: r for r in license.scan(spark.createDataFrame([(i, "x y " + t) for i, t in enumerate(cases)], TEXTS)).collect()}
    for i, (label, score) in enumerate(cases.values()):
        assert rows[i].labels == label and (score is None or rows[i].score == pytest.approx(score)), (i, rows[i])
        assert rows[i].score >= license.COVERAGE or not label


def test_license_sql(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op6_license"]).fetchall()
    got = [tuple(r) for r in queries.op6_license(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[6] for r in got)


# --- 7: media -----------------------------------------------------------------------------------


def samples(png: bytes) -> bytes:
    """A reader of its own: unfiltered 8-bit RGB."""
    width, height = (int.from_bytes(png[k : k + 4], "big") for k in (16, 20))
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[12:16] == b"IHDR" and tuple(png[24:29]) == (8, 2, 0, 0, 0) and width == 64
    n = int.from_bytes(png[33:37], "big")
    lines = zlib.decompress(png[41 : 41 + n])
    assert png[37:41] == b"IDAT" and png[45 + n + 4 : 45 + n + 8] == b"IEND" and len(lines) == height * (3 * width + 1)
    return b"".join(lines[i + 1 : i + 193] for i in range(0, len(lines), 193))


def test_media(spark, texts):
    odd = {-1: "", -2: "", -3: "x" * 500_000, -4: "<p>a & b</p><img src='sha256:00'> é " * 4000, -5: "a" * media.SLICE, -6: "a" * (media.SLICE + 1)}
    df = spark.createDataFrame([*texts.items(), (-1, None), (-2, ""), (-2, ""), *((k, t) for k, t in odd.items() if t), (-4, odd[-4]), (-4, "other"), (None, odd[-3])], TEXTS).withColumn("digest", F.lit("clash")).withColumn("row", F.lit("clash"))
    rows = media.media_features(df).collect()
    assert len(rows) == len(texts) + 10
    assert sorted(r.slices for r in rows if r.doc_id is None or r.doc_id < -2) == [1, 1, 2, 4, 4, 11, 11]
    for r in rows:
        t = "other" if r.doc_id == -4 and r.n_bytes == 5 else odd[-3] if r.doc_id is None else (texts | odd)[r.doc_id]
        b = t.encode()
        p = b.ljust(max(1, math.ceil(len(b) / 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha(p), zlib.crc32(p[-16:]))
        stored = [media.to_png(x) for x in media.slices(t)]
        assert b"".join(map(samples, stored)) == p and (r.media_bytes, r.media_sha256) == (sum(map(len, stored)), sha(b"".join(stored)))
        counts = Counter(p)
        mean = sum(k * n for k, n in counts.items()) / len(p)
        spread = math.sqrt(max(0, sum((k - mean) ** 2 * n for k, n in counts.items()) / len(p)))
        bits = -sum(n / len(p) * math.log2(n / len(p)) for n in counts.values())
        told = dict(x.split("=") for x in r.feature.split(";")[1:])
        assert r.feature.startswith(f"rgb64x{len(p) // 192};") and told["hist"] == ".".join(str(sum(counts[16 * k + j] for j in range(16))) for k in range(16))
        assert [float(told[k]) for k in ("mean", "sd", "bits")] == pytest.approx([mean, spread, bits], abs=1e-3)
    assert media.media_features(df.limit(0)).collect() == []


def test_pages_hold_text_and_slices_in_turn(spark):
    text = "".join(f"word{i} <b>&amp; " for i in range(9000))
    df = spark.createDataFrame([(1, text)], TEXTS)
    (row,) = media.interleave(media.pages(df, "doc_id"), "doc_id").collect()
    kinds = [s.kind for s in row.segments]
    assert kinds == ["text", "media"] * (len(kinds) // 2) and len(kinds) > 4 and [s.position for s in row.segments] == list(range(len(kinds)))
    assert "".join("".join(s.text.split()) for s in row.segments if s.kind == "text") == "".join(text.split())
    assert [s.digest for s in row.segments if s.kind == "media"] == [sha(x) for x in media.slices(text)]
    assert [s.caption.split(",")[0] for s in row.segments if s.kind == "media"] == [f"{k + 1} of {len(kinds) // 2}" for k in range(len(kinds) // 2)]


def test_media_rejects_damage():
    good = bytearray(media.to_png(b"a" * 192))
    good[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(good))


def test_interleaving(spark):
    html = '<p>a <b>c</b><figure><img src="x.png" alt="q"><figcaption>cap &amp; d</figcaption></figure>tail<script>no</script> <img src="sha256:AB" alt="z">end'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    seq = media.interleave(df, "page_id")
    got = {r.page_id: r.segments for r in seq.collect()}
    assert [(s.position, s.kind, s.text, s.caption) for s in got[1]] == [(0, "text", "a c", None), (1, "media", None, "cap & d"), (2, "text", "tail", None), (3, "media", None, "z"), (4, "text", "end", None)]
    assert got[2] == got[3] == []
    table = spark.createDataFrame([("ab", b"1", 9, "own", 5)], "digest string, media binary, position long, caption string, page_id long")
    found = {r.position: (r.caption, r.media, r.position_media, r.caption_media, r.page_id_media) for r in media.resolve(seq, table, "page_id").collect()}
    assert found == {1: ("cap & d", None, None, None, None), 3: ("z", bytearray(b"1"), 9, "own", 5)}
    silent = '<head><title>t</title><img src="a"></head><noscript>n<img src="b"></noscript><template><figure><img src="c"><figcaption>x</figcaption></figure></template><p>kept<img src="d"></p>'
    assert [(s["kind"], s["text"], s["ref"]) for s in media.parse(silent)] == [("text", "kept", None), ("media", None, "d")]
    assert media.interleave(df.limit(0), "page_id").collect() == [] and media.resolve(seq.limit(0), table, "page_id").collect() == []


# --- 8: language model --------------------------------------------------------------------------


def test_lm(spark, texts):
    rows = queries.op8_lm_score(spark, SF).collect()
    tokens = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    train = {k for k in tokens if zlib.crc32(str(k).encode()) % 10}
    c = Counter(w for k in train for w in tokens[k])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = tokens[r.doc_id]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 1e-9
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def interpolated(texts):
    """Scores by counting; and the probability of a word after a word, and the words."""
    tokens = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    fold = {k: zlib.crc32(str(k).encode()) % 10 for k in tokens}
    uni = Counter(w for k, x in tokens.items() if fold[k] for w in x)
    bi = Counter(p for k, x in tokens.items() if fold[k] for p in itertools.pairwise(["<", *x]))
    before = lambda h: uni[None] if h == "<" else uni[h]
    n, v = sum(uni.values()), len(uni)
    bucket = lambda c: 0 if c <= 0 else min(31, int(math.log2(c)) + 1)
    place = lambda p: 0 if p <= 0 else min(lm.BINS - 2, max(0, round(-4 * math.log10(p)))) + 1
    cells: Counter = Counter()
    for k, x in tokens.items():
        if fold[k] == lm.TUNING:
            for h, w in itertools.pairwise(["<", *x]):
                c = before(h) - 1
                cells[(bucket(c) * lm.BINS + place((bi[h, w] - 1) / c if c else 0)) * lm.BINS + place((uni[w] - 1) / (n - 1))] += 1
    weights = lm.tune(cells, v)

    def p(h, w):
        a, u, z = weights[bucket(before(h))]
        out = (a * bi[h, w] / before(h) if before(h) else 0) + u * uni[w] / n + z / (v + 1)
        return out if before(h) else out / (1 - a)

    return {k: sum(math.log10(p(h, w)) for h, w in itertools.pairwise(["<", *x])) for k, x in tokens.items()}, p, uni


@pytest.mark.parametrize("chunk", [6_000_000, 3000])
def test_lm_score(spark, texts, monkeypatch, chunk):
    """Also with texts longer than a chunk."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    want, p, uni = interpolated(texts)
    got = {r.doc_id: r.score for r in queries.op8_lm_score(spark, SF).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    for h in ["<", b"never seen", None, *(w for w, _ in uni.most_common(5)), *(w for w, _ in uni.most_common()[-3:])]:
        if h is not None:
            assert sum(p(h, w) for w in [*uni, b"unknown"]) == pytest.approx(1)


def test_lm_mixture():
    """Maximum likelihood of the histogram: no step along the simplex is better."""
    cells = {(3 * lm.BINS + 5) * lm.BINS + 9: 10.0, 3 * lm.BINS * lm.BINS + 9: 4.0, 3 * lm.BINS * lm.BINS + 14: 1.0}
    w = lm.tune(cells, 50)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
    p = np.array([[10 ** (-(b - 1) / 4) if b else 0 for b in (k // lm.BINS % lm.BINS, k % lm.BINS)] + [1 / 51] for k in cells])
    like = lambda x: (np.array([*cells.values()]) * np.log(p @ x)).sum()
    for i, j in itertools.permutations(range(3), 2):
        step = np.zeros(3)
        step[i], step[j] = 1e-3, -1e-3
        if w[3][j] > 2e-3:
            assert like(w[3] + step) <= like(w[3]) + 1e-3


def test_lm_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b a b"), (3, "a b a b"), (None, "zz")], TEXTS).withColumn("chunk", F.lit("clash"))
    rows = lm.score(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.held_out) for r in rows) == [(0, 2, 1, True), (1, 1, 1, False), (2, 1, 1, False), (3, 5, 5, False), (3, 5, 5, False)]
    assert lm.score(df.limit(0)).collect() == []


# --- 9: decontamination -------------------------------------------------------------------------


def test_seeds_hit_every_window():
    """Two substitutions anywhere in 13 words leave a hit of each mask; masks of other lengths leave one of one of them."""
    for mask in decontam.MASKS:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        for gone in itertools.combinations(range(decontam.WINDOW), 2):
            assert any(all(s + i not in gone for i in ones) for s in range(decontam.WINDOW - len(mask) + 1))
    for n, window, similarity in [*((n, 13, 0.8) for n in range(1, 13)), (40, 20, 0.8), (40, 13, 0.7)]:
        size = min(n, window)
        spare, masks = size - decontam.least_equal(size, similarity), decontam.masks_for(n, window, similarity)
        for gone in itertools.combinations(range(size), spare):
            assert any(all(i not in gone for i, c in enumerate(m) if c == "1") for m in masks)
    assert [n - decontam.least_equal(n, 0.8) for n in range(1, 14)] == [0] * 4 + [1] * 5 + [2] * 4


def contaminated(texts, items):
    """(document, item, start, stop) by every alignment of every item; overlapping passages merge."""
    out = set()
    split = [(i, decontam.words_of(q)) for i, q in items]
    for d, t in texts:
        w = decontam.words_of(t)
        index: dict = {}
        for p, x in enumerate(w):
            index.setdefault(x, []).append(p)
        for i, q in split:
            n = min(len(q), decontam.WINDOW)
            need = decontam.least_equal(n, 0.8)
            met = Counter(p - k for k, x in enumerate(q) for p in index.get(x, ()))
            spans = []
            for g in (g for g, m in met.items() if m >= need):
                starts = [k for k in range(len(q) - n + 1) if g + k >= 0 and g + k + n <= len(w) and sum(w[g + j] == q[j] for j in range(k, k + n)) >= need]
                if starts:
                    spans.append([g + starts[0], g + starts[-1] + n])
            out |= {(d, i, a, b) for a, b in joined(spans)}
    return out


def joined(spans):
    merged = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def spans_of(df):
    return sorted((r.doc_id or 0, r.item_id, r.start, r.stop) for r in df.collect())


@pytest.mark.parametrize("limit", [8 << 20, 40])
def test_decontamination(spark, texts, monkeypatch, limit):
    monkeypatch.setattr(decontam, "SLICE_BYTES", limit)
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = spark.createDataFrame([*texts.items()], TEXTS)
    got = spans_of(decontam.overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert got == sorted(contaminated(texts.items(), bench.items())) and got


@pytest.mark.parametrize("limit", [8 << 20, 40])
def test_short_items(spark, monkeypatch, limit):
    """Items of 1 to 30 words, planted whole, cut and with substitutions."""
    monkeypatch.setattr(decontam, "SLICE_BYTES", limit)
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(400)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 31)]
    rows = []
    for n, item in items:
        for gone in range(4):
            w = item.split()
            for k in rng.choice(len(w), min(gone, len(w)), replace=False):
                w[k] = "changed"
            if gone == 3:
                w = item.split()[: -1 - n // 10]
            rows.append((len(rows), " ".join([*(word() for _ in range(rng.integers(0, 20))), *w, *(word() for _ in range(rng.integers(0, 20)))])))
    got = spans_of(decontam.overlaps(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(items, "item_id long, text string")))
    assert got == sorted(contaminated(rows, items))
    assert {n for n, _ in items} == {i for _, i, _, _ in got}


@pytest.mark.parametrize("limit", [8 << 20, 40])
def test_decontamination_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "SLICE_BYTES", limit)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    changed = item.replace("four ", "x ").replace("nine", "y")
    rows = [(1, None), (2, ""), (3, f"a b {item.upper()}! c"), (4, f"a b {changed} c"), (5, item[: len(item) // 2]), (6, "alpha beta gamma delta epsilon"), (7, "alpha beta gamma delta"), (3, "clean"), (None, item), (8, "much too short."), (8, "much too short.")]
    df = spark.createDataFrame(rows, TEXTS).withColumn("item_id", F.lit("clash")).withColumn("row", F.lit("clash"))
    bench = spark.createDataFrame([(1, item), (2, "Alpha, beta gamma delta epsilon."), (3, None), (4, "too short"), (5, "?!")], "item_id long, text string")
    got = spans_of(decontam.overlaps(df, bench))
    assert got == [(0, 1, 0, 15), (3, 1, 2, 17), (4, 1, 2, 17), (6, 2, 0, 5), (8, 4, 1, 3), (8, 4, 1, 3)]
    kept = decontam.without_overlaps(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 7]
    assert decontam.overlaps(df, bench.limit(0)).collect() == [] and decontam.overlaps(df.limit(0), bench).collect() == []
    assert decontam.without_overlaps(df, bench.limit(0)).count() == len(rows)


def test_decontamination_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(queries.oracle_sql()["op9_decontamination"]).fetchall()
    assert sorted(tuple(r) for r in queries.op9_decontamination(spark, SF).collect()) == sorted(want) and want


def test_repetitive_texts_give_one_span(spark):
    text, item = "one two three four " * 10_000, "one two three four " * 10
    df, bench = spark.createDataFrame([(1, text)], TEXTS), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert spans_of(decontam.overlaps(df, bench)) == [(1, 1, 0, 40_000)]


# --- 10: languages ------------------------------------------------------------------------------


def test_languages(spark, docs):
    rows = queries.op10_language(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs):
    model = langid.train(docs)
    odd = [(1, None), (2, ""), (3, "123 !"), (4, "the of and " * 20_000), (4, "the of and " * 20_000), (None, "der die und")]
    df = spark.createDataFrame(odd, TEXTS).withColumn("score", F.lit("clash"))
    got = sorted((r.row.doc_id or 0, r.lang_pred, r.row.score) for r in langid.predict(df, model).collect())
    assert got == [(0, "de", "clash"), (1, "und", "clash"), (2, "und", "clash"), (3, "und", "clash"), (4, "en", "clash"), (4, "en", "clash")]
    tie = langid.Classifier(["aa", "bb"], np.zeros((langid.BINS, 2), np.float32), np.zeros(2), np.zeros((2, langid.BINS), bool))
    assert tie.predict(["some text"])[0] == ["aa"] and langid.predict(df.limit(0), model).collect() == []
    empty = langid.train(docs.limit(0))
    assert empty.languages == [] and {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}


def test_kernel():
    """Margins are those of plain kernel ridge regression, one language against the rest, if all rows are landmarks."""
    rng = np.random.default_rng(5)
    alphabets = {"x": "abcdef ", "y": "defghi ", "z": "ghijkl "}
    rows = [(g, "".join(rng.choice(list(a), rng.integers(3, 60)))) for g, a in alphabets.items() for _ in range(12)]
    probes = ["abc abd", "ghi", "def fed", "kkk lll", "a"]
    model = langid.fit(rows)

    def kernel(p, q):
        x, y = (set(np.flatnonzero(langid.presence([t])[0])) for t in (p, q))
        return len(x & y) / math.sqrt(len(x) * len(y))

    texts = [t for _, t in rows]
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    # Weighted, with a bias that isn't punished: (K + ridge / weight) a + b = y, and the sum of a is 0.
    n = len(rows)
    system = np.zeros((n + 1, n + 1))
    system[:n, :n] = k + langid.RIDGE * np.diag([12.0] * n)
    system[:n, n] = system[n, :n] = 1
    target = np.array([[1.0 if g == h else -1.0 for h in model.languages] for g, _ in rows])
    solved = np.linalg.solve(system, np.vstack((target, np.zeros((1, 3)))))
    want = np.array([[kernel(p, t) for t in texts] for p in probes]) @ solved[:n] + solved[n]
    assert np.allclose(model.margins(probes), want, atol=2e-3)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    for a, b in itertools.product(texts[:4], repeat=2):
        p, q = langid.presence([a])[0], langid.presence([b])[0]
        assert abs(int((p & q).sum()) - len(grams(a) & grams(b))) <= 1  # bins may collide


def test_training_sample(spark, monkeypatch):
    """Languages of long texts only, repeated ids and many languages are learned; the bounds hold."""
    monkeypatch.setattr(langid, "TRAIN_CHARS", 400)
    able = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "abc abd " * 100, "long") for i in able[:30]] + [(able[40], f"xyz zyx {i}", "repeated") for i in range(700)] + [(i, f"{chr(0x3041 + i % 80) * 3} {chr(0x3041 + i % 80)}", f"l{i % 80}") for i in able[50:800]] + [(i, "999", "digits") for i in able[:9]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda r: (seen.append(r), fit(r))[1])
    model = langid.train(df)
    sizes = Counter(g for g, _ in seen[0])
    assert set(model.languages) == {"long", "repeated", *(f"l{k}" for k in range(80))} and max(sizes.values()) <= langid.TOTAL_ROWS // 82
    assert max(len(t) for _, t in seen[0]) <= 400 + langid.PIECES
    assert model.predict(["abd abc", "zyx xyz", "\u3044\u3044"])[0] == ["long", "repeated", "l3"]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    assert set(langid.train(df).languages) == {"long", "repeated"}


def test_known_share(spark, docs, texts):
    """Rejecting texts of no learned language depends on no number of languages."""
    text = {r.doc_id: r.text for r in docs.where("lang in ('fr', 'es')").collect()}
    model = langid.train(docs.where("lang in ('en', 'de')"))
    share = [model.known(t, model.predict([t])[0][0]) for t in text.values() if t and len(t) > 200]
    assert len(model.languages) == 2 and np.median(share) < 0.6
    own = [model.known(t, model.predict([t])[0][0]) for t in (r.text for r in docs.where("lang in ('en', 'de')").collect()) if t and langid._LETTER.search(t)]
    assert np.percentile(own, 2) > 0.6
    assert model.known("qxj zzkw vvpq", "en") < 0.6 and model.known(None, "und") == 0.0
