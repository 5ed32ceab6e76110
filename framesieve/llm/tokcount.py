"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a slice of texts lie in one flat array of symbols.
In each round every sequence finds its lowest-ranked adjacent pair, all
occurrences of that pair are merged at once in all sequences, and sequences
without any pair leave with their length as count.  No string is built.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are
counted one by one; special strings inside a text count as one token each, as
the tokenizers library does by default; an empty table gives an empty one.  Only the
id and the text are read: other columns can have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framesieve.llm.common import ship, text_slices
from framesieve.llm.vocabulary import Vocabulary, packed, unpacked

SLICE = 4_000_000
KNOWN = 800_000
_NONE = np.iinfo(np.int32).max

_counters: dict[int, RankCounter] = {}


class RankCounter:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        n = len(vocab.merges)
        keys = np.fromiter((a << 32 | b for a, b in vocab.merges), np.int64, n)
        order = np.argsort(keys)
        rank = np.fromiter((r for r, _ in vocab.merges.values()), np.int32, n)
        self.keys, self.rank = keys[order], rank[order]
        self.merged = np.zeros(int(rank.max()) + 1 if n else 1, np.int32)
        for r, m in vocab.merges.values():
            self.merged[r] = m
        self.of_byte = np.array([vocab.ids[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.known.clear()
        self.known.update(dict.fromkeys(self.vocab.special, 1))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        out = np.zeros(len(words), np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        active = np.flatnonzero(lengths)
        lengths = lengths[active]
        if not len(active):
            return out
        owner = np.repeat(np.arange(len(active)), lengths)
        ranks = np.full(len(symbols), _NONE, np.int32)  # of the pair that starts here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while True:
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == _NONE
            if done.any():
                out[active[done]] = lengths[done]
                stay = ~done
                if not stay.any():
                    return out
                keep = np.repeat(stay, lengths)
                symbols, ranks = symbols[keep], ranks[keep]
                active, lengths, lowest = active[stay], lengths[stay], lowest[stay]
            owner = np.repeat(np.arange(len(active)), lengths)
            hit = ranks == lowest[owner]
            at = np.arange(len(hit))
            # In a run of hits (a pair of equal symbols) every second one stands.
            run = np.maximum.accumulate(np.where(hit, -1, at))
            hit &= (at - run) % 2 == 1
            where = np.flatnonzero(hit)
            symbols[where] = self.merged[ranks[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            lengths = lengths - np.bincount(owner[where], minlength=len(active))
            moved = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            where = moved[where]
            # Only pairs beside a merged symbol have changed.
            near = np.unique(np.concatenate((where, where[where > 0] - 1)))
            ranks[near] = _NONE
            near = near[near + 1 < len(symbols)]
            near = near[owner[near] == owner[near + 1]]
            ranks[near] = self._ranks(symbols[near], symbols[near + 1])

    def count_texts(self, texts: list[str]) -> list[int]:
        split = [self.vocab.pretokens(t) for t in texts]
        words = {w for ws in split for w in ws}
        new = words.difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.reset()
            new = words.difference(self.known)
        new = list(new)
        self.known.update(zip(new, self.counts([w.encode() for w in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, ws)) for ws in split]


def _counter(blob: bytes) -> RankCounter:
    key = hash(blob)
    if key not in _counters:
        _counters[key] = RankCounter(unpacked(blob))
    return _counters[key]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    ship(spark)
    blob = spark.sparkContext.broadcast(packed(path))
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = _counter(blob.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in text_slices(map(len, texts), SLICE):
                n = np.array(counter.count_texts(texts[a:b]), np.int64)
                size = np.fromiter((len(t.encode()) for t in texts[a:b]), np.int64, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[f"`{id_col}`"], docs[f"`{text}`"].alias("_fs_text" if text == id_col else text)).mapInArrow(run, schema)
