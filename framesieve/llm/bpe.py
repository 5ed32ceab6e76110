"""BPE encoding over a trie of distinct pre-tokens, and decoding.

The encoding of a byte string is fixed by the last token of each of its
prefixes: t is the last token of a prefix p exactly if t ends p and t may follow
the last token of p without t, i.e. BPE would never merge across that boundary.
So a slice's distinct pre-tokens form a trie (here: sorted order, whose common
prefixes are the trie's inner nodes); a depth-first walk carries the last-token
state from node to child, and a shared prefix is computed once.  An encoding is
then read backwards from its leaf.

Bounds: texts are taken in slices of ``SLICE`` characters (one document at
least).  Known pre-tokens are kept in two tables of ``KNOWN`` entries each: when the newer
one is full it becomes the older one, and what is met again moves on from there.

Edge cases: a null text counts as empty (no ids; decoded to ""); repeated rows
are encoded one by one; ids in another table's rows may be null (decoded ""); an
empty table gives an empty one.  A column of the result replaces one of its name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framesieve.llm.common import ship, text_slices
from framesieve.llm.vocabulary import Vocabulary, packed, unpacked

SLICE = 1_000_000
KNOWN = 120_000
_NEVER = 1 << 60

_encoders: dict[int, TrieEncoder] = {}


class TrieEncoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab, n = vocab, len(vocab.bytes)
        made: dict[int, tuple[int, int, int]] = {}
        for (left, right), (rank, merged) in vocab.merges.items():
            made.setdefault(merged, (rank, left, right))
        rank = [-1] * n
        for t, (r, _, _) in made.items():
            rank[t] = r
        for t, (r, left, right) in made.items():
            if max(rank[left], rank[right]) >= r:
                raise ValueError(f"token {t} is merged before its parts")
        # The tokens that stand at a token's edge while it is being built, each
        # with the rank of the merge that ends it.
        self.right_edge: list[tuple] = [()] * n
        self.left_edge: list[tuple] = [()] * n
        for t in sorted((t for t in range(n) if vocab.bytes[t]), key=lambda t: rank[t]):
            if t in made:
                r, left, right = made[t]
                self.right_edge[t] = (*self.right_edge[right][:-1], (right, r), (t, _NEVER))
                self.left_edge[t] = (*self.left_edge[left][:-1], (left, r), (t, _NEVER))
            else:
                self.right_edge[t] = self.left_edge[t] = ((t, _NEVER),)
        self.follows: dict[int, bool] = {}
        # Tokens whose own bytes BPE never joins into them can't occur.
        ok = {t: True for t in vocab.ids.values() if t not in made}
        for t in sorted(made, key=lambda t: rank[t]):
            _, left, right = made[t]
            ok[t] = ok[left] and ok[right] and self._apart(left, right, before=rank[t])
        self._suffix_automaton({b: t for b, t in vocab.ids.items() if ok[t]})
        self.old: dict[str, bytes] = {}
        self.known = self.special()

    def special(self) -> dict[str, bytes]:
        return {s: array("i", [i]).tobytes() for s, i in self.vocab.special.items()}

    def _suffix_automaton(self, ids: dict[bytes, int]) -> None:
        """States are prefixes of tokens; ``ends[state]`` has the tokens that end there, longest first."""
        self.move: dict[int, int] = {}
        self.back, self.ends, depth = [0], [()], [b""]
        for b in sorted(ids, key=len):
            state = 0
            for i, c in enumerate(b):
                key = state << 8 | c
                if key not in self.move:
                    self.move[key] = len(self.back)
                    self.back.append(0)
                    self.ends.append(())
                    depth.append(b[: i + 1])
                state = self.move[key]
        for state in sorted(range(1, len(depth)), key=lambda s: len(depth[s])):
            b = depth[state]
            self.back[state] = self._moved(self.back[self.move_from(b[:-1])], b[-1]) if len(b) > 1 else 0
            own = ((ids[b], len(b)),) if b in ids else ()
            self.ends[state] = own + self.ends[self.back[state]]
        self.far: dict[int, int] = {}

    def move_from(self, prefix: bytes) -> int:
        state = 0
        for c in prefix:
            state = self.move[state << 8 | c]
        return state

    def _moved(self, state: int, c: int) -> int:
        """The state after byte ``c``: the longest token prefix that ends there."""
        while True:
            new = self.move.get(state << 8 | c)
            if new is not None or not state:
                return new or 0
            state = self.back[state]

    def _apart(self, left: int, right: int, before: int = _NEVER) -> bool:
        """Whether no merge across the boundary comes first (of those of rank under ``before``)."""
        merges, a, b, i, j = self.vocab.merges, self.right_edge[left], self.left_edge[right], 0, 0
        while True:
            (x, ends_x), (y, ends_y) = a[i], b[j]
            across = merges.get((x, y))
            # Of equal ranks, the merge further left comes first.
            if across and across[0] < before and across[0] < ends_x and across[0] <= ends_y:
                return False
            if ends_x == ends_y == _NEVER:
                return True
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1

    def encode(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids (int32, packed) of each of the sorted, distinct words."""
        move, far, ends, follows, apart = self.move, self.far, self.ends, self.follows, self._apart
        if len(follows) > 2 * KNOWN:
            follows.clear()
        if len(far) > KNOWN:
            far.clear()
        last: list[int] = [-1]  # last token of the prefix of each length
        size: list[int] = [0]
        states: list[int] = [0]
        before = b""
        for w in words:
            n, depth = len(w), 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :], size[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for end in range(depth + 1, n + 1):
                key = state << 8 | w[end - 1]
                state = move.get(key)
                if state is None:
                    state = far.get(key)
                    if state is None:
                        state = far[key] = self._moved(key >> 8, key & 255)
                states.append(state)
                for t, k in ends[state]:
                    p = last[end - k]
                    if p >= 0:
                        key = p << 20 | t
                        good = follows.get(key)
                        if good is None:
                            good = follows[key] = apart(p, t)
                        if not good:
                            continue
                    last.append(t)
                    size.append(k)
                    break
                else:
                    raise AssertionError("a prefix without a last token")
            out, end = [], n
            while end:
                out.append(last[end])
                end -= size[end]
            out.reverse()
            yield array("i", out).tobytes()
            before = w

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.old, self.known = self.known, self.special()
            new = words.difference(self.known)
        again = new.intersection(self.old)
        self.known.update((w, self.old[w]) for w in again)
        by_bytes = {w.encode(): w for w in new - again}
        order = sorted(by_bytes)
        for b, ids in zip(order, self.encode(order), strict=True):
            self.known[by_bytes[b]] = ids

    def encode_text(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of the texts."""
        split = [self.vocab.pretokens(t) for t in texts]
        self.learn({w for ws in split for w in ws})
        get = self.known.__getitem__
        blobs = [b"".join(map(get, ws)) for ws in split]
        lengths = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
        return np.concatenate(([0], np.cumsum(lengths))), np.frombuffer(b"".join(blobs), np.int32)


def _encoder(blob: bytes) -> TrieEncoder:
    key = hash(blob)
    if key not in _encoders:
        _encoders[key] = TrieEncoder(unpacked(blob))
    return _encoders[key]


def _other_fields(docs: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([docs.schema[c] for c in names])


class Decoder:
    """Ids to texts, by gathering the tokens' bytes."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(b) for b in tokens])))

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        lengths = (self.starts[1:] - self.starts[:-1])[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        data = self.flat[shift + np.arange(total)].tobytes()
        at = np.concatenate(([0], ends))[offsets]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, path: str | None = None, decoded: str | None = None) -> DataFrame:
    """``id_col`` (and the columns ``keep``) with ``token_ids``, array<int>, of each row's text.

    ``decoded`` names a column for the text that those ids stand for, decoded in
    the same pass: one worker process a core instead of two.
    """
    spark = docs.sparkSession
    ship(spark)
    blob = spark.sparkContext.broadcast(packed(path))
    names = [id_col, *(c for c in keep or [] if c != id_col)]
    fields = [*_other_fields(docs, names).fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([*fields, T.StructField(decoded, T.StringType())] if decoded else fields)

    def run(batches):
        encoder = _encoder(blob.value)
        decoder = Decoder(encoder.vocab.bytes) if decoded else None
        for batch in batches:
            column = batch.column(len(names))
            lengths = pa.compute.binary_length(column).fill_null(0).to_pylist()
            for a, b in text_slices(lengths, SLICE):
                offsets, ids = encoder.encode_text([x or "" for x in column.slice(a, b - a).to_pylist()])
                held = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                held.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                if decoder:
                    held.append(pa.array(decoder.texts(ids, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(held, names=schema.names)

    source = docs.select(*[docs[f"`{c}`"] for c in names], docs[f"`{text}`"].alias("_fs_text" if text in names else text))
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """The same rows with a column ``into``: the text that the ids stand for.

    Byte sequences that aren't UTF-8 (possible only for ids that ``encode``
    didn't make) become U+FFFD, as in the library.
    """
    spark = encoded.sparkSession
    ship(spark)
    blob = spark.sparkContext.broadcast(packed(path))
    names = [c for c in encoded.columns if c != into]
    schema = T.StructType([*_other_fields(encoded, names).fields, T.StructField(into, T.StringType())])

    def run(batches):
        decoder = Decoder(unpacked(blob.value).bytes)
        for batch in batches:
            column = batch.column(names.index(ids))
            counts = [x or 0 for x in pa.compute.list_value_length(column).to_pylist()]
            for a, b in text_slices(counts, SLICE // 3):
                flat = column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                texts = decoder.texts(flat, np.concatenate(([0], np.cumsum(counts[a:b]))))
                held = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(texts, pa.string())], names=[*names, into])

    return encoded.select(*[encoded[f"`{c}`"] for c in names]).mapInArrow(run, schema)
