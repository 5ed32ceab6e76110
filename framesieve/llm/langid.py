"""Language identification with a blended-spectrum string kernel.

k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G is the set of a text's
character 1- to 3-grams (presence, not counts), hashed to ``BINS`` bins.  Ridge
regression, one language against the rest, runs on Nystroem features of
landmark texts.  Kernel, whitening and weights are linear in the presence
vector, so a batch is scored by one product: presence x (bins x languages).

Training reads a bounded sample (documented parameters): of each of the
``MAX_LANGUAGES`` most frequent languages up to ``PER_LANGUAGE`` labelled documents, the
first in hash order of id and text, ``TOTAL_ROWS`` in all; documents of over ``TRAIN_CHARS``
characters come last and give ten pieces from all over the text.  Landmarks are
``LANDMARKS`` a language, ``TOTAL_LANDMARKS`` in all.  Prediction reads whole texts, and
nothing but texts.

``known`` is the share of a text's grams of letters that the sample of the predicted
language has: how well the text is covered by any learned language, which margins
and scores, being relative to the other languages, can't say.

Edge cases: null text, or a text without any letter, gives ``und`` with score 0;
so does every text if there is nothing to learn from (an empty table).  A null
doc_id counts as held out.  Repeated rows get equal results; equal margins go to
the language that sorts first.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framesieve.llm.common import checkpointed, ship, small_batches, trimmed

BINS = 1 << 15
GRAMS = 3
PER_LANGUAGE = 150
TOTAL_ROWS = 3000
LANDMARKS = 48
TOTAL_LANDMARKS = 800
TRAIN_CHARS = 20_000
PIECES = 10
MAX_LANGUAGES = 400
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Whether each code point is a letter.
_LETTERS = np.zeros(sys.maxunicode + 1, bool)
_MIX = np.uint32(0x9E3779B1)


def bins_of(text: str, letters: bool = False) -> list[np.ndarray]:
    """Bins of every 1- to 3-gram of the lower-cased text, with repeats; ``letters``: runs of anything else count as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if letters:
        own = letter_table()[c]
        c = np.where(own, c, np.uint32(32))[own | np.concatenate(([True], own[:-1]))]
    out, h = [], np.zeros(len(c), np.uint32)
    shift = np.uint32(32 - (BINS.bit_length() - 1))
    for n in range(GRAMS):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] ^ c[n:]) * _MIX
        h ^= h >> np.uint32(15)
        out.append((h * _MIX) >> shift)
    return out


def letter_table() -> np.ndarray:
    """Made once a process."""
    if not _LETTERS[65]:
        _LETTERS[:] = [chr(i).isalpha() for i in range(len(_LETTERS))]
    return _LETTERS


def presence(texts: list[str], letters: bool = False) -> np.ndarray:
    x = np.zeros((len(texts), BINS), bool)
    for i, t in enumerate(texts):
        for b in bins_of(t, letters):
            x[i, b] = True
    return x


class Classifier:
    """Languages, the matrix that turns presence (scaled) into one margin a language, and the bins that each language's sample has."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, seen: np.ndarray):
        self.languages, self.weights, self.bias, self.seen = languages, weights, bias, seen

    def margins(self, texts: list[str]) -> np.ndarray:
        x = presence(texts)
        return x.astype(np.float32) @ self.weights / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None] + self.bias

    def known(self, text: str | None, label: str) -> float:
        """Share of the text's letter grams that the label's sample has."""
        if label == UNKNOWN:
            return 0.0
        own = presence([text], True)[0]
        return float(np.count_nonzero(own & self.seen[self.languages.index(label)]) / np.count_nonzero(own))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for k in range(0, len(rows), 128):
            part = rows[k : k + 128]
            margins = self.margins([texts[i] for i in part])
            e = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
            best = margins.argmax(axis=1)
            for i, b, p in zip(part, best, e[np.arange(len(part)), best] / e.sum(axis=1), strict=True):
                labels[i], scores[i] = self.languages[b], round(float(p), 6)
        return labels, scores


def fit(rows: list[tuple[str, str]]) -> Classifier:
    """From (language, text), in a fixed order."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Classifier([], np.zeros((BINS, 0), np.float32), np.zeros(0), np.zeros((0, BINS), bool))
    scaled = lambda x: x.astype(np.float32) / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
    each = max(1, min(LANDMARKS, TOTAL_LANDMARKS // len(languages)))
    z = scaled(presence([t for lang in languages for t in [t for g, t in rows if g == lang][:each]]))
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > values.max() * 1e-6
    whiten = vectors[:, good] / np.sqrt(values[good])
    seen = np.zeros((len(languages), BINS), bool)
    kernel = []
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        kernel.append(scaled(presence([t for _, t in part])) @ z.T)
        for (lang, _), x in zip(part, presence([t for _, t in part], True), strict=True):
            seen[languages.index(lang)] |= x
    features = np.concatenate(kernel).astype(np.float64) @ whiten
    target = np.array([[1.0 if lang == g else -1.0 for g in languages] for lang, _ in rows])
    # Every language weighs the same, whatever its share of the sample.
    share = Counter(lang for lang, _ in rows)
    weight = np.array([1.0 / share[lang] for lang, _ in rows])[:, None]
    both = np.hstack((features, np.ones((len(rows), 1))))
    penalty = RIDGE * np.diag([1.0] * features.shape[1] + [0.0])
    solved = np.linalg.solve(both.T @ (both * weight) + penalty + 1e-9 * np.eye(both.shape[1]), both.T @ (target * weight))
    return Classifier(languages, (z.T.astype(np.float64) @ whiten @ solved[:-1]).astype(np.float32), solved[-1], seen)


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as 0."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier:
    """Learn from the sample; documents of fold 0 are never read for it."""
    d = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{lang}`"].alias("lang"), docs[f"`{text}`"].alias("text"))
    able = d.where((fold(F.col("id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    able = able.withColumn("long", F.length("text") > TRAIN_CHARS).withColumn("h", F.xxhash64("id", "text"))
    # The least hash of each of some slots a language: what is sampled stays small, and no language goes empty.
    slots = able.groupBy("lang", "long", F.pmod("h", F.lit(4 * PER_LANGUAGE)).alias("slot")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    slots = checkpointed(slots)
    top = slots.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not top:
        return fit([])
    each = max(1, min(PER_LANGUAGE, TOTAL_ROWS // len(top)))
    own = Window.partitionBy("lang").orderBy("long", "h")
    chosen = slots.where(F.col("lang").isin([r["lang"] for r in top])).withColumn("k", F.row_number().over(own)).where(F.col("k") <= each).select("lang", "h", "k")
    n = F.length("text")
    # Pieces of a long text: evenly spaced, the last one at its end.
    size = TRAIN_CHARS // PIECES
    piece = lambda i: F.substr("text", (1 + F.floor(i * (n - size) / (PIECES - 1))).cast("int"), F.lit(size))
    bounded = F.when(F.col("long"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece), " ")).otherwise(F.col("text"))
    found = able.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "k", bounded.alias("text")).dropDuplicates(["lang", "k"])  # at most TOTAL_ROWS
    return fit([(r["lang"], r["text"]) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["k"]))])


def predict(docs: DataFrame, model: Classifier, text: str = "text", known: bool = False) -> DataFrame:
    """Struct column ``row`` (all of the columns of ``docs``) with ``lang_pred``, ``score`` and, if asked for, ``known``."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("known", T.DoubleType())] * known])

    at = docs.columns.index(text)

    def with_text(batches):
        for batch in batches:  # the text is in the row: sent once only
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(at)], names=["row", "text"])

    def run(batches):
        for batch in small_batches(with_text(batches), 1):
            texts = batch.column(1).to_pylist()
            labels, scores = held.value.predict(texts)
            more = [pa.array([held.value.known(t, g) for t, g in zip(texts, labels, strict=True)], pa.float64())] * known
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores), *more], names=schema.names)

    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return packed.mapInArrow(trimmed(run), schema)
