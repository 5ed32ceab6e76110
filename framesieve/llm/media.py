"""Interleaved documents: ordered text and media references, with payloads behind digests.

``interleave`` parses HTML into one ordered array of segments; a media segment
has its reference's digest, its caption and its position.  ``resolve`` joins
sequences to a media table by digest; a segment keeps its place and caption whether
or not its payload is found.

``media_features`` cuts a document's padded text into slices of at most ``SLICE`` bytes.
``store`` keeps each as a lossless PNG of 8-bit RGB samples, 64 pixels (192 bytes) a row,
in a written table, under the digest of its samples.  ``pages`` writes the document as HTML:
before each slice's figure the stretch of text that it goes with.  The pages are parsed, their
references resolved, and what was stored is read back: by digest where one
slice is the document, else brought together by document in order of position.

Edge cases: null HTML has no segments; a null text is stored as empty, i.e. one
row of blanks; a repeated digest resolves to one payload; unknown digests
resolve to null; what stands in silent elements (scripts, heads, templates) is no
segment; repeated rows have a row each; empty tables give empty ones.  A media
table's columns that clash with a sequence's get the suffix ``_media``.
"""

from __future__ import annotations

import hashlib
import html as markup
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm.common import checkpointed, ship, small_batches, trimmed
from framesieve.llm.nearcopies import row_id

ROW = 192
SLICE = 256 * ROW
SCHEME = "sha256:"
_MAGIC = b"\x89PNG\r\n\x1a\n"  # fixed value: PNG's signature
SEGMENT = "struct<position:int,kind:string,text:string,ref:string,digest:string,caption:string>"
_SILENT = {"script", "style", "template", "noscript", "head", "title"}
_MEDIA = {"img", "audio", "video", "source", "embed"}


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None

    def _text(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append({"position": len(self.out), "kind": "text", "text": text, "ref": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif self.silent:
            return
        elif tag == "figure":
            self._text()
            self.figure = []
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        elif tag in _MEDIA:
            self._text()
            own = dict(attrs)
            ref = own.get("src") or ""
            if ref:
                digest = ref[len(SCHEME) :].lower() if ref.startswith(SCHEME) else hashlib.sha256(ref.encode()).hexdigest()
                if self.figure is not None:
                    self.figure.append(len(self.out))
                self.out.append({"position": len(self.out), "kind": "media", "text": None, "ref": ref, "digest": digest, "caption": own.get("alt")})
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr", "article", "section"):
            self._text()

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            for i in self.figure or []:
                self.out[i]["caption"] = " ".join("".join(self.caption).split())
            self.caption = None
        elif tag == "figure":
            self._text()
            self.figure = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "tr", "article", "section"):
            self._text()

    def handle_data(self, data):
        if self.silent:
            return
        (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    reader = _Sequence()
    reader.feed(html or "")
    reader.close()
    reader._text()
    return reader.out


def interleave(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """Per row: ``id_col`` and ``segments``, in reading order."""
    ship(pages.sparkSession)
    schema = T.StructType([pages.schema[id_col], T.StructField("segments", T._parse_datatype_string(f"array<{SEGMENT}>"))])
    kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "ref", "digest", "caption"))]))

    def run(batches):
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(x.as_py()) for x in batch.column(1)], kind)], names=[id_col, "segments"])

    return pages.select(pages[f"`{id_col}`"], pages[f"`{html}`"].alias("_fs_html" if html == id_col else html)).mapInArrow(trimmed(run), schema)


def resolve(sequences: DataFrame, media: DataFrame, id_col: str, digest: str = "digest") -> DataFrame:
    """One row per media segment: ``id_col``, position, caption, digest, then the media table's other columns."""
    refs = sequences.select(F.col(f"`{id_col}`"), F.explode("segments").alias("_s")).where("_s.kind = 'media'")
    refs = refs.select(F.col(f"`{id_col}`"), F.col("_s.position").alias("position"), F.col("_s.caption").alias("caption"), F.col("_s.digest").alias(digest))
    clear = media.select(*(F.col(f"`{c}`").alias(f"{c}_media" if c != digest and c in refs.columns else c) for c in media.columns))
    return refs.join(clear, digest, "left")


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def to_png(payload: bytes) -> bytes:
    """RGB, 8 bits a sample, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of a picture that ``to_png`` made; checks every chunk."""
    if stored[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, shape = 8, b"", None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        name, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(name + data):
            raise ValueError("a damaged chunk")
        if name == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif name == b"IDAT":
            body += data
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[1], 3 * shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, deviation, entropy of the samples, and their 16-bin histogram."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256)
    share = p[p > 0] / len(x)
    mean = float((np.arange(256) * p).sum() / len(x))
    spread = float(np.sqrt(max(0.0, (np.arange(256) ** 2 * p).sum() / len(x) - mean * mean)))
    bins = ".".join(map(str, p.reshape(16, 16).sum(axis=1)))
    return f"rgb{ROW // 3}x{len(x) // ROW};mean={mean:.4f};sd={spread:.4f};bits={float(-(share * np.log2(share)).sum()):.4f};hist={bins}"


def slices(text: str | None) -> list[bytes]:
    """The padded text in order, each of at most ``SLICE`` bytes and whole rows."""
    payload = padded(text)
    return [payload[i : i + SLICE] for i in range(0, len(payload), SLICE)]


def page(text: str | None) -> str:
    """The document as HTML: each slice's stretch of text, and a figure that refers to the slice."""
    text, parts = text or "", slices(text)
    n, size = len(parts), len(text.encode())
    out = []
    for k, part in enumerate(parts):
        stretch = markup.escape(text[k * len(text) // n : (k + 1) * len(text) // n])
        out.append(f'<p>{stretch}</p><figure><img src="{SCHEME}{hashlib.sha256(part).hexdigest()}"><figcaption>{k + 1} of {n}, {size} bytes</figcaption></figure>')
    return f"<article>{''.join(out)}</article>"


def pages(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Per row: ``id_col`` and ``html``."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page(t) for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "html"])

    return docs.select(docs[f"`{id_col}`"], docs[f"`{text}`"].alias("_fs_text")).mapInArrow(trimmed(run), T.StructType([docs.schema[id_col], T.StructField("html", T.StringType())]))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per slice of each row: ``digest`` of its samples, ``media`` (the stored form), ``part`` (whether it is one of several)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in small_batches(batches, 0):
            cut = [slices(t) for t in batch.column(0).to_pylist()]
            flat = [(x, len(parts) > 1) for parts in cut for x in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(x).hexdigest() for x, _ in flat], pa.string()), pa.array([to_png(x) for x, _ in flat], pa.binary()), pa.array([several for _, several in flat], pa.bool_())],
                names=["digest", "media", "part"],
            )

    return docs.select(docs[f"`{text}`"].alias("_fs_text")).mapInArrow(trimmed(run), "digest string, media binary, part boolean")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = [x.split()[0] for x in _FEATURES.split(", ")]


def read_features(stored: list[bytes]) -> tuple:
    """Of a payload that is stored in these pieces, from the stored bytes."""
    payload, whole = b"".join(map(from_png, stored)), b"".join(stored)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(whole), hashlib.sha256(whole).hexdigest(), feature(payload)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]


def _once(media: DataFrame) -> DataFrame:
    # Grouped by more than the digest, so that a later join deals by digest anew and may split hot ones.
    return media.groupBy("digest", F.xxhash64("digest").alias("_fs_h")).agg(*(F.first(c).alias(c) for c in media.columns if c != "digest")).drop("_fs_h")


def read_back(media: DataFrame) -> DataFrame:
    """Per digest: what ``read_features`` tells of the stored bytes."""
    ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns([read_features([m.as_py()]) for m in batch.column(1)])], names=["digest", *_NAMES])

    return _once(media.select("digest", "media").mapInArrow(trimmed(run), f"digest string, {_FEATURES}"))


def reassemble(found: DataFrame) -> DataFrame:
    """``found`` (row, position, total, n_bytes, media) to (id, n_bytes, slices, features): the pieces of each document in order of position."""
    ship(found.sparkSession)
    kind = found.schema["row"].dataType["id"].dataType

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("position", "total", "media")), strict=True), key=lambda r: r[0])
        copies = sum(r[0] == rows[0][0] for r in rows)  # of rows that are equal in id and text
        pieces = [r[2] for r in rows[::copies]]
        if len(pieces) != rows[0][1] or None in pieces:
            raise ValueError(f"{len(pieces)} pieces of {rows[0][1]}")
        one = read_features(pieces)
        ids = table.column("row").combine_chunks().field("id").take(pa.array([0] * copies))
        return pa.table([ids, table.column("n_bytes").take(pa.array([0] * copies)), pa.array([len(pieces)] * copies, pa.int64()), *_columns([one] * copies)], names=["id", "n_bytes", "slices", *_NAMES])

    schema = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("slices", T.LongType()), *T.StructType.fromDDL(_FEATURES).fields])
    return found.select("row", "position", "total", "n_bytes", "media").groupBy("row").applyInArrow(run, schema)


def media_features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes, the features of what its media hold, and ``slices``, their number."""
    rows = docs.select(row_id(id_col, text).alias("row"), docs[f"`{text}`"].alias("text"))
    stored = checkpointed(store(rows))
    sequences = interleave(pages(rows, "row"), "row")
    refs = sequences.select("row", F.filter("segments", lambda s: s["kind"] == "media").alias("segments"))

    def told(found: DataFrame) -> DataFrame:
        return found.withColumn("total", F.regexp_extract("caption", "of ([0-9]+),", 1).cast("int")).withColumn("n_bytes", F.regexp_extract("caption", ", ([0-9]+) bytes", 1).cast("bigint"))

    alone = told(resolve(refs.where(F.size("segments") == 1), read_back(stored.where("not part")), "row"))
    several = told(resolve(refs.where(F.size("segments") > 1), _once(stored.where("part").select("digest", "media")), "row"))
    both = alone.select(F.col("row.id").alias("id"), "n_bytes", F.lit(1).cast("bigint").alias("slices"), *_NAMES).unionByName(reassemble(several))
    return both.select(F.col("id").alias(id_col), "n_bytes", *_NAMES, "slices")
