"""Personal data: patterns propose, checksums confirm, context adjusts.

Everything is a row-local Catalyst expression: no shuffle, no Python.  A
pattern's matches and the gaps between them are two arrays of equal order, so
code-point positions are a running sum of their lengths.  Sums and redacted pieces
are made by blocks of ``BLOCK`` matches, as an array that grows is copied at every step:
a text of many matches costs its length, not its square.

Base kinds (``email ip card phone``) keep every valid leftmost match.  The
method adds spans that those greedy patterns swallow: a card or phone number
glued to neighbouring numbers is searched inside the *rejected* candidate, and
``iban`` (mod-97), ``ssn`` and ``secret`` have patterns of their own.  Added
spans carry a score: pattern weight + checksum + context words in the 48
characters before; those under ``THRESHOLD`` are dropped.

Edge cases: a null text counts as empty (no spans; ``redact`` keeps it null).
Repeated rows are handled one by one; an empty table gives an empty one.  Patterns are possessive or anchored, so
a long run of class characters costs linear time and no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
THRESHOLD = 0.6
CONTEXT = 48
BLOCK = 64
#: Characters of the shortest candidate that can be of a kind.
LEAST = {"card": 9, "phone": 9}

# Possessive forms of the contract's patterns: equal matches, linear time.  An
# e-mail address starts a run of its class, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[a-z0-9_./+-]{16,}+",
}
#: Searched inside candidates that failed.
INNER = {
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20-]?)[0-9]{6}\2[0-9]{5}|[0-9]{17,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+(?:1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|[2-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,4})(?![0-9])",
}
#: Words that make a kind likelier.
CONTEXT_WORDS = {
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|contact|telefon|appel|llam",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
    "ssn": "ssn|social|security|tax|identity",
    "secret": "key|token|secret|password|auth|credential",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"


def _zipped(found: Column, text: Column, pattern: str) -> Column:
    """array<struct<m, g>>: each match and the gap before it; null if there is none."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.when(F.size(found) > 0, F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))))


def _pairs(text: Column, pattern: str) -> Column:
    return _zipped(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), text, pattern)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _blocks(rows: Column) -> Column:
    """The array in runs of ``BLOCK``; it mustn't be empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))


def _before(blocks: Column, of_block, join) -> Column:
    """For each block what ``join`` has made of the earlier blocks' values, from 0."""
    step = lambda acc, x: F.struct(join(acc["p"], x).alias("p"), F.concat(acc["o"], F.array(acc["p"])).alias("o"))
    start = F.struct(F.lit(0).cast("bigint").alias("p"), F.array().cast("array<bigint>").alias("o"))
    return F.aggregate(F.transform(blocks, of_block), start, step, lambda a: a["o"])


def _spans(pairs: Column, least: int = 0) -> Column:
    """array<struct<s, e, m, c>> of matches of at least so many characters, with positions and the lower-cased context before."""
    kind = "array<struct<s:bigint,e:bigint,m:string,c:string>>"
    width = lambda x: (F.length(x["g"]) + F.length(x["m"])).cast("bigint")

    def step(acc, x):
        s = acc["p"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.lower(F.right(x["g"], F.lit(CONTEXT))).alias("c"))
        grown = F.concat(acc["o"], F.array(one))
        return F.struct(e.cast("bigint").alias("p"), (F.when(F.length(x["m"]) >= least, grown).otherwise(acc["o"]) if least else grown).alias("o"))

    def located(block, p):
        return F.aggregate(block, F.struct(p.alias("p"), F.array().cast(kind).alias("o")), step, lambda a: a["o"])

    def whole(blocks):
        starts = _before(blocks, lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda n, x: n + width(x)), lambda p, n: p + n)
        return F.flatten(F.zip_with(blocks, starts, located))

    found = _let(pairs, lambda p: F.when(p.isNotNull(), _let(_blocks(p), whole)))
    return F.coalesce(found, F.array().cast(kind))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Of a digit string, by its characters from the right."""
    chars = F.split(F.reverse(d), "")

    def add(acc, x):
        n = x["c"].cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.struct((acc["t"] + F.when(acc["odd"], n).otherwise(twice)).alias("t"), (~acc["odd"]).alias("odd"))

    parts = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.struct(c.alias("c")))
    return F.aggregate(parts, F.struct(F.lit(0).alias("t"), F.lit(True).alias("odd")), add, lambda a: a["t"] % 10 == 0)


def _mod97(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    letters = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), add) == 1


def _base_valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(OCTETS)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(8, 15)


def _near(kind: str, context: Column) -> Column:
    return F.when(context.rlike(CONTEXT_WORDS[kind]), F.lit(0.2)).otherwise(F.lit(0.0))


def _score(kind: str, m: Column, context: Column) -> Column:
    """0 to 1, for spans the method adds."""
    if kind == "card":
        return F.when(_luhn(_digits(m)), F.lit(0.7)).otherwise(F.lit(0.1)) + _near(kind, context)
    if kind == "iban":
        return F.when(_mod97(m), F.lit(0.8)).otherwise(F.lit(0.1)) + _near(kind, context)
    if kind == "ssn":
        return F.lit(0.4) + F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), F.lit(0.1)).otherwise(F.lit(-0.4)) + _near(kind, context)
    if kind == "secret":
        # A value without any digit is prose, not a key.
        return F.when(m.rlike(r"[0-9][^0-9]*[0-9]"), F.lit(0.7)).otherwise(F.lit(0.2)) + F.lit(0.1)
    return F.lit(0.6) + _near(kind, context)


_OUT = "array<struct<s:bigint,e:bigint,score:double>>"


def _inner(kind: str, failed: Column) -> Column:
    """Spans of ``kind`` inside rejected candidates."""

    def one(c):
        found = _spans(_pairs(c["m"], INNER[kind]))
        return F.transform(found, lambda x: F.struct((c["s"] + x["s"]).alias("s"), (c["s"] + x["e"]).alias("e"), _score(kind, x["m"], F.concat(c["c"], x["c"])).alias("score")))

    return F.filter(F.flatten(F.transform(failed, one)), lambda x: x["score"] >= THRESHOLD)


def _with_candidates(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    guard = {"email": t.contains("@"), "phone": t.contains("+"), "secret": t.rlike("[:=]")}
    # One projection each, so that no scan of the text is inlined twice.
    found = {k: F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    df = df.withColumns({f"_m_{k}": F.when(guard[k], found[k]) if k in guard else found[k] for k in PATTERNS})
    df = df.withColumns({f"_p_{k}": _zipped(F.col(f"_m_{k}"), t, p) for k, p in PATTERNS.items()})
    return df.withColumns({f"_c_{k}": _spans(F.col(f"_p_{k}"), LEAST.get(k, 0)) for k in PATTERNS})


def _annotated(df: DataFrame, text: str) -> DataFrame:
    """``df`` (whose own columns mustn't start with ``_``) with ``base``, ``spans`` and n_<kind>."""
    df = _with_candidates(df, text)
    plain = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(1.0).alias("score"))
    valid = lambda k: lambda x: _base_valid(k, x["m"])
    scored = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _score(k, x["m"], x["c"]).alias("score"))
    cols = {f"_b_{k}": F.transform(F.filter(F.col(f"_c_{k}"), valid(k)), plain) for k in BASE_KINDS}
    long_enough = F.filter(F.col("_c_card"), lambda x: (F.length(x["m"]) >= 9) & ~_base_valid("card", x["m"]))
    cols["_x_card"], cols["_x_ssn"] = _inner("card", long_enough), _inner("ssn", long_enough)
    cols["_x_phone"] = _inner("phone", F.filter(F.col("_c_phone"), lambda x: ~_base_valid("phone", x["m"])))
    for k in ("iban", "secret"):
        cols[f"_x_{k}"] = F.filter(F.transform(F.col(f"_c_{k}"), scored(k)), lambda x: x["score"] >= THRESHOLD)
    df = df.withColumns(cols)
    tagged = lambda k, a: F.transform(a, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["score"].alias("score")))
    every = []
    for k in KINDS:
        found = [F.col(c) for c in (f"_b_{k}", f"_x_{k}") if c in cols]
        every.append(tagged(k, F.array_sort(F.concat(*found)) if len(found) > 1 else found[0]))
    new = {f"n_{k}": F.size(F.col(f"_b_{k}")).cast("bigint") for k in BASE_KINDS}
    return df.withColumns(new | {"base": F.concat(*(tagged(k, F.col(f"_b_{k}")) for k in BASE_KINDS)), "spans": F.concat(*every)})


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_<kind> and ``base`` and ``spans``, arrays of struct<kind, s, e, score>.

    Sorted by kind in the order of ``KINDS``, then start; positions are code
    points, the end exclusive.  Base spans have score 1; n_<kind> counts them.
    """
    df = _annotated(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text")
    return df.select(F.col("id").alias(id_col), *(f"n_{k}" for k in BASE_KINDS), "base", "spans")


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns; each span that ``detect`` reports becomes ``[KIND]``.

    Overlapping spans merge, and the placeholder names the kind that starts
    first.  Texts without spans, null ones too, stay as they are.
    """
    holder = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    spans = _annotated(holder, "text")

    t = F.col("text")
    cut = lambda x, start, n: F.substr(x, (start + 1).cast("int"), n.cast("int"))
    last = lambda block: F.array_max(F.transform(block, lambda x: x["e"]))

    def pieces(block, p):
        def text_of(own):
            def step(acc, x):
                gap = cut(own, acc["p"] - p, x["s"] - acc["p"])
                grown = F.concat(acc["o"], F.array(gap, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
                return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.when(x["s"] >= acc["p"], grown).otherwise(acc["o"]).alias("o"))

            return F.aggregate(block, F.struct(p.alias("p"), F.array().cast("array<string>").alias("o")), step, lambda a: F.array_join(a["o"], ""))

        return _let(cut(t, p, F.greatest(last(block) - p, F.lit(0))), text_of)

    def whole(blocks):
        starts = _before(blocks, last, F.greatest)
        end = F.array_max(F.transform(blocks, last))
        return F.concat(F.array_join(F.zip_with(blocks, starts, pieces), ""), F.substr(t, (end + 1).cast("int")))

    order = F.array_sort(F.transform(F.col("spans"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    done = _let(order, lambda spans: _let(_blocks(spans), whole))
    new = F.when(F.size("spans") > 0, done).otherwise(t)
    return spans.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
