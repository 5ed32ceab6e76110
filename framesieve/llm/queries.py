"""Queries of this subpackage, their DuckDB SQL, and the digests their contracts ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm import bpe, decontam, langid, license, lm, media, pii, simhash, substring, tokcount
from framesieve.llm.common import table


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        _sha(pii.render(F.col("base"))).alias("base_sha256"),
        pii.render(F.col("spans")).alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents"), decoded="decoded")
    return both.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        _sha(F.array_join(F.col("token_ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha("decoded").alias("decoded_sha256"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", _sha("kept").alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.token_counts(table(spark, sf_dir, "documents"))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Only what a prediction may see goes in, beside the id that it is reported under.
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("row.doc_id", (langid.fold(F.col("row.doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_bpe": op2_bpe,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_simhash": op4_simhash,
        "op5_token_counts": op5_token_counts,
        "op6_license": op6_license,
        "op7_media": op7_media,
        "op8_lm_score": op8_lm_score,
        "op9_decontamination": op9_decontamination,
        "op10_language": op10_language,
    }


#: SQL for the operators that it can express whole; the others are tested against brute force in tests/llm.
_OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
hits AS (SELECT windows.doc_id, i FROM windows JOIN first USING (k) WHERE m < windows.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, range(0, 50) r(j)),
words AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
sums AS (SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(t, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS kept FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""


def _op6() -> str:
    """The same votes in SQL: templates as a list of values, 2-grams joined by their words."""
    rows = [f"({n}, '{label}', {phrase}, {exact}, {len(w)}, {must}, {q}, '{a}', '{b}')" for n, label, phrase, exact, w, must in license.notices() for q, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    return rf"""
WITH t(template, label, phrase, exact, words, must, q, w1, w2) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license.WORD}') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d),
diagonals AS (
  SELECT doc_id, template, label, phrase, exact, words, must, i - 1 - q AS diagonal, bit_or(CAST(1 AS BIGINT) << q) AS mask, min(q) AS low
  FROM g JOIN t ON g.w[i] = t.w1 AND g.w[i + 1] = t.w2 GROUP BY ALL),
apart AS (SELECT *, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER own <= {license.SLACK} THEN 0 ELSE 1 END AS a FROM diagonals WINDOW own AS (PARTITION BY doc_id, template ORDER BY diagonal)),
runs AS (SELECT *, sum(a) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM apart),
merged AS (SELECT doc_id, template, label, phrase, exact, words, must, run, bit_or(mask) AS mask, min(diagonal + low) AS start FROM runs GROUP BY ALL),
covered AS (SELECT *, mask | (mask << 1) AS has, bit_count(mask | (mask << 1)) / words AS coverage FROM merged),
good AS (SELECT * FROM covered WHERE CASE WHEN exact THEN bit_count(mask) = words - 1 ELSE coverage >= {license.COVERAGE} AND (has & must) = must END),
sums AS (
  SELECT doc_id, count(*) FILTER (WHERE phrase) AS n_base, min(start) FILTER (WHERE phrase) AS first_word, max(start) FILTER (WHERE phrase) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(coverage), 6) AS score
  FROM good GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN sums USING (doc_id)
"""


#: Every alignment of every item, by equal words; n words of an item have to meet, ``need`` of them equal.
_OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{license.WORD}') AS w FROM documents),
i AS (SELECT item_id, len(q) AS size, least(len(q), {decontam.WINDOW}) AS n, CAST(ceil({decontam.SIMILARITY} * least(len(q), {decontam.WINDOW}) - 1e-9) AS BIGINT) AS need, q FROM (SELECT item_id, regexp_extract_all(lower(text), '{license.WORD}') AS q FROM benchmark) WHERE len(q) > 0),
dw AS (SELECT doc_id, len(w) AS words, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, size, n, need, unnest(q) AS word, generate_subscripts(q, 1) - 1 AS k FROM i),
m AS (SELECT doc_id, words, item_id, size, n, need, p - k AS g, list(k) AS ks FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= need),
j AS (SELECT *, unnest(range(0, size - n + 1)) AS a FROM m),
good AS (SELECT * FROM j WHERE g + a >= 0 AND g + a + n <= words AND len(list_filter(ks, lambda x: x >= a AND x < a + n)) >= need),
ends AS (SELECT doc_id, item_id, g, ks, min(a) AS lo, max(a) + n AS hi FROM good GROUP BY doc_id, item_id, g, n, ks),
spans AS (SELECT doc_id, item_id, g + lo AS start, g + hi AS stop, len(list_filter(ks, lambda x: x >= lo AND x < hi)) AS matching FROM ends),
marked AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc_id, item_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first FROM spans),
runs AS (SELECT *, sum(first) OVER (PARTITION BY doc_id, item_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, CAST(max(matching) AS BIGINT) AS matching FROM runs GROUP BY doc_id, item_id, run
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": _OP9, "op3_substring_dedup": _OP3, "op6_license": _op6()}
