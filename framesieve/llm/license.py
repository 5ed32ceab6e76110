"""Licence notices by diagonal voting; DataFrame operations only.

Every rolling 2-gram of words is hashed and joined to the 2-grams of the notice
templates (a fixed table of a few hundred rows, so broadcast).  A hit at word p
of a document and q of a template votes for the diagonal p - q; votes are a
bit mask of template positions, combined map-side.  Diagonals within ``SLACK``
of one another merge (words inserted or left out), and a span is verified by
its words: those of a 2-gram that it has are covered, ``COVERAGE`` of the notice's words
and every word of ``NAMES`` have to be.  Notices under ``SHORT`` words and those of Creative
Commons variants, which differ by one word from each other, have to stand word
for word.  Hits compare the words too, so equal hashes of other words don't count.

A document's last word, which begins no 2-gram, meets a template row of its own and
carries the document through: texts are read once and every document has a row.

Edge cases: a null text has no words, labels "" and score 0.  Rows that share a
doc_id are told apart by a hash of their text; equal rows get equal results, one
row each.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLACK = 3
COVERAGE = 0.85
SHORT = 8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the base scan.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Notices as their projects word them, lower-cased.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


# Words that tell a licence from others.
NAMES = {"apache", "general", "gnu", "lesser", "mit", "mozilla", "public"}
#: Number of the template row that each document's end meets.
_END = -1


def notices() -> list[tuple[int, str, bool, bool, list[str], int]]:
    """(template, label, phrase, exact, words, mask of the words that have to be there)."""
    out = []
    for n, (label, text, phrase) in enumerate([*((k, v, True) for k, v in PHRASES.items()), *((k, v, False) for k, v in NOTICES)]):
        w = text.split()
        out.append((n, label, phrase, phrase or len(w) < SHORT or label.startswith("cc-"), w, sum(1 << i for i, x in enumerate(w) if x in NAMES)))
    return out


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, exact, words, must, q, t1, t2, gram): one row per 2-gram, and one for the ends of documents."""
    rows = [f"({n}, '{label}', {phrase}, {exact}, {len(w)}, {must}L, {q}, '{a}', '{b}')" for n, label, phrase, exact, w, must in notices() for q, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    rows.append(f"({_END}, '', true, true, 2, 0L, 0, '', '')")
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, phrase, exact, words, must, q, t1, t2)")
    return table.withColumn("gram", F.when(F.col("template") == _END, F.lit(0).cast("bigint")).otherwise(F.xxhash64("t1", "t2")))


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _lowest(mask: Column) -> Column:
    """Index of the lowest set bit."""
    return F.bit_count(mask.bitwiseAND(-mask) - 1)


def _found(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, sig, label, template, phrase, start, stop, coverage, copies): verified spans, and a row for each document's end."""
    words = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("sig"), words_of(docs[f"`{text}`"]).alias("words"))
    pairs = words.select("id", "sig", F.posexplode_outer(F.arrays_zip(F.col("words").alias("w1"), F.slice("words", 2, 2147483647).alias("w2"))).alias("p", "x"))
    gram = F.when(F.col("x.w2").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64("x.w1", "x.w2"))
    grams = pairs.select("id", "sig", "p", F.col("x.w1").alias("w1"), F.col("x.w2").alias("w2"), gram.alias("gram"))
    # The long alone is the join's key; the words then confirm the hit (as ranges, or Catalyst makes them keys too).
    same = f"CASE WHEN template = {_END} THEN w2 IS NULL ELSE w1 >= t1 AND w1 <= t1 AND w2 >= t2 AND w2 <= t2 END"
    hits = grams.join(F.broadcast(templates(docs.sparkSession)), "gram").where(same)
    own = ("id", "sig", "template", "label", "phrase", "exact", "words", "must")
    diagonals = hits.groupBy(*own, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, q)")).alias("mask"), F.count("*").alias("copies"))
    # What is exact stands on one diagonal.  Another notice may shift.
    row = Window.partitionBy("id", "sig", "template").orderBy("diagonal")
    apart = F.when(~F.col("exact") & (F.col("diagonal") - F.lag("diagonal").over(row) <= SLACK), 0).otherwise(1)
    runs = diagonals.withColumn("apart", apart).withColumn("run", F.sum("apart").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("diagonal") + _lowest(F.col("mask"))
    top = F.floor(F.log2(F.col("mask").cast("double"))).cast("int")
    merged = runs.groupBy(*own, "run").agg(F.bit_or("mask").alias("mask"), F.min(start).alias("start"), F.max(F.col("diagonal") + top + 2).alias("stop"), F.max("copies").alias("copies"))
    covered = merged.withColumn("has", F.col("mask").bitwiseOR(F.shiftleft("mask", 1))).withColumn("coverage", F.bit_count("has") / F.col("words"))
    enough = F.when(F.col("exact"), F.bit_count("mask") == F.col("words") - 1).otherwise((F.col("coverage") >= COVERAGE) & (F.col("has").bitwiseAND(F.col("must")) == F.col("must")))
    return covered.where(enough).select("id", "sig", "label", "template", "phrase", "start", "stop", "coverage", "copies")


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sig, label, template, phrase, start, stop, coverage): verified spans, words from 0, stop exclusive."""
    return _found(docs, id_col, text).where(F.col("template") != _END).drop("copies")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best coverage of a verified span, 0 without one.
    """
    end = F.col("template") == _END
    base = F.col("phrase") & ~end
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_doc = _found(docs, id_col, text).groupBy("id", "sig").agg(
        F.max(F.when(end, F.coalesce(F.col("start") + 1, F.lit(0)))).cast("bigint").alias("n_words"),
        F.max(F.when(end, F.col("copies"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(~end, F.col("label"))).alias("labels"),
        F.coalesce(F.round(F.max(F.when(~end, F.col("coverage"))), 6), F.lit(0.0)).alias("score"),
    )
    every = by_doc.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return every.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
