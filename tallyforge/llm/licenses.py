"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word 2-gram hash of every text is joined with the positions that it has in the templates. A hit votes for the
diagonal (position in the text minus position in the template). Neighbouring diagonals of a template, as insertions and
deletions leave them, are merged, and a merged span is verified: the distinct template grams that it holds must cover at
least MIN_COVER of the template, within a span not much longer than the template. A base phrase counts where all its grams
stand on one diagonal, which is where its words stand consecutively. Templates are a small fixed list, or
a table of whole license texts; they are broadcast while their grams are at most TEMPLATE_ROWS. Texts aren't shuffled, only hits and
one row a document are.

Defined cases: a null or empty text has no words, no places, empty label lists and score 0; a row repeated gives its result
as often; a null doc_id is kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import table
from tallyforge.llm.words import WORD, grams, words

#: The phrases of the contract.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: How public licenses announce themselves.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
K = 2
MIN_COVER = 0.6
MERGE_GAP = 3
SENTINEL = 0
#: Up to so many grams of templates, at about 60 bytes, are broadcast.
TEMPLATE_ROWS = 500_000


def template_rows() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, base, grams of the template, position, word, next word)."""
    out = []
    for t, (text, label) in enumerate(BASE + TEMPLATES):
        cut = text.split()
        out += [(t, label, t < len(BASE), len(cut) - K + 1, p, cut[p], cut[p + 1]) for p in range(len(cut) - K + 1)]
    return out


def template_grams(templates: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """The grams of a table of license texts and labels, as those of the fixed list: gram, template, label, base, n_grams, tpos.
    Texts of a single word have no gram and are never found; a null label is blank."""
    cut = templates.select(F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label"), words(F.col(text_col).cast("string")).alias("words")).where(f"size(words) >= {K}").distinct()
    # told by the text, not by a row number, so that a lost executor changes nothing; the fixed phrases have small numbers
    keyed = cut.select("label", F.xxhash64("words", "label").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62)).alias("template"), (F.size("words") - (K - 1)).alias("n_grams"), grams("words", K).alias("grams"))
    each = keyed.select("label", "template", "n_grams", F.posexplode("grams").alias("tpos", "gram"))
    return each.select("gram", "template", "label", F.lit(False).alias("base"), "n_grams", "tpos")


def _templates(spark: SparkSession, templates: DataFrame | None = None) -> DataFrame:
    """The grams to look for, the phrases of the contract always among them, and the sentinel."""
    fixed = _fixed(spark)
    if templates is None:
        return F.broadcast(fixed)
    rows = fixed.where("base or template < 0").withColumn("template", F.col("template").cast("long")).unionByName(template_grams(templates))
    return F.broadcast(rows) if rows.count() <= TEMPLATE_ROWS else rows


def _fixed(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("template", "label", "base", "n_grams", "tpos", "w0", "w1"), strict=True))) for r in template_rows()))
    grams_ = spark.range(1).select(F.inline(rows)).select(F.xxhash64("w0", "w1").alias("gram"), "template", "label", "base", "n_grams", "tpos")
    return grams_.unionByName(spark.range(1).select(F.lit(SENTINEL).cast("long").alias("gram"), F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("n_grams"), F.lit(0).alias("tpos")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. ``templates``, a table of
    text and label, takes the place of the short list of notices that this module knows."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("print"), words(F.col(text_col).cast("string")).alias("words"))
    # the sentinel gram keeps documents without any hit
    rolled = cut.select("doc_id", "print", F.size("words").alias("n_words"), F.posexplode(F.concat(grams("words", K), F.array(F.lit(SENTINEL).cast("long")))).alias("pos", "gram"))
    hits = rolled.join(_templates(docs.sparkSession, templates), "gram")
    key = ["doc_id", "print", "n_words", "template", "label", "base", "n_grams"]
    diagonals = hits.groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("times"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("seen"))
    diagonals = diagonals.withColumn("votes", F.size("seen"))
    place = F.col("base") & (F.col("votes") == F.col("n_grams"))
    whole = F.when(F.col("template") < 0, True).when(F.col("base"), place).otherwise(F.col("votes") > 1)
    strong = diagonals.where(whole)
    by = Window.partitionBy("doc_id", "print", "template").orderBy("diagonal")
    new = F.when(F.col("base") | (F.col("template") < 0), 1).when(F.col("diagonal") - F.lag("diagonal").over(by) <= MERGE_GAP, 0).otherwise(1)
    runs = strong.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*key, "run").agg(F.min("diagonal").alias("start"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("covered"), F.max("times").alias("times"))
    cover = F.col("covered") / F.col("n_grams")
    verified = (F.col("template") >= 0) & (cover >= MIN_COVER) & (F.col("hi") - F.col("lo") <= 2 * F.col("n_grams"))
    base = F.col("base")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("doc_id", "print").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(verified).alias("labels"),
        F.round(F.coalesce(F.max(F.when(verified, cover)), F.lit(0.0)), 6).alias("score"),
        F.max(F.when(F.col("template") < 0, F.col("times"))).cast("int").alias("times"),
    )
    # rows that repeat were folded; their result is given as often
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_", "times", "print")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


_VALUES = ",\n".join(f"({t}, '{label}', {str(base).lower()}, {n}, {p}, '{a}', '{b}')" for t, label, base, n, p, a, b in template_rows())
OP6_SQL = rf"""
WITH templates(template, label, base, n_grams, tpos, w0, w1) AS (VALUES {_VALUES}),
cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents
),
rolled AS (SELECT doc_id, unnest(range(len(words) - 1)) AS pos, unnest(words[:-2]) AS w0, unnest(words[2:]) AS w1 FROM cut WHERE len(words) > 1),
diagonals AS (
  SELECT doc_id, template, label, base, n_grams, pos - tpos AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi, list(DISTINCT tpos) AS seen
  FROM rolled JOIN templates USING (w0, w1) GROUP BY ALL
),
strong AS (SELECT * FROM diagonals WHERE CASE WHEN base THEN votes = n_grams ELSE votes > 1 END),
marked AS (
  SELECT *, CASE WHEN base THEN 1 WHEN diagonal - lag(diagonal) OVER w <= {MERGE_GAP} THEN 0 ELSE 1 END AS new
  FROM strong WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)
),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM marked),
spans AS (
  SELECT doc_id, template, label, base, n_grams, run, min(diagonal) AS start, min(lo) AS lo, max(hi) AS hi, len(list_distinct(flatten(list(seen)))) AS covered
  FROM runs GROUP BY doc_id, template, label, base, n_grams, run
),
judged AS (SELECT *, covered / n_grams AS cover, covered / n_grams >= {MIN_COVER} AND hi - lo <= 2 * n_grams AS verified FROM spans),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified) AS labels, round(max(cover) FILTER (WHERE verified), 6) AS score
  FROM judged GROUP BY doc_id
)
SELECT c.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM cut c LEFT JOIN by_doc b ON c.doc_id = b.doc_id
"""
