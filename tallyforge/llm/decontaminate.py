"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A benchmark item is contaminated in a document when the document holds at least CONTAINMENT of the item's distinct word
5-gram shingles (an item of fewer words is one shingle of all its words). Items are partitioned by size: class c holds
items of 2 ** (c - 1) to 2 ** c - 1 shingles, and the class's upper size fixes how many of an item's smallest MinHash values
are its sketch. The number is such that a document with enough of the item's shingles holds at least one of the sketch, so
no pair is missed, however long the document. Documents probe the sketches with all their shingles; candidates are then
verified by exact containment, over the candidate documents only.

Sketches and candidate ids are broadcast only while their counted rows are at most BROADCAST_ROWS, else they're joined by
shuffles. Defined cases: null and empty texts match nothing, rows that share a doc_id (null included) are one document, of
items that share an item_id the shingles are united, empty tables give no rows, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, table
from tallyforge.llm.words import WORD, grams, words

SHINGLE = 5
#: Containment as a fraction, so that it's compared in integers.
CONTAINMENT = (4, 5)
#: 48 bytes a row in a broadcast relation: at most 24 MB.
BROADCAST_ROWS = 500_000


def _bounded(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _shingles(rows: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """key, size, shingle: every rolling shingle of each of the sizes, repeats included."""
    cut = rows.select(key, words(F.col(text)).alias("words"))
    sets = F.array(*(F.struct(F.lit(k).alias("size"), grams("words", k).alias("shingles")) for k in sizes))
    if len(sizes) == 1:
        return cut.select(key, F.lit(sizes[0]).alias("size"), F.explode(grams("words", sizes[0])).alias("shingle"))
    return cut.select(key, F.inline(sets)).select(key, "size", F.explode("shingles").alias("shingle"))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, size, shingle, n_item and whether the shingle is of the item's sketch."""
    cut = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    per = cut.select("item_id", F.least(F.size("words"), F.lit(SHINGLE)).alias("size"), F.coalesce(*(F.when(F.least(F.size("words"), F.lit(SHINGLE)) == k, grams("words", k)) for k in range(1, SHINGLE + 1))).alias("shingles"))
    each = per.select("item_id", "size", F.explode("shingles").alias("shingle")).distinct()
    each = each.withColumn("n_item", F.count("*").over(Window.partitionBy("item_id")))
    a, b = CONTAINMENT
    largest = F.expr("shiftleft(1L, length(bin(n_item))) - 1")
    least = F.expr(f"({a} * size_bound + {b} - 1) div {b}")
    sketch = each.withColumn("size_bound", largest).withColumn("n_sketch", F.col("size_bound") - least + 1)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("shingle", "size"))
    return sketch.withColumn("in_sketch", rank <= F.col("n_sketch")).select("item_id", "size", "shingle", "n_item", "in_sketch")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, n_item, n_common, containment."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = scratch.save(item_shingles(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))))
    sizes = sorted(r["size"] for r in held.select("size").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    sketch = held.where("in_sketch").select("size", "shingle", "item_id")
    probed = _shingles(docs, "doc_id", "text", sizes).join(_bounded(sketch, sketch.count()), ["size", "shingle"])
    candidates = scratch.save(probed.select("doc_id", "item_id").distinct())
    ids = candidates.select(F.col("doc_id").alias("_id")).distinct()
    near = docs.join(_bounded(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    common = _shingles(near, "doc_id", "text", sizes).join(_bounded(held.drop("in_sketch"), held.count()), ["size", "shingle"])
    counted = common.groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("size", "shingle").alias("n_common"))
    a, b = CONTAINMENT
    found = counted.where(F.col("n_common") * b >= F.col("n_item") * a)
    return found.withColumn("containment", F.col("n_common") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns. Each row is judged by its own text alone (known by its
    64-bit hash), whatever other rows have the same doc_id or none."""
    print_ = F.xxhash64(F.col("text").cast("string"))
    texts = docs.select(print_.alias("doc_id"), "text")
    found = Scratch(docs.sparkSession).finish(contaminated(texts, items).select(F.col("doc_id").alias("_print")).distinct())
    return docs.join(_bounded(found, found.count()), print_ == F.col("_print"), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = rf"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') FROM benchmark
),
sized AS (SELECT i.id, least(len(words), {SHINGLE}) AS size, words FROM cut i WHERE kind = 'i' AND len(words) > 0),
item AS (SELECT DISTINCT id AS item_id, size, array_to_string(words[p : p + size - 1], ' ') AS shingle FROM (SELECT id, size, words, unnest(range(1, len(words) - size + 2)) AS p FROM sized)),
counted AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id),
doc AS (
  SELECT DISTINCT id AS doc_id, size, array_to_string(words[p : p + size - 1], ' ') AS shingle
  FROM (SELECT id, size, words, unnest(range(1, len(words) - size + 2)) AS p FROM cut, (SELECT DISTINCT size FROM sized) WHERE kind = 'd')
)
SELECT doc_id, item_id, n_item, count(*) AS n_common, count(*) / n_item AS containment
FROM doc JOIN item USING (size, shingle) JOIN counted USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * {CONTAINMENT[1]} >= n_item * {CONTAINMENT[0]}
"""
