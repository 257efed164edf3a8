"""Packing into length buckets of least padding, and batches of a token budget inside each bucket.

A document's sequence is its tokens and an end mark; one longer than ``context`` is cut into pieces of that length, and no
token is dropped. The histogram of all lengths has at most ``context`` entries; a dynamic program over it chooses the bucket
bounds with the least total padding. Each bucket's sequences are numbered, and each run of token_budget // bound of them is a
batch, so a bucket has at most one batch that isn't full. Numbers are found without sorting a bucket in one task: sequences are
counted by bucket and salt, whose number follows the number of sequences, and numbered within these.

Tokens are runs of anything but ASCII white space, counted in the JVM, or those of a public tokenizer file if
``tokenizer_path`` names one. Defined cases: null and empty texts have the end mark alone; repeated rows are packed as often;
null ids are packed; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, table, text_batches

CONTEXT, BUCKETS, TOKEN_BUDGET = 2048, 16, 32_768
ROWS_PER_SALT = 1 << 18


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The at most so many bounds, in rising order, that minimise the padding of a histogram of lengths.

    least[i] after k rounds is the least padding of the i shortest lengths in k buckets, the last of which ends there.
    """
    lengths = np.array(sorted(histogram), "i8")
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], "i8")
    n, s = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    waste = lengths[None, :] * (n[None, 1:] - n[:-1, None]) - (s[None, 1:] - s[:-1, None])  # from the jth to the ith length
    never = np.iinfo("i8").max // 4
    waste = np.where(np.arange(len(lengths))[:, None] <= np.arange(len(lengths))[None, :], waste, never)
    least, back = waste[0].copy(), [np.zeros(len(lengths), "i8")]
    rounds = [least]
    for _ in range(min(buckets, len(lengths)) - 1):
        total = np.append(never, rounds[-1][:-1])[:, None] + waste
        back.append(total.argmin(axis=0))
        rounds.append(total.min(axis=0))
    k = int(np.argmin([r[-1] for r in rounds]))
    at, bounds = len(lengths) - 1, []
    while k >= 0:
        bounds.append(int(lengths[at]))
        at, k = int(back[k][at]) - 1, k - 1
    return bounds[::-1]


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            counts = [len(tokenizer.encode(x or "", add_special_tokens=False).ids) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n"])

    return run


def pack(docs: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per sequence: doc_id, piece, start_token, n_tokens, bucket (its bound), batch_id, slot, padding."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if tokenizer_path:
        text_batches(docs.sparkSession)
        rows = rows.mapInArrow(_tokenized(tokenizer_path), "doc_id long, n long")
    else:
        rows = rows.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n"))
    pieces = rows.select("doc_id", "n", F.explode(F.expr(f"sequence(0L, n div {context})")).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * context).alias("start_token"), F.least(F.lit(context).cast("long"), F.col("n") + 1 - F.col("piece") * context).alias("n_tokens"))
    pieces = scratch.save(pieces.where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most context rows
    bounds, total = bucket_bounds(histogram, buckets), sum(histogram.values())
    salts = -(-max(total, 1) // ROWS_PER_SALT)
    bucket, capacity, first_batch, batches = F.lit(None).cast("long"), F.lit(1), F.lit(0), 0
    for low, bound in zip([0, *bounds], bounds, strict=False):
        here, room = F.col("n_tokens").between(low + 1, bound), max(1, token_budget // bound)
        bucket, capacity, first_batch = F.when(here, bound).otherwise(bucket), F.when(here, room).otherwise(capacity), F.when(here, F.lit(batches).cast("long")).otherwise(first_batch)
        batches += -(-sum(n for length, n in histogram.items() if low < length <= bound) // room)
    keyed = pieces.withColumn("mixed", F.xxhash64("row")).select("*", bucket.cast("long").alias("bucket"), F.pmod("mixed", F.lit(salts)).cast("int").alias("salt"))
    counts = keyed.groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("bucket", "salt").orderBy("mixed", "row")
    ranked = keyed.withColumn("nth", F.row_number().over(order) - 1).join(starts, ["bucket", "salt"]).withColumn("rank", F.col("start") + F.col("nth"))
    placed = ranked.select("*", capacity.cast("long").alias("capacity"), first_batch.cast("long").alias("first_batch"))
    return placed.select("doc_id", "piece", "start_token", "n_tokens", "bucket", (F.col("first_batch") + F.expr("rank div capacity")).alias("batch_id"), F.expr("rank % capacity").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
