"""Exact dedup by two passes of Bloom filtering: only rows whose hash may be repeated are shuffled.

Pass 1 sets, for each text's SHA-256, ``PROBES`` positions in a filter whose positions count to two. A position that is
hit once can only belong to texts that occur once. Pass 2 probes the filter: rows with a position hit once pass straight
through, the rest are grouped by their hash. False positives of the filter only cost a shuffle of 48 bytes; they don't
change the result.

The filter has 16 positions a row at any number of rows. Hashes are sharded by a part of them, and a shard's filter has at most
``max_filter_bits`` positions (2 ** 28, 32 MB), the proven bound of what is broadcast at a time: a table of many rows takes several
filters one after the other, and since hashes are written by shard, each row meets its own filter alone and is read twice in all.

Defined cases: a null text counts as empty; texts are compared after replacing each run of ASCII white space by one space
(not trimmed); of equal texts the row with the smallest doc_id stays, null ids come last, and of rows repeated with the same
doc_id exactly one stays; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, join_by_key, table, text_batches
from tallyforge.storage import new_dir

PROBES, BITS_A_ROW = 4, 16
SEGMENT_BITS = 20
FLUSH = 1 << 20
MAX_FILTER_BITS = 1 << 28


def squeeze(data: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    return (b" " if data[:1].isspace() else b"") + b" ".join(words) + (b" " if data[-1:].isspace() else b"")


def _digest(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sums = [hashlib.sha256(squeeze(x.as_py() or b"")).digest() for x in texts]
            shard = [int.from_bytes(x[-3:], "big") % shards for x in sums]  # positions take the low bytes of words
            columns = [batch.column(0), pa.array(range(row, row + len(sums)), pa.int64()), pa.array(sums, pa.binary()), pa.array(shard, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "sha", "shard"])
            row += len(sums)

    return run


def positions(shas: pa.Array, bits: int) -> np.ndarray:
    """A row for each hash, with its PROBES positions in a filter of so many bits (a power of two)."""
    words = np.frombuffer(b"".join(shas.to_pylist()), dtype="<u8").reshape(-1, 4)
    return (words[:, :PROBES] & np.uint64(bits - 1)).astype(np.int64)


def _build(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            spots, hits = np.unique(np.concatenate(held), return_counts=True)
            segments = spots >> SEGMENT_BITS
            cuts = np.flatnonzero(np.diff(segments)) + 1
            parts = zip(np.split(spots, cuts), np.split(hits, cuts), strict=True)
            out = [(int(s[0] >> SEGMENT_BITS), (s & ((1 << SEGMENT_BITS) - 1)).astype("<u4").tobytes(), np.minimum(h, 2).astype("u1").tobytes()) for s, h in parts]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["segment", "spots", "hits"])

        for batch in batches:
            if batch.num_rows:
                held.append(positions(batch.column(0), bits).ravel())
                n += len(held[-1])
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, spots, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = counts.setdefault(segment, np.zeros(1 << SEGMENT_BITS, "u1"))
            spots = np.frombuffer(spots, "<u4")
            held[spots] = np.minimum(held[spots] + np.frombuffer(hits, "u1"), 2)
    for segment, held in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(held > 1, bitorder="little").tobytes()], pa.binary())], ["segment", "twice"])


def _probe(bits: int, twice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(twice.value, "u1")
        for batch in batches:
            spots = positions(batch.column(2), bits)
            again = ((held[spots >> 3] >> (spots & 7).astype("u1")) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again, pa.bool_())], ["doc_id", "row", "sha", "again"])

    return run


def repeated_filter(digests: DataFrame, n: int, max_filter_bits: int = MAX_FILTER_BITS) -> tuple[int, bytes]:
    """Pass 1: the filter's size in bits, and its positions that were hit at least twice."""
    bits = 1 << SEGMENT_BITS
    while bits < BITS_A_ROW * n and bits < max_filter_bits:
        bits *= 2
    segments = bits >> SEGMENT_BITS
    built = digests.select("sha").mapInArrow(_build(bits), "segment int, spots binary, hits binary")
    merged = built.repartition(min(segments, 64), "segment").mapInArrow(_merge, "segment int, twice binary")
    empty = bytes(1 << (SEGMENT_BITS - 3))
    by = {r["segment"]: bytes(r["twice"]) for r in merged.collect()}  # at most max_filter_bits / 8 bytes
    return bits, b"".join(by.get(i, empty) for i in range(segments))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, sha (of the normalised text), keep_id, group_size, kept."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    text_batches(spark)
    n = docs.count()
    shards = max(1, -(-BITS_A_ROW * n // max_filter_bits))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digests = scratch.save(narrow.mapInArrow(_digest(shards), "doc_id long, row long, sha binary, shard int"), by="shard")
    path = new_dir(spark, "probed")
    for shard in range(shards):
        rows = digests.where(F.col("shard") == shard).drop("shard")
        bits, twice = repeated_filter(rows, n // shards, max_filter_bits)
        held = spark.sparkContext.broadcast(twice)
        rows.mapInArrow(_probe(bits, held), "doc_id long, row long, sha binary, again boolean").write.parquet(f"{path}/shard={shard}")
        held.destroy()
    probed = spark.read.schema("doc_id long, row long, sha binary, again boolean, shard int").parquet(path).drop("shard")
    through = probed.where(~F.col("again")).select("doc_id", "row", "sha", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    again = probed.where("again").drop("again")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = again.groupBy("sha").agg(F.count("*").alias("group_size"), first.alias("first"))
    groups = scratch.save(groups.select("sha", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")), n)
    out = through.unionByName(join_by_key(again, groups, ["sha"], "group_size", n))
    scratch.drop(digests)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
