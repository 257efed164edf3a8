"""Helpers that the corpus operators share: scratch tables, table reading, joins that a hot key does not slow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.storage import Scratch as Scratch

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT_ROWS = 2000
#: A key is hot when more than one row in so many has it; there are then at most so many hot keys.
HOT_SHARE = 1000
#: Up to so many row keys, at 32 bytes, are broadcast.
BROADCAST_ROWS = 500_000
#: A row's key: whether the id is null, the id, and the text's hash.
KEY = ["_none", "_id", "_h1", "_h2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Python workers get at most so many texts at a time from now on in this session. Spark's own default of 10000 rows, up to
    64 MB, is held several times over while a batch is read, decoded and answered."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner see which finished shuffles nothing refers to any more, so that their files go."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_by_key(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """rows left-joined with groups, which has one row a key and the number of rows of that key in column ``size``.

    Keys that hold more than one row in HOT_SHARE number at most HOT_SHARE, so they are broadcast; the other rows are
    shuffled, and then no key weighs much. Both inputs are read twice, so they should be written tables. ``key`` holds
    no nulls.
    """
    rest = [c for c in groups.columns if c not in key]
    edge = max(1, total // HOT_SHARE)
    hot = groups.where(F.col(size) > edge).withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), key, "left")
    done = tagged.where("_hot").drop("_hot")
    cold = tagged.where("_hot is null").drop("_hot", *rest)
    return done.unionByName(cold.join(groups.where(F.col(size) <= edge), key, "left"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart, with no nulls in it: rows that agree in all of KEY have the same id and the same text."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [x.alias(c) for c, x in zip(KEY, (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64(text), F.xxhash64(text, F.lit("again"))), strict=True)]


def few(df: DataFrame) -> DataFrame:
    """The table, broadcast if it's small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def one_a_group(docs: DataFrame, rows: DataFrame, n: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, but of each group only the first row; rows is a written table of n rows, with KEY
    and group."""
    first = F.min(F.struct(*KEY)).alias("first")
    groups = scratch.save(rows.groupBy("group").agg(first, F.count("*").alias("n_rows")).where("n_rows > 1"), n)
    told = scratch.save(join_by_key(rows, groups, ["group"], "n_rows", n).where("n_rows is not null").select(*KEY, (F.struct(*KEY) == F.col("first")).alias("stays")), n)
    gone = scratch.save(told.where("not stays").select(*KEY).distinct(), n)
    again = scratch.save(told.where("stays").groupBy(*KEY).count().where("count > 1").select(*KEY), n)
    scratch.keep(gone, again)
    keyed = docs.select("*", *row_key(id_col, text_col)).join(few(gone), KEY, "left_anti")
    if again.isEmpty():
        return keyed.select(*docs.columns)
    single = keyed.join(few(again), KEY, "left_anti")
    return single.unionByName(keyed.join(few(again), KEY, "left_semi").dropDuplicates(KEY)).select(*docs.columns)


def ascii_lower(col):
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, UPPER, LOWER)
