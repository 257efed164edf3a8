"""Streaming rollups as append-only partial aggregates, merged when read.

Each micro-batch writes its partials and the last operations on distinct values under its batch id; a batch that runs again
overwrites its own folder, so every event counts once. Nothing is ever dropped as late: late events add to their own period.

Duplicates are told by the keys of stored events, which are kept by day of event time. A batch reads the keys of its own days and no
others, so its cost doesn't grow with history, and keys before a cutoff can be pruned: events older than that are no longer
recognised as replays. Compaction folds all batches into one, keys included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.ingest import DEDUP_KEY, dedup, dedup_against
from tallyforge.operators.rollup import members_count, merge_members, merge_partials, ordinary_rollup, unique_members
from tallyforge.schemas import EVENTS, NS_PER_DAY


def read_events_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of events in a landing folder."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _day() -> Column:
    return F.expr(f"ts_ns div {NS_PER_DAY}").cast("int").alias("day")


def seen_keys(events: DataFrame, target: str, batch_id: int) -> DataFrame | None:
    """Keys that earlier batches stored for the days of these events; other days' folders aren't read."""
    spark, keys = events.sparkSession, f"{target}/keys"
    if not _exists(spark, keys):
        return None
    days = [r[0] for r in events.select(_day()).distinct().collect()]  # a row a day; as literals they prune folders
    return spark.read.parquet(keys).where((F.col("batch_id") < batch_id) & F.col("day").isin(days))


def write_batch(events: DataFrame, metrics: DataFrame, target: str, batch_id: int, deduplicate: bool = True) -> None:
    """One micro-batch, under its id. With deduplication, events that an earlier batch stored don't count again."""
    held = [events.persist()]
    try:
        if deduplicate:
            seen = seen_keys(events, target, batch_id)
            events = (dedup(events) if seen is None else dedup_against(events, seen)).persist()
            held.append(events)
            events.select(*DEDUP_KEY, _day()).write.mode("overwrite").partitionBy("day").parquet(f"{target}/keys/batch_id={batch_id}")
        ordinary_rollup(events, metrics).write.mode("overwrite").parquet(f"{target}/partials/batch_id={batch_id}")
        unique_members(events, metrics).write.mode("overwrite").parquet(f"{target}/members/batch_id={batch_id}")
    finally:
        for df in held:
            df.unpersist()


def prune_keys(spark: SparkSession, target: str, before_ns: int) -> int:
    """Removes the keys of days that end before an instant; how many folders went."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/keys/batch_id=*/day=*")
    fs, gone = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), 0
    for found in fs.globStatus(folder) or ():
        if (int(found.getPath().getName().removeprefix("day=")) + 1) * NS_PER_DAY <= before_ns:
            gone += fs.delete(found.getPath(), True)
    return gone


def start_rollup(stream: DataFrame, metrics: DataFrame, target: str, checkpoint: str, deduplicate: bool = True, **trigger) -> StreamingQuery:
    """Runs until stopped, or with ``availableNow=True`` until all that is there has been read."""

    def batch(events: DataFrame, batch_id: int) -> None:
        write_batch(events, metrics, target, batch_id, deduplicate)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """The rollup of all batches so far, as ``operators.rollup.rollup`` of all their events would be."""
    partials = merge_partials(spark.read.parquet(f"{target}/partials").drop("batch_id"))
    members = merge_members(spark.read.parquet(f"{target}/members").drop("batch_id"))
    return partials.unionByName(members_count(members))


def compact(spark: SparkSession, target: str, compacted: str) -> None:
    """All batches as one, in a new place; readers, and the stream with its later batches, are then pointed to it."""
    merge_partials(spark.read.parquet(f"{target}/partials").drop("batch_id")).write.parquet(f"{compacted}/partials/batch_id=-1")
    merge_members(spark.read.parquet(f"{target}/members").drop("batch_id")).write.parquet(f"{compacted}/members/batch_id=-1")
    if _exists(spark, f"{target}/keys"):
        spark.read.parquet(f"{target}/keys").drop("batch_id").write.partitionBy("day").parquet(f"{compacted}/keys/batch_id=-1")
