"""Streams of raw events: landed JSON batches, and dropping duplicates while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.ingest import DEDUP_KEY
from tallyforge.sources.json_events import parse_batches


def read_json_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of new files, each line of which is a JSON batch."""
    reader = spark.readStream.format("text")
    raw = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)
    return parse_batches(raw.withColumnRenamed("value", "body"))


def dedup_stream(events: DataFrame, late: str = "keep", window: str = "5 minutes") -> DataFrame:
    """The first of events that are the same. ``keep`` remembers every key, so late events still count; ``drop`` remembers keys
    for the window alone and drops events that come later than that, seen or not."""
    if late == "keep":
        return events.dropDuplicates(DEDUP_KEY)
    if late != "drop":
        raise ValueError("late is keep or drop")
    timed = events.withColumn("_ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("_ts", window)
    return timed.dropDuplicatesWithinWatermark(DEDUP_KEY).drop("_ts")
