"""Taking events in: time stamps, duplicates, offsets, and what a batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.storage import Scratch

#: Spark's row ids within a partition take so many bits; the partition's number is above them.
PLACE_BITS = 33
#: Events are the same when they agree in these; operation and properties don't count.
DEDUP_KEY = ["metric_code", "account_id", "ts_ns", "value"]


def stamp(events: DataFrame, now_ns: int, index: str = "idx") -> DataFrame:
    """Events without a time get now, plus their index in the batch."""
    return events.withColumn("ts_ns", F.when(F.col("ts_ns") == 0, F.lit(now_ns) + F.col(index)).otherwise(F.col("ts_ns")))


def dedup(events: DataFrame) -> DataFrame:
    """Of events that are the same, the one with the smallest offset. An aggregate, so replays fold before the shuffle."""
    rest = [c for c in events.columns if c not in DEDUP_KEY]
    first = events.groupBy(*DEDUP_KEY).agg(F.min_by(F.struct(*rest), "offset").alias("first"))
    return first.select(*(F.col(c) if c in DEDUP_KEY else F.col(f"first.{c}").alias(c) for c in events.columns))


def dedup_against(events: DataFrame, seen: DataFrame) -> DataFrame:
    """As ``dedup``, and without events that an earlier batch has stored."""
    return dedup(events).join(seen.select(*DEDUP_KEY), DEDUP_KEY, "left_anti")


def duplicates(events: DataFrame) -> DataFrame:
    """By event, how often it came beyond the first time."""
    return events.groupBy(*DEDUP_KEY).agg((F.count("*") - 1).alias("n_duplicates"), F.min("offset").alias("offset")).where("n_duplicates > 0")


def ingest_result(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: how many events were stored and how many were duplicates, the last stored offset, and the status."""
    first = events.groupBy(*DEDUP_KEY).agg(F.min("offset").alias("offset"), F.count("*").alias("n"))
    known = metrics.select("metric_code", F.lit(True).alias("known"))
    one = first.join(known, "metric_code", "left").agg(
        F.count("*").alias("n_stored"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.max("offset"), F.lit(0)).alias("last_offset"),
        F.coalesce(F.bool_or(F.col("known").isNull()), F.lit(False)).alias("unknown"),
    )
    status = F.when(F.col("unknown"), "unknown_metric").when((F.col("n_stored") == 0) & (F.col("n_duplicates") > 0), "duplicate").otherwise("ok")
    return one.select("n_stored", "n_duplicates", "last_offset", status.alias("status"))


def assign_offsets(rows: DataFrame, order: list[str], start: int = 0, name: str = "offset", partitions: int | None = None) -> DataFrame:
    """Numbers rows from ``start`` in a total order, without bringing them into one task: they are cut into ranges once, sorted and
    numbered within, and written; starts of the ranges are then counted from what was written, so no row can be in another
    range than the one that it was counted in. Rows that agree in the whole order are interchangeable; they are dealt out by all
    their columns, so rows that tie in the order alone don't stay in one range."""
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    keyed = rows.withColumn("_tie", F.xxhash64(*hashed))
    by = [*order, "_tie"]
    cut = keyed.repartitionByRange(partitions, *by) if partitions else keyed.repartitionByRange(*by)
    placed = cut.sortWithinPartitions(*by).drop("_tie").withColumn("_place", F.monotonically_increasing_id())
    written = Scratch(rows.sparkSession).save(placed)
    part, nth = F.shiftright("_place", PLACE_BITS), F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = written.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + nth + F.lit(start).cast("long")).select(*(c for c in rows.columns if c != name), name)
