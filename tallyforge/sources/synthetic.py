"""Seeded synthetic events: skewed accounts, replays, late arrivals, removals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.schemas import ADD, NS_PER_DAY, NS_PER_SECOND, REMOVE

BASE_NS = 1_704_067_200 * NS_PER_SECOND


def synthetic_events(spark: SparkSession, n: int, seed: int = 42, accounts: int = 1000, metrics: int = 20, exponent: float = 1.2, partitions: int | None = None) -> DataFrame:
    """Accounts follow a power law (inverse of its continuous distribution); 1 % repeat the event before, 2 % come up to a day
    late, 10 % are removals. Hashes of the row number stand in for a random generator, so any partitioning gives the same rows."""
    source = F.col("id") - F.when(F.pmod(F.xxhash64("id", F.lit(seed), F.lit("again")), F.lit(100)) == 0, 1).otherwise(0)
    unit = lambda tag: F.pmod(F.xxhash64("source", F.lit(seed), F.lit(tag)), F.lit(1 << 30)) / (1 << 30)
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    rank = F.pow(1 + unit("account") * (F.pow(F.lit(float(accounts)), 1 - exponent) - 1), 1 / (1 - exponent))
    late = F.when(unit("late") < 0.02, (unit("delay") * NS_PER_DAY).cast("long")).otherwise(0)
    return rows.withColumn("source", source).select(
        F.col("id").alias("offset"),
        (F.lit(BASE_NS) + F.col("source") * NS_PER_SECOND - late).alias("ts_ns"),
        F.least(F.floor(rank), F.lit(accounts)).cast("long").alias("account_id"),
        F.concat(F.lit("metric_"), F.floor(unit("metric") * metrics).cast("string")).alias("metric_code"),
        F.floor(unit("value") * 1_000_000_000).cast("long").alias("value"),
        F.when(unit("operation") < 0.1, REMOVE).otherwise(ADD).alias("operation_type"),
        F.create_map(F.lit("region"), F.concat(F.lit("r"), F.floor(unit("region") * 3).cast("string"))).alias("props"),
    )
