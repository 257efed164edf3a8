"""Checks of stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import event_checksum

_FIELDS = ("offset", "ts_ns", "account_id", "metric_code", "value", "operation_type")


def with_checksum(events: DataFrame) -> DataFrame:
    return events.withColumn("checksum", event_checksum(*map(F.col, _FIELDS)))


def checks(events: DataFrame) -> DataFrame:
    """One row: how many events there are, and how many fail each check (a checksum, where there is one)."""
    broken = event_checksum(*map(F.col, _FIELDS)) != F.col("checksum") if "checksum" in events.columns else F.lit(False)
    nulls = F.lit(False)
    for c in _FIELDS:
        nulls = nulls | F.col(c).isNull()
    return events.agg(
        F.count("*").alias("n_events"),
        F.count_if(nulls).alias("n_null"),
        F.count_if(F.col("ts_ns") <= 0).alias("n_without_time"),
        F.count_if(F.col("value") < 0).alias("n_negative"),
        F.count_if(~F.col("operation_type").isin(0, 1, 2)).alias("n_unknown_operation"),
        F.count_if(broken).alias("n_broken"),
    )
