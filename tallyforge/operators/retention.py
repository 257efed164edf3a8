"""Retention: what stays when old events and closed periods go. Each metric's periods have a cutoff of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import resolve_period
from tallyforge.schemas import NS_PER_DAY


def keep_events(events: DataFrame, now_ns: int, days: int = 90) -> DataFrame:
    return events.where(F.col("ts_ns") >= now_ns - days * NS_PER_DAY)


def keep_rollup(rollup: DataFrame, metrics: DataFrame, now_ns: int, days: int = 90) -> DataFrame:
    """Rollup rows of periods that reach into the time kept; rows of metrics that are gone stay."""
    cutoff = resolve_period(F.lit(now_ns - days * NS_PER_DAY), F.col("period_type"), F.col("billing_cycle_day"), F.col("period_ns"))
    cutoffs = metrics.select("metric_code", cutoff.alias("cutoff"))
    return rollup.join(cutoffs, "metric_code", "left").where("cutoff is null or period_id >= cutoff").drop("cutoff")
