"""Event-time windows of a stream, for periods that Spark's own windows can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weeks start on Monday: 1970-01-05 was one.
WINDOWS = {"fixed": ("30 days", "0 days"), "day": ("1 day", "0 days"), "week": ("7 days", "4 days")}


def period_window(ts: Column, period_type: str) -> Column:
    length, start = WINDOWS[period_type]
    return F.window(ts, length, startTime=start)


def windowed_counts(events: DataFrame, period_type: str) -> DataFrame:
    """Counts and sums by account, metric and window. No watermark: late events still count, so run it in update or complete
    mode."""
    ts = F.timestamp_micros(F.expr("ts_ns div 1000"))
    return events.groupBy("account_id", "metric_code", period_window(ts, period_type).alias("window")).agg(F.count("*").alias("count"), F.sum(F.col("value").cast("decimal(20,0)")).alias("sum"))
