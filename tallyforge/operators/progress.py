"""Event-time progress: the watermark over arrivals, and which events are late. Late events are still counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.running import BLOCK, with_running
from tallyforge.schemas import LATE_GRACE_NS


def with_watermark(events: DataFrame, order: str = "offset", grace_ns: int = LATE_GRACE_NS, block: int = BLOCK) -> DataFrame:
    """Adds the largest time seen so far, and whether an event is later than that by more than the grace."""
    out = with_running(events, [], {"seen": ("max", F.greatest(F.col("ts_ns"), F.lit(0)))}, order=order, block=block)
    return out.drop("prev_seen").withColumnRenamed("seen", "watermark_ns").withColumn("is_late", F.col("ts_ns") < F.col("watermark_ns") - grace_ns)
