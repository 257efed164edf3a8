"""Batches of events as JSON arrays. Unknown fields are skipped; what isn't such an array is reported, not dropped silently.

Numbers are whole and not negative: a batch with another account or value is broken as a whole, as is one whose numbers are beyond
2 ** 63 - 1, which events don't hold. A field that is missing is 0 or blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.schemas import NONE

BATCH = "array<struct<account_id:string,metric_code:string,value:string,delivery_mode:string>>"
#: The largest number that events hold.
MOST = 2**63 - 1


def _is_number(text: Column) -> Column:
    return text.isNull() | (text.rlike("^[0-9]{1,20}$") & (text.cast("decimal(20,0)") <= F.lit(str(MOST)).cast("decimal(20,0)")))


def _is_whole(events: Column) -> Column:
    """Whether all of a batch can be read."""
    return events.isNotNull() & F.forall(events, lambda e: e.isNotNull() & F.coalesce(_is_number(e["account_id"]) & _is_number(e["value"]), F.lit(False)))


def _number(text: Column) -> Column:
    return F.coalesce(text.cast("long"), F.lit(0).cast("long"))


def parse_batches(raw: DataFrame, body: str = "body", strict: bool = False) -> DataFrame:
    """One row per event, with its place in the batch and whether its batch is synchronous (any element asks for it). A batch
    that can't be read raises if strict, else gives no rows; see ``broken_batches``."""
    keep = [c for c in raw.columns if c != body]
    parsed = raw.select(*keep, F.from_json(body, BATCH, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("_events"))
    whole = _is_whole(F.col("_events"))
    if strict:
        parsed = parsed.withColumn("_events", F.when(whole, F.col("_events")).otherwise(F.raise_error(F.lit("malformed batch: numbers are whole and not negative"))))
    else:
        parsed = parsed.where(whole)
    sync = F.exists("_events", lambda e: F.coalesce(e["delivery_mode"] == "sync", F.lit(False)))
    each = parsed.select(*keep, sync.alias("is_sync"), F.posexplode("_events").alias("idx", "e"))
    return each.select(
        *keep,
        "is_sync",
        F.col("idx").cast("long").alias("idx"),
        _number(F.col("e.account_id")).alias("account_id"),
        F.coalesce("e.metric_code", F.lit("")).alias("metric_code"),
        _number(F.col("e.value")).alias("value"),
        F.lit(NONE).alias("operation_type"),
        F.lit(0).cast("long").alias("ts_ns"),
    )


def broken_batches(raw: DataFrame, body: str = "body") -> DataFrame:
    return raw.where(~_is_whole(F.from_json(body, BATCH)))
