"""Rollups: mergeable aggregates by account, metric, period and dimension set.

Events are scanned once, for all kinds of aggregates together: they are first summed up by the whole vector of matched dimensions
(and by value, where distinct values are counted), and only these partial aggregates are spread over the dimension sets (at most
six each), so the shuffle carries partials. Only what the defined kinds need is computed. All buffers are of fixed width, so
every step is a hash aggregation: the latest value goes by one number made of its time and offset. Counting distinct values with
removals keeps, by value, the last operation, as its order matters.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import resolve_period
from tallyforge.operators.dims import dim_sets, matched_dims
from tallyforge.schemas import AGG_TYPES, DIMS, KEY, REMOVE

_GROUP = ["account_id", "metric_code", "agg_type", "period_id"]


def with_metric(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Events of known metrics, with period_id and the vector of matched dimensions. Events of other metrics aren't aggregated."""
    known = metrics.where(F.col("agg_type").isin(*AGG_TYPES)).select("metric_code", "agg_type", "period_type", "billing_cycle_day", "period_ns", "filters", "thresholds")
    out = events.join(known, "metric_code")
    out = out.withColumn("period_id", resolve_period(F.col("ts_ns"), F.col("period_type"), F.col("billing_cycle_day"), F.col("period_ns")))
    return out.withColumn("matched", matched_dims(F.col("filters"), F.col("props"))).drop("period_type", "billing_cycle_day", "period_ns", "filters")


def kinds_of(metrics: DataFrame) -> set[str]:
    """The kinds of aggregates that definitions ask for: at most as many as there are."""
    return {r[0] for r in metrics.select("agg_type").distinct().collect()} & set(AGG_TYPES)


#: Offsets are below this; a time and an offset make one number of 38 digits.
_OFFSETS = 10**19


def _events_measures(kinds: set[str]) -> dict[str, Column]:
    """By measure, what an event adds to it. The latest value has the greatest ``last``: its time, then the smallest offset."""
    only = lambda kind, col: F.when(F.col("agg_type") == kind, col)
    wide = lambda col: col.cast("decimal(20,0)")
    last = wide(F.col("ts_ns")) * F.lit(Decimal(_OFFSETS)).cast("decimal(20,0)") + (F.lit(Decimal(_OFFSETS - 1)).cast("decimal(20,0)") - wide(F.col("offset")))
    # operations other than removal count alike
    op = F.shiftleft("offset", 2).bitwiseOR(F.least(F.col("operation_type").cast("long"), F.lit(3).cast("long")))
    out = {"count": F.lit(1).cast("long"), "last_seg_offset": F.col("offset")}
    if "sum" in kinds:
        out["sum"] = only("sum", wide(F.col("value")))
    if "max" in kinds:
        out["max"] = only("max", F.col("value"))
    if "latest" in kinds:
        out["last"] = F.when((F.col("agg_type") == "latest") & (F.col("ts_ns") > 0), last.cast("decimal(38,0)"))
        out["last_value"] = F.col("value")
    if "count_unique" in kinds:
        out["op"] = only("count_unique", op)
    return out


def _combined(rows: DataFrame, kinds: set[str], *by: str) -> DataFrame:
    """Measures of rows of the same key as one; of events' measures as of partial aggregates."""
    agg = [F.sum("count").alias("count"), F.max("last_seg_offset").alias("last_seg_offset")]
    if "sum" in kinds:
        agg.append(F.sum("sum").cast("decimal(38,0)").alias("sum"))
    if "max" in kinds:
        agg.append(F.max("max").alias("max"))
    if "latest" in kinds:
        agg += [F.max_by("last_value", "last").alias("last_value"), F.max("last").alias("last")]
    if "count_unique" in kinds:
        agg.append(F.max("op").alias("op"))
    return rows.groupBy(*by).agg(*agg)


def _by_vector(events: DataFrame, metrics: DataFrame, kinds: set[str]) -> DataFrame:
    """Partial aggregates by the whole vector of matched dimensions, and by value (member) where distinct values are counted."""
    of = with_metric(events, metrics)
    member = [F.when(F.col("agg_type") == "count_unique", F.col("value")).alias("member")] if "count_unique" in kinds else []
    rows = of.select(*_GROUP, "matched", *member, *(c.alias(name) for name, c in _events_measures(kinds).items()))
    return _combined(rows, kinds, *_GROUP, "matched", *(["member"] if member else []))


def _by_key(events: DataFrame, metrics: DataFrame, kinds: set[str]) -> DataFrame:
    """The same by key, member and kind."""
    member = ["member"] if "count_unique" in kinds else []
    partials = _by_vector(events, metrics, kinds)
    spread = partials.select("*", F.explode(dim_sets(F.col("matched"))).alias("dims"))
    return _combined(spread, kinds, *KEY, "agg_type", *member)


def _flat(df: DataFrame, kinds: set[str], *more: str) -> DataFrame:
    """A rollup's columns, with zeros for what no kind asks for."""
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0)).cast(kind)
    none, last = F.lit(0).cast("long"), F.col("last")
    ts = F.call_function("div", last, F.lit(Decimal(_OFFSETS)))
    order = (last % F.lit(Decimal(_OFFSETS))) - F.lit(Decimal(_OFFSETS - 1))
    latest = "latest" in kinds
    return df.select(
        *KEY,
        "agg_type",
        zero(F.col("sum") if "sum" in kinds else none, "decimal(38,0)").alias("sum"),
        "count",
        (F.greatest(zero(F.col("max")), none) if "max" in kinds else none).alias("max"),
        (F.when(last.isNotNull(), F.col("last_value")).otherwise(none) if latest else none).alias("last_value"),
        (zero(ts) if latest else none).alias("last_timestamp"),
        (zero(order) if latest else none).alias("last_order"),
        "last_seg_offset",
        *more,
    )


def vector_partials(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Partial aggregates by the whole vector of matched dimensions, of all kinds but count_unique."""
    of = metrics.where("agg_type <> 'count_unique'")
    kinds = kinds_of(of)
    flat = _flat(_by_vector(events, of, kinds).withColumn("dims", F.array().cast(DIMS)).withColumn("_matched", F.col("matched")), kinds, "_matched")
    return flat.drop("dims").withColumnRenamed("_matched", "matched")


def unique_members(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """By key and value, the last operation on it: what distinct counting needs to keep. Offset and operation go into one long
    (offsets below 2 ** 61), so that this is a hash aggregation as well."""
    members = _by_key(events, metrics.where("agg_type = 'count_unique'"), {"count_unique"})
    return members.select(*KEY, "agg_type", F.col("member").alias("value"), F.col("op").bitwiseAND(3).cast("int").alias("last_op"), F.shiftright("op", 2).alias("last_offset"))


def merge_members(members: DataFrame) -> DataFrame:
    """Members that were gathered in parts, as one."""
    last = F.max(F.struct("last_offset", "last_op")).alias("last")
    return members.groupBy(*KEY, "agg_type", "value").agg(last).select(*KEY, "agg_type", "value", "last.last_op", "last.last_offset")


def members_count(members: DataFrame) -> DataFrame:
    """Rollup rows from members: the count is of the values whose last operation isn't a removal."""
    counted = members.groupBy(*KEY, "agg_type").agg(F.count_if(F.col("last_op") != REMOVE).alias("count"), F.max("last_offset").alias("last_seg_offset"))
    zero = lambda name, kind="long": F.lit(0).cast(kind).alias(name)
    return counted.select(*KEY, "agg_type", zero("sum", "decimal(38,0)"), "count", zero("max"), zero("last_value"), zero("last_timestamp"), zero("last_order"), "last_seg_offset")


def merge_partials(rows: DataFrame) -> DataFrame:
    """Flat rollup rows of the same key, gathered in parts, as one."""
    last = F.max(F.struct("last_timestamp", "last_order", "last_value")).alias("last")
    out = rows.groupBy(*KEY, "agg_type").agg(F.sum("sum").cast("decimal(38,0)").alias("sum"), F.sum("count").alias("count"), F.max("max").alias("max"), last, F.max("last_seg_offset").alias("last_seg_offset"))
    return out.select(*KEY, "agg_type", "sum", "count", "max", "last.last_value", "last.last_timestamp", "last.last_order", "last_seg_offset")


def ordinary_rollup(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rollup rows of all kinds but count_unique."""
    of = metrics.where("agg_type <> 'count_unique'")
    kinds = kinds_of(of)
    return _flat(_by_key(events, of, kinds), kinds)


def rollup(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per account, metric, period and dimension set; events are read once, whatever the kinds."""
    kinds = kinds_of(metrics)
    rows = _by_key(events, metrics, kinds)
    if "count_unique" in kinds:
        inside = (F.col("op").bitwiseAND(3) != REMOVE).cast("long")
        rows = rows.withColumn("count", F.when(F.col("agg_type") == "count_unique", inside).otherwise(F.col("count")))
        rows = _combined(rows, kinds, *KEY, "agg_type")
    return _flat(rows, kinds)


def merge_periods(rows: DataFrame, *by: str) -> DataFrame:
    """Aggregates over several periods: sums and counts add up (distinct counts too), the latest by time wins, the earlier period
    on a tie. Without ``by`` there is always one row, of zeros where nothing is found."""
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0)).cast(kind)
    last = F.max(F.when(F.col("last_timestamp") > 0, F.struct("last_timestamp", (-F.col("period_id")).alias("p"), "last_value")))
    out = rows.groupBy(*by).agg(
        zero(F.sum("sum"), "decimal(38,0)").alias("sum"), zero(F.sum("count")).alias("count"), zero(F.max("max")).alias("max"), last.alias("last"), zero(F.max("last_seg_offset")).alias("last_seg_offset")
    )
    return out.select(*by, "sum", "count", "max", zero(F.col("last.last_value")).alias("last_value"), zero(F.col("last.last_timestamp")).alias("last_timestamp"), "last_seg_offset")
