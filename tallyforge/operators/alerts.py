"""Threshold alerts: an event fires a threshold when its key's running usage reaches it and had not before, or each time
while it is reached if the threshold is recurring. Falling below re-arms it; a new period starts anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import saturated
from tallyforge.operators.dims import dim_sets, dims_text
from tallyforge.operators.ingest import assign_offsets
from tallyforge.operators.rollup import kinds_of, with_metric
from tallyforge.operators.running import BLOCK, with_running
from tallyforge.schemas import KEY, REMOVE


def _current(prefix: str, kinds: set[str], rows: DataFrame) -> Column:
    """The value that a threshold is held against, by the metric's kind; measures of other kinds aren't there."""
    c = lambda name: F.col(f"{prefix}{name}")
    wide = lambda col: col.cast("decimal(20,0)")
    found = {
        "sum": ("total", lambda: saturated(c("total"))),
        "max": ("largest", lambda: wide(F.greatest(c("largest"), F.lit(0)))),
        "latest": ("newest", lambda: wide(F.coalesce(c("newest.value"), F.lit(0)))),
        "count_unique": ("members", lambda: wide(c("members"))),
    }
    out = wide(c("n"))
    for kind, (name, value) in found.items():
        if kind in kinds and name in rows.columns:
            out = F.when(F.col("agg_type") == kind, value()).otherwise(out)
    return out


def running_usage(events: DataFrame, metrics: DataFrame, block: int = BLOCK, earlier: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """By event and dimension set of metrics with thresholds: usage with it (cur) and before it (prev, null if none). ``earlier`` is
    what came before these events: rollup rows of all kinds but count_unique, and members."""
    of = with_metric(events, metrics.where(F.size("thresholds") > 0))
    spread = of.select("account_id", "metric_code", "agg_type", "period_id", "thresholds", "offset", "ts_ns", "value", "operation_type", F.explode(dim_sets(F.col("matched"))).alias("dims"))
    kinds, by = kinds_of(metrics.where(F.size("thresholds") > 0)), [*KEY, "agg_type"]
    newest = F.when(F.col("ts_ns") > 0, F.struct("ts_ns", (-F.col("offset")).alias("order"), "value"))
    measures = {
        "count": ("n", "sum", F.lit(1).cast("long")),
        "sum": ("total", "sum", F.col("value").cast("decimal(20,0)")),
        "max": ("largest", "max", F.col("value")),
        "latest": ("newest", "max", newest),
    }
    chosen = {name: (how, col) for kind, (name, how, col) in measures.items() if kind in kinds or kind == "count"}
    needed = {kind for kind in measures if kind in kinds or kind == "count"}
    ordinary, members = (None, None) if earlier is None else (_ordinary(earlier[0], needed), earlier[1])
    parts = []
    if kinds - {"count_unique"}:
        parts.append(with_running(spread.where("agg_type <> 'count_unique'"), by, chosen, block=block, initial=ordinary))
    if "count_unique" in kinds:
        # an operation changes the count if it takes its value in or out: what the value's last operation was decides
        packed = F.shiftleft("offset", 2).bitwiseOR(F.least(F.col("operation_type").cast("long"), F.lit(3).cast("long")))
        toggled = with_running(spread.where("agg_type = 'count_unique'"), [*by, "value"], {"op": ("max", packed)}, block=block, initial=None if members is None else members.select(*by, "value", F.col("last_op").alias("op")))
        inside = (F.col("operation_type") != REMOVE).cast("long")
        earlier = F.coalesce((F.col("prev_op").bitwiseAND(3) != REMOVE).cast("long"), F.lit(0))
        change = toggled.withColumn("change", inside - earlier).drop("op", "prev_op")
        counts = None if members is None else members.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("last_op") != REMOVE).alias("members"))
        parts.append(with_running(change, by, {"n": ("sum", F.lit(1).cast("long")), "members": ("sum", F.col("change"))}, block=block, initial=counts))
    if not parts:
        parts.append(with_running(spread, by, chosen, block=block))
    run = reduce(lambda x, y: x.unionByName(y), [p.select(*by, "thresholds", "offset", "ts_ns", _current("", kinds, p).alias("cur"), F.when(F.col("prev_n").isNotNull(), _current("prev_", kinds, p)).alias("prev")) for p in parts])
    return run


def _ordinary(rollup: DataFrame, measures: set[str]) -> DataFrame:
    """What measures of running usage are after the events of a rollup."""
    newest = F.when(F.col("last_timestamp") > 0, F.struct(F.col("last_timestamp").alias("ts_ns"), F.col("last_order").alias("order"), F.col("last_value").alias("value")))
    found = {"n": F.col("count"), "total": F.col("sum"), "largest": F.col("max"), "newest": newest}
    measured = {kind: name for kind, name in (("count", "n"), ("sum", "total"), ("max", "largest"), ("latest", "newest")) if kind in measures}
    return rollup.select(*KEY, "agg_type", *(found[name].alias(name) for name in measured.values()))


def alerts(events: DataFrame, metrics: DataFrame, block: int = BLOCK, earlier: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A row for each time a threshold fires."""
    each = running_usage(events, metrics, block, earlier).select("*", F.posexplode("thresholds").alias("threshold_index", "threshold"))
    crossed, before = F.col("cur") >= F.col("threshold.value"), F.coalesce(F.col("prev") >= F.col("threshold.value"), F.lit(False))
    fired = each.where(crossed & (F.col("threshold.recurring") | ~before))
    return fired.select(*KEY, "threshold_index", F.col("threshold.code").alias("threshold_code"), F.col("cur").alias("value_at_cross"), F.col("ts_ns").alias("event_timestamp"), "offset")


def alert_flags(events: DataFrame, metrics: DataFrame, block: int = BLOCK) -> DataFrame:
    """By key, the bits of the thresholds that are crossed now."""
    last = running_usage(events, metrics, block).groupBy(*KEY).agg(F.max_by(F.struct("cur", "thresholds"), "offset").alias("last"))
    bits = F.transform(F.col("last.thresholds"), lambda t, i: F.when(F.col("last.cur") >= t["value"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return last.select(*KEY, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("alert_flags"))


def alert_log(fired: DataFrame) -> DataFrame:
    """Alerts numbered from 0, in the order of events; of one event, the unfiltered key first."""
    rows = fired.withColumn("n_dims", F.size("dims")).withColumn("dims_text", dims_text(F.col("dims")))
    return assign_offsets(rows, ["offset", "n_dims", "dims_text", "threshold_index"], name="log_index").drop("n_dims", "dims_text")
