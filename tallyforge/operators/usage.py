"""Reading: current and past usage, breakdowns, listings. Predicates are literals, so they reach the scan of a stored rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.dims import dims_literal
from tallyforge.operators.registry import Metric
from tallyforge.operators.rollup import merge_periods, vector_partials
from tallyforge.schemas import ALERTS_PAGE, BREAKDOWN_PAGE, EVENTS_PAGE, KEY, MAX_GROUP_KEYS


def _dims(filters: dict[str, str] | None) -> Column:
    return F.col("dims") == dims_literal(filters) if filters else F.size("dims") == 0


def _in_range(code: str, metric: Metric | None, start_ns: int, end_ns: int) -> Column:
    first, last = (metric or Metric(code, "count")).period_range(start_ns, end_ns)
    return (F.col("metric_code") == code) & F.col("period_id").between(first, last)


def usage_query(rollup: DataFrame, account_id: int, code: str, metric: Metric | None, start_ns: int, end_ns: int, filters: dict[str, str] | None = None) -> DataFrame:
    """One row: usage in all periods that [start, end) touches, zeros where there is none. A metric that isn't known (None) is
    looked up by periods of 30 days. Filters select the events that matched exactly these dimensions (or, for one, that one)."""
    rows = rollup.where((F.col("account_id") == account_id) & _in_range(code, metric, start_ns, end_ns) & _dims(filters))
    return merge_periods(rows)


def usage_query_subset(events: DataFrame, metrics: DataFrame, account_id: int, metric: Metric, start_ns: int, end_ns: int, filters: dict[str, str]) -> DataFrame:
    """As ``usage_query``, but events that matched further dimensions count too."""
    has = F.lit(True)
    for k, v in filters.items():
        has = has & F.array_contains("matched", F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")))
    partials = vector_partials(events.where(F.col("account_id") == account_id), metrics)
    rows = partials.where(_in_range(metric.code, metric, start_ns, end_ns) & has)
    return merge_periods(rows)


def usage_realtime(rollup: DataFrame, account_id: int, metric: Metric, now_ns: int) -> DataFrame:
    """One row: usage in the period that now is in."""
    rows = rollup.where((F.col("account_id") == account_id) & (F.col("metric_code") == metric.code) & (F.col("period_id") == metric.period_of(now_ns)) & _dims(None))
    return merge_periods(rows)


def breakdown(rollup: DataFrame, account_id: int, metric: Metric | None, start_ns: int, end_ns: int, keys: list[str], limit: int | None = None) -> DataFrame:
    """A row for each combination of declared values of the keys that has any usage, in the order of declaration, last key
    fastest. ``limit`` of BREAKDOWN_PAGE is the page that a client gets."""
    if metric is None:
        raise ValueError("unknown metric")
    if not 1 <= len(keys) <= MAX_GROUP_KEYS or any(k not in metric.filters for k in keys):
        raise ValueError("1 to 4 declared keys are needed")
    ordered = sorted(keys)
    rows = rollup.where((F.col("account_id") == account_id) & _in_range(metric.code, metric, start_ns, end_ns) & (F.transform("dims", lambda d: d["k"]) == F.array(*map(F.lit, ordered))))
    named = rows.select("*", *(F.col("dims")[ordered.index(k)]["v"].alias(f"dim_{i}") for i, k in enumerate(keys)))
    by = [f"dim_{i}" for i in range(len(keys))]
    out = merge_periods(named, *by).where("sum <> 0 or count <> 0 or max <> 0")
    places = [F.array_position(F.array(*map(F.lit, metric.filters[k])), F.col(c)) for k, c in zip(keys, by, strict=True)]
    out = out.orderBy(*places)
    return out.limit(limit) if limit else out


BREAKDOWN_LIMIT = BREAKDOWN_PAGE


def account_usage(stored: DataFrame, fresh: DataFrame, account_id: int, first_period: int, last_period: int) -> DataFrame:
    """All keys of an account in a range of periods; a fresh row takes the place of a stored one."""
    of = (F.col("account_id") == account_id) & F.col("period_id").between(first_period, last_period)
    kept = stored.where(of).join(fresh.where(of).select(*KEY), KEY, "left_anti")
    return kept.unionByName(fresh.where(of))


def events_list(events: DataFrame, metrics: DataFrame, account_id: int, since_ns: int, until_ns: int, limit: int = EVENTS_PAGE) -> DataFrame:
    """An account's events with since <= time <= until, first come first; the code of a metric that isn't known is blank."""
    rows = events.where((F.col("account_id") == account_id) & F.col("ts_ns").between(since_ns, until_ns)).orderBy("offset").limit(limit)
    known = metrics.select("metric_code", F.col("metric_code").alias("known_code"))
    out = rows.join(known, "metric_code", "left")
    return out.select("offset", "ts_ns", "account_id", F.coalesce("known_code", F.lit("")).alias("metric_code"), "value", "operation_type")


def alerts_list(alert_log: DataFrame, account_id: int = 0, since_index: int = 0, limit: int = ALERTS_PAGE, metrics: DataFrame | None = None) -> DataFrame:
    """Alerts of an account (0: of all) from an index on. Given the present definitions, codes of metrics and thresholds that
    aren't defined any more are blank."""
    mine = F.lit(account_id == 0) | (F.col("account_id") == account_id)
    page = alert_log.where((F.col("log_index") >= since_index) & mine).orderBy("log_index").limit(limit)
    if metrics is None:
        return page
    known = metrics.select("metric_code", F.size("thresholds").alias("_n"))
    named = page.join(known, "metric_code", "left")
    code = F.when(F.col("threshold_index") < F.col("_n"), F.col("threshold_code")).otherwise("")
    blank = named.withColumn("threshold_code", code).withColumn("metric_code", F.when(F.col("_n").isNotNull(), F.col("metric_code")).otherwise(""))
    return blank.select(*page.columns).orderBy("log_index")
