"""Named queries over the star-schema tables, each with the SQL that another engine runs to check it.

A query takes a session and the folder of the tables. Constants are arguments of time, never the wall clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import calendar_period, day_period, fixed_period, fnv1a64, uuid7, uuid7_ms, week_period
from tallyforge.operators import alerts as al
from tallyforge.operators import ingest, observability, partitions, progress, quality, registry, retention, usage
from tallyforge.operators.dims import dims_text
from tallyforge.operators.registry import Metric, Threshold, metrics_table
from tallyforge.operators.rollup import rollup
from tallyforge.plans import oracle as o
from tallyforge.schemas import LATE_GRACE_NS, NS_PER_DAY, NS_PER_SECOND
from tallyforge.sources import json_events, segments
from tallyforge.sources.synthetic import BASE_NS, synthetic_events
from tallyforge.sources.tables import ALERT_METRICS, EVENT_METRICS, ORDERS, SHIPPED, SHIPPED_LATEST, app_events, order_events, read, replayed, shipments
from tallyforge.storage import new_dir
from tallyforge.streaming import alert_stream, rollup_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ACCOUNT, CUSTOMER = 7, 5
JAN1, JAN8, JAN20 = (x * NS_PER_SECOND for x in (1_704_067_200, 1_704_672_000, 1_705_708_800))
JAN10_NOON = 1_704_888_000 * NS_PER_SECOND
Y1996, Y1999 = 820_454_400 * NS_PER_SECOND, 915_148_800 * NS_PER_SECOND
BY_CODE = {m.code: m for m in EVENT_METRICS}
KEY_COLUMNS = ["account_id", "metric_code", "period_id", "dims"]
MEASURES = ["sum", "count", "max", "last_value", "last_timestamp", "last_seg_offset"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _measures(df: DataFrame, *keep: str | Column) -> DataFrame:
    return df.select(*keep, *(F.col(c).cast("long").alias(c) for c in MEASURES))


def _rows(df: DataFrame) -> DataFrame:
    return _measures(df, "account_id", "metric_code", "period_id", dims_text(F.col("dims")).alias("dims"))


def _app_rollup(spark: SparkSession, sf_dir: str, *codes: str) -> DataFrame:
    metrics = [m for m in EVENT_METRICS if not codes or m.code in codes]
    events = app_events(spark, sf_dir)
    return rollup(events.where(F.col("metric_code").isin(*codes)) if codes else events, metrics_table(spark, metrics))


# --- counts, sums, maxima and latest values by period


def _count_by(period: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return app_events(spark, sf_dir).groupBy("account_id", "metric_code", period(F.col("ts_ns")).alias("period_id")).agg(F.count("*").alias("count"))

    return run


for _name, _period, _args in (
    ("count_by_day", day_period, ("day",)),
    ("count_by_week", week_period, ("week",)),
    ("count_by_fixed30d", fixed_period, ("fixed",)),
    ("count_by_calendar_cd1", calendar_period, ("calendar", 1)),
    ("count_by_calendar_cd15", lambda ts: calendar_period(ts, 15), ("calendar", 15)),
):
    query(_name, f"WITH {o.APP_EVENTS} SELECT account_id, metric_code, CAST({o.period_sql(*_args)} AS BIGINT) AS period_id, count(*) AS count FROM app GROUP BY ALL")(_count_by(_period))


@query("sum_by_calendar", f"WITH {o.ORDERS} SELECT account_id, CAST({o.period_sql('calendar', 1)} AS BIGINT) AS period_id, CAST(sum(value) AS BIGINT) AS sum, count(*) AS count FROM app GROUP BY ALL")
def sum_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup(order_events(spark, sf_dir), metrics_table(spark, [ORDERS]))
    return rows.select("account_id", "period_id", F.col("sum").cast("long").alias("sum"), "count")


@query("sum_scaled_total", f"WITH {o.APP_EVENTS} SELECT metric_code, CAST(sum(value) AS BIGINT) AS sum, count(*) AS count FROM app GROUP BY ALL")
def sum_scaled_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app_events(spark, sf_dir).groupBy("metric_code").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("sum"), F.count("*").alias("count"))


def _kind(code: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(_app_rollup(spark, sf_dir, code))

    return run


for _name, _code in (("max_by_week", "view"), ("latest_by_fixed", "error"), ("count_unique_add_remove", "signup"), ("count_day_rollup", "click"), ("sum_calendar_rollup", "purchase")):
    query(_name, f"WITH {o.APP_EVENTS}, {o.rollup_sql([BY_CODE[_code]])} SELECT {o.FLAT} FROM roll")(_kind(_code))


@query("count_unique_adds", f"WITH {o.APP_EVENTS}, adds AS (SELECT * FROM app WHERE operation_type <> 2), {o.rollup_sql([BY_CODE['signup']], 'adds')} SELECT {o.FLAT} FROM roll")
def count_unique_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    adds = app_events(spark, sf_dir).where("operation_type <> 2 and metric_code = 'signup'")
    return _rows(rollup(adds, metrics_table(spark, [BY_CODE["signup"]])))


@query("latest_with_ties", f"WITH {o.SHIPMENTS}, {o.rollup_sql([SHIPPED_LATEST])} SELECT {o.FLAT} FROM roll")
def latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(rollup(shipments(spark, sf_dir), metrics_table(spark, [SHIPPED_LATEST])))


@query("all_aggs_one_pass", f"WITH {o.APP_EVENTS}, {o.rollup_sql(EVENT_METRICS)} SELECT {o.FLAT} FROM roll")
def all_aggs_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_app_rollup(spark, sf_dir))


@query("rollup_all_keys", f"WITH {o.SHIPMENTS}, {o.rollup_sql([SHIPPED])} SELECT {o.FLAT} FROM roll")
def rollup_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(rollup(shipments(spark, sf_dir), metrics_table(spark, [SHIPPED])))


# --- usage of one account


def _usage(name: str, code: str, start: int, end: int, filters: dict[str, str] | None = None, metric: Metric | None = None, known: bool = True) -> None:
    metric = metric or BY_CODE.get(code)
    dims = ";".join(f"{k}={v}" for k, v in sorted((filters or {}).items()))
    of = [metric] if known else [m for m in EVENT_METRICS if m.code != code]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = app_events(spark, sf_dir).where((F.col("account_id") == ACCOUNT) & (F.col("metric_code") == code))
        rows = rollup(events, metrics_table(spark, of))
        return _measures(usage.usage_query(rows, ACCOUNT, code, metric if known else None, start, end, filters))

    query(name, f"WITH {o.APP_EVENTS}, {o.rollup_sql(of)} SELECT {o.MERGED} FROM roll WHERE account_id = {ACCOUNT} AND metric_code = '{code}' AND {o.touched(metric if known else None, start, end)} AND dims = '{dims}'")(run)


_usage("usage_query_range", "purchase", JAN1, JAN20)
_usage("usage_query_empty_range", "click", JAN8, JAN8)
_usage("usage_query_partial_bucket", "click", JAN8 + NS_PER_DAY // 2, JAN20 + NS_PER_DAY // 3)
_usage("usage_query_unknown_metric", "error", JAN1, JAN20, known=False)
_usage("usage_query_unique_multi_period", "signup", JAN1, JAN20)
_usage("usage_query_max_weeks", "view", JAN1, JAN20)
_usage("usage_query_latest", "error", JAN1, JAN20)
_usage("usage_dim_single", "click", JAN1, JAN20, {"parity": "even"})
_usage("usage_dim_and2", "click", JAN1, JAN20, {"parity": "odd", "kband": "1"})


@query("usage_realtime_at", f"WITH {o.APP_EVENTS}, {o.rollup_sql(EVENT_METRICS)} SELECT {o.MERGED} FROM roll WHERE account_id = {ACCOUNT} AND metric_code = 'click' AND period_id = {o.period_at(BY_CODE['click'], JAN10_NOON)} AND dims = ''")
def usage_realtime_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(usage.usage_realtime(_app_rollup(spark, sf_dir, "click"), ACCOUNT, BY_CODE["click"], JAN10_NOON))


_TWO = {"returnflag": "A", "linestatus": "F"}
_SEGMENTS = SHIPPED.filters["segment"]


@query(
    "usage_dim_and2_of_3_exact_set",
    f"WITH {o.SHIPMENTS}, {o.rollup_sql([SHIPPED])} "
    + " UNION ALL ".join(
        f"SELECT '{segment}' AS segment, {o.MERGED} FROM roll WHERE account_id = {CUSTOMER} AND {o.touched(SHIPPED, Y1996, Y1999)} AND dims = 'linestatus=O;segment={segment}'" for segment in _SEGMENTS
    ),
)
def usage_dim_and2_of_3_exact_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By segment (a customer has one); line items with a declared return flag match three dimensions and don't count."""
    rows = rollup(shipments(spark, sf_dir).where(F.col("account_id") == CUSTOMER), metrics_table(spark, [SHIPPED]))
    parts = [_measures(usage.usage_query(rows, CUSTOMER, "shipped", SHIPPED, Y1996, Y1999, {"linestatus": "O", "segment": x}).withColumn("segment", F.lit(x)), "segment") for x in _SEGMENTS]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(
    "usage_dim_and2_subset",
    f"""WITH {o.SHIPMENTS}, {o.spread_sql([SHIPPED])}
    SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS sum, count(*) AS count, 0::BIGINT AS max, 0::BIGINT AS last_value, 0::BIGINT AS last_timestamp, CAST(coalesce(max("offset"), 0) AS BIGINT) AS last_seg_offset
    FROM placed WHERE account_id = {CUSTOMER} AND {o.touched(SHIPPED, Y1996, Y1999)} AND d1 = 'linestatus=F' AND d2 = 'returnflag=A'""",
)
def usage_dim_and2_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(usage.usage_query_subset(shipments(spark, sf_dir), metrics_table(spark, [SHIPPED]), CUSTOMER, SHIPPED, Y1996, Y1999, _TWO))


def _breakdown_sql(source: str, metric: Metric, account: int, start: int, end: int, keys: list[str]) -> str:
    ordered = sorted(keys)
    named = ", ".join(f"split_part(split_part(dims, ';', {ordered.index(k) + 1}), '=', 2) AS dim_{i}" for i, k in enumerate(keys))
    like = ";".join(f"{k}=%" for k in ordered)
    n = len(keys) - 1
    return f"""WITH {source}, {o.rollup_sql([metric])} SELECT * FROM (SELECT {named}, {o.MERGED} FROM roll WHERE account_id = {account} AND metric_code = '{metric.code}'
      AND {o.touched(metric, start, end)} AND dims LIKE '{like}' AND length(dims) - length(replace(dims, ';', '')) = {n} GROUP BY {", ".join(str(i + 1) for i in range(len(keys)))}) WHERE sum <> 0 OR count <> 0 OR max <> 0"""


def _breakdown(name: str, keys: list[str]) -> None:
    metric = BY_CODE["purchase"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = usage.breakdown(_app_rollup(spark, sf_dir, metric.code), ACCOUNT, metric, JAN1, JAN20, keys)
        return _measures(out, *(f"dim_{i}" for i in range(len(keys))))

    query(name, _breakdown_sql(o.APP_EVENTS, metric, ACCOUNT, JAN1, JAN20, keys))(run)


_breakdown("breakdown_1d", ["kband"])
_breakdown("breakdown_2d", ["parity", "kband"])


@query("breakdown_3d", _breakdown_sql(o.SHIPMENTS, SHIPPED, CUSTOMER, Y1996, Y1999, ["segment", "returnflag", "linestatus"]))
def breakdown_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup(shipments(spark, sf_dir), metrics_table(spark, [SHIPPED]))
    keys = ["segment", "returnflag", "linestatus"]
    return _measures(usage.breakdown(rows, CUSTOMER, SHIPPED, Y1996, Y1999, keys), *(f"dim_{i}" for i in range(3)))


@query(
    "account_usage_overlay",
    f"""WITH {o.APP_EVENTS}, old AS (SELECT * FROM app WHERE ts_ns < {JAN8}), {o.rollup_sql(EVENT_METRICS)},
    {o.rollup_sql(EVENT_METRICS, "old").replace("placed AS", "placed_old AS").replace("FROM placed)", "FROM placed_old)").replace("spread AS", "spread_old AS").replace("FROM spread", "FROM spread_old").replace("plain AS", "plain_old AS").replace("FROM plain", "FROM plain_old").replace("members AS", "members_old AS").replace("FROM members", "FROM members_old").replace("roll AS", "roll_old AS")},
    fresh AS (SELECT * FROM roll WHERE metric_code = 'click'),
    joined AS (SELECT * FROM fresh UNION ALL SELECT * FROM roll_old ANTI JOIN fresh USING (account_id, metric_code, period_id, dims))
    SELECT {o.FLAT} FROM joined WHERE account_id = {ACCOUNT} AND period_id BETWEEN 0 AND 100000""",
)
def account_usage_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the time before 8 January, under fresh rows of one metric."""
    metrics = metrics_table(spark, EVENT_METRICS)
    events = app_events(spark, sf_dir).where(F.col("account_id") == ACCOUNT)
    stored, fresh = rollup(events.where(F.col("ts_ns") < JAN8), metrics), rollup(events.where("metric_code = 'click'"), metrics)
    return _rows(usage.account_usage(stored, fresh, ACCOUNT, 0, 100_000))


@query(
    "events_list_range",
    f"""WITH {o.APP_EVENTS} SELECT "offset", ts_ns, account_id, CASE WHEN metric_code = 'error' THEN '' ELSE metric_code END AS metric_code, value, CAST(operation_type AS INTEGER) AS operation_type
    FROM app WHERE account_id = {ACCOUNT} AND ts_ns BETWEEN {JAN8} AND {JAN20} ORDER BY "offset" LIMIT 1024""",
)
def events_list_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = metrics_table(spark, [m for m in EVENT_METRICS if m.code != "error"])
    return usage.events_list(app_events(spark, sf_dir), known, ACCOUNT, JAN8, JAN20)


# --- ingest

_REPLAYED = 'twice AS (SELECT * FROM app UNION ALL SELECT * REPLACE ("offset" + 1000000000 AS "offset") FROM app WHERE "offset" % 10 = 0)'
_FIRSTS = "SELECT *, row_number() OVER (PARTITION BY metric_code, account_id, ts_ns, value ORDER BY \"offset\") AS nth, count(*) OVER (PARTITION BY metric_code, account_id, ts_ns, value) AS n"
_EVENT_COLUMNS = '"offset", ts_ns, account_id, metric_code, value, CAST(operation_type AS INTEGER) AS operation_type'


@query("dedup_replay", f"WITH {o.APP_EVENTS}, {_REPLAYED} SELECT {_EVENT_COLUMNS} FROM ({_FIRSTS} FROM twice) WHERE nth = 1")
def dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dedup(replayed(app_events(spark, sf_dir)).drop("props"))


@query("dedup_ignores_op", f"WITH {o.APP_EVENTS}, twice AS (SELECT * FROM app UNION ALL SELECT * REPLACE (\"offset\" + 1 AS \"offset\", 2 AS operation_type) FROM app WHERE metric_code = 'signup') SELECT metric_code, CAST(operation_type AS INTEGER) AS operation_type, count(*) AS n FROM ({_FIRSTS} FROM twice) WHERE nth = 1 GROUP BY ALL")
def dedup_ignores_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sign-up is followed by its removal at the same instant: that counts as the same event."""
    events = app_events(spark, sf_dir).drop("props")
    again = events.where("metric_code = 'signup'").withColumns({"offset": F.col("offset") + 1, "operation_type": F.lit(2)})
    return ingest.dedup(events.unionByName(again)).groupBy("metric_code", "operation_type").agg(F.count("*").alias("n"))


@query("duplicate_counts", f"WITH {o.APP_EVENTS}, {_REPLAYED} SELECT metric_code, account_id, ts_ns, value, n - 1 AS n_duplicates, \"offset\" FROM ({_FIRSTS} FROM twice) WHERE nth = 1 AND n > 1")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.duplicates(replayed(app_events(spark, sf_dir)))


@query(
    "dedup_ingest_result",
    f"""WITH {o.APP_EVENTS}, {_REPLAYED} SELECT count(*) FILTER (WHERE nth = 1) AS n_stored, count(*) FILTER (WHERE nth > 1) AS n_duplicates, max("offset") FILTER (WHERE nth = 1) AS last_offset,
    CASE WHEN bool_or(metric_code = 'error') THEN 'unknown_metric' ELSE 'ok' END AS status FROM ({_FIRSTS} FROM twice)""",
)
def dedup_ingest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = metrics_table(spark, [m for m in EVENT_METRICS if m.code != "error"])
    return ingest.ingest_result(replayed(app_events(spark, sf_dir)), known)


@query("dedup_across_batches", f"WITH {o.APP_EVENTS} SELECT {_EVENT_COLUMNS} FROM app WHERE \"offset\" % 3 <> 0")
def dedup_across_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = app_events(spark, sf_dir).drop("props")
    return ingest.dedup_against(events, events.where("offset % 3 = 0"))


@query("stamped_times", f"WITH {o.APP_EVENTS} SELECT \"offset\", CASE WHEN \"offset\" % 4 = 0 THEN {JAN20} + \"offset\" ELSE ts_ns END AS ts_ns FROM app")
def stamped_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = app_events(spark, sf_dir).withColumn("ts_ns", F.when(F.col("offset") % 4 == 0, 0).otherwise(F.col("ts_ns")))
    return ingest.stamp(events, JAN20, "offset").select("offset", "ts_ns")


@query("assigned_offsets", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (ORDER BY {', '.join(o.LINE_ORDER)}) + 99 AS \"offset\" FROM lineitem")
def assigned_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ingest.assign_offsets(read(spark, sf_dir, "lineitem"), o.LINE_ORDER, start=100)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "offset")


@query("unknown_metric_stored_not_aggregated", f"WITH {o.APP_EVENTS}, {o.rollup_sql([m for m in EVENT_METRICS if m.code != 'error'])} SELECT metric_code, count(*) AS n_stored, CAST(coalesce((SELECT count(*) FROM roll r WHERE r.metric_code = app.metric_code), 0) AS BIGINT) AS n_keys FROM app GROUP BY metric_code")
def unknown_metric_stored_not_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = app_events(spark, sf_dir)
    keys = rollup(events, metrics_table(spark, [m for m in EVENT_METRICS if m.code != "error"])).groupBy("metric_code").agg(F.count("*").alias("n"))
    stored = events.groupBy("metric_code").agg(F.count("*").alias("n_stored"))
    return stored.join(keys, "metric_code", "left").select("metric_code", "n_stored", F.coalesce("n", F.lit(0)).alias("n_keys"))


@query(
    "json_ingest",
    """SELECT user_id // 10 AS batch, bool_or(event_id % 97 = 0) OVER (PARTITION BY user_id // 10) AS is_sync, row_number() OVER (PARTITION BY user_id // 10 ORDER BY event_id) - 1 AS idx, user_id AS account_id, event_type AS metric_code,
    event_id AS value FROM events""",
)
def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON batches, with fields that the reader doesn't know, and read back."""
    mode = F.when(F.col("event_id") % 97 == 0, "sync").otherwise("async")
    one = F.struct("event_id", F.col("user_id").alias("account_id"), F.col("event_type").alias("metric_code"), F.col("event_id").alias("value"), mode.alias("delivery_mode"), F.struct(F.lit(1).alias("x")).alias("unknown"))
    batches = read(spark, sf_dir, "events").groupBy(F.expr("user_id div 10").alias("batch")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("body"))
    return json_events.parse_batches(batches).select("batch", "is_sync", "idx", "account_id", "metric_code", "value")


# --- alerts


def _alerts(name: str, code: str) -> None:
    metrics = [m for m in ALERT_METRICS if m.code == code]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = app_events(spark, sf_dir).where(F.col("metric_code") == code)
        return _fired(al.alerts(events, metrics_table(spark, metrics)).where(F.size("dims") == 0))

    query(name, f"WITH {o.APP_EVENTS}, {o.alerts_sql(metrics)} SELECT {_FIRED} FROM fired WHERE dims = ''")(run)


_FIRED = 'account_id, metric_code, period_id, dims, threshold_index, threshold_code, CAST(cur AS BIGINT) AS value_at_cross, ts_ns AS event_timestamp, "offset"'


def _fired(df: DataFrame) -> DataFrame:
    return df.select("account_id", "metric_code", "period_id", dims_text(F.col("dims")).alias("dims"), "threshold_index", "threshold_code", F.col("value_at_cross").cast("long").alias("value_at_cross"), "event_timestamp", "offset")


_alerts("alerts_count", "click")
_alerts("alerts_sum", "purchase")
_alerts("alerts_max", "view")
_alerts("alerts_latest_refire", "error")
_alerts("alerts_unique_refire", "signup")


@query("alerts_dims", f"WITH {o.APP_EVENTS}, {o.alerts_sql(ALERT_METRICS)} SELECT {_FIRED} FROM fired")
def alerts_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fired(al.alerts(app_events(spark, sf_dir), metrics_table(spark, ALERT_METRICS)))


@query("alerts_recurring", f"WITH {o.APP_EVENTS}, {o.alerts_sql(ALERT_METRICS)} SELECT metric_code, threshold_code, count(*) AS n, count(DISTINCT account_id) AS n_accounts FROM fired WHERE recurring GROUP BY ALL")
def alerts_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = al.alerts(app_events(spark, sf_dir), metrics_table(spark, ALERT_METRICS))
    recurring = [t.code for m in ALERT_METRICS for t in m.thresholds if t.recurring]
    return fired.where(F.col("threshold_code").isin(*recurring)).groupBy("metric_code", "threshold_code").agg(F.count("*").alias("n"), F.count_distinct("account_id").alias("n_accounts"))


@query(
    "alert_flags_final",
    f"""WITH {o.APP_EVENTS}, {o.alerts_sql(ALERT_METRICS)}, last AS (SELECT *, row_number() OVER (PARTITION BY account_id, metric_code, period_id, dims, threshold_index ORDER BY "offset" DESC) AS nth FROM crossings)
    SELECT account_id, metric_code, period_id, dims, CAST(sum(CASE WHEN crossed THEN 1 << threshold_index ELSE 0 END) AS BIGINT) AS alert_flags FROM last WHERE nth = 1 GROUP BY ALL""",
)
def alert_flags_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = al.alert_flags(app_events(spark, sf_dir), metrics_table(spark, ALERT_METRICS))
    return flags.select("account_id", "metric_code", "period_id", dims_text(F.col("dims")).alias("dims"), "alert_flags")


_LOG = 'SELECT row_number() OVER (ORDER BY "offset", CASE WHEN dims = \'\' THEN 0 ELSE 1 + length(dims) - length(replace(dims, \';\', \'\')) END, dims, threshold_index) - 1 AS log_index, * FROM fired'


def _listed(name: str, account: int, since: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = al.alert_log(al.alerts(app_events(spark, sf_dir), metrics_table(spark, ALERT_METRICS)))
        page = usage.alerts_list(log, account, since)
        return page.select("log_index", "account_id", "metric_code", "period_id", dims_text(F.col("dims")).alias("dims"), "threshold_index", "threshold_code", F.col("value_at_cross").cast("long").alias("value_at_cross"), "event_timestamp", "offset")

    of = f"AND account_id = {account}" if account else ""
    query(name, f"WITH {o.APP_EVENTS}, {o.alerts_sql(ALERT_METRICS)}, log AS ({_LOG}) SELECT log_index, {_FIRED} FROM log WHERE log_index >= {since} {of} ORDER BY log_index LIMIT 256")(run)


_listed("alerts_list_since", 0, 50)
_listed("alerts_list_account", ACCOUNT, 0)


@query(
    "alerts_list_deleted_metric",
    f"""WITH {o.APP_EVENTS}, {o.alerts_sql(ALERT_METRICS)}, log AS ({_LOG}) SELECT log_index, account_id, CASE WHEN metric_code = 'click' THEN '' ELSE metric_code END AS metric_code,
    CASE WHEN metric_code = 'click' OR threshold_index = 1 THEN '' ELSE threshold_code END AS threshold_code, CAST(cur AS BIGINT) AS value_at_cross FROM log ORDER BY log_index LIMIT 256""",
)
def alerts_list_deleted_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric was deleted after its alerts fired, and the others lost their second threshold."""
    log = al.alert_log(al.alerts(app_events(spark, sf_dir), metrics_table(spark, ALERT_METRICS)))
    left = metrics_table(spark, [replace(m, thresholds=m.thresholds[:1]) for m in ALERT_METRICS if m.code != "click"])
    page = usage.alerts_list(log, metrics=left)
    return page.select("log_index", "account_id", "metric_code", "threshold_code", F.col("value_at_cross").cast("long").alias("value_at_cross"))


# --- event time


_ARRIVED = 'arrived AS (SELECT *, "offset" * 7919 % 10007 * 10000000000 + "offset" AS arrival FROM app), seen AS (SELECT *, max(ts_ns) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS watermark_ns FROM arrived)'


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrival = F.col("offset") * 7919 % 10007 * 10_000_000_000 + F.col("offset")
    return progress.with_watermark(app_events(spark, sf_dir).withColumn("arrival", arrival), order="arrival", block=1_000_000_000_000)


@query("late_events", f'WITH {o.APP_EVENTS}, {_ARRIVED} SELECT "offset", ts_ns, watermark_ns FROM seen WHERE ts_ns < watermark_ns - {LATE_GRACE_NS}')
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(spark, sf_dir).where("is_late").select("offset", "ts_ns", "watermark_ns")


@query("watermark_progress", f'WITH {o.APP_EVENTS}, {_ARRIVED} SELECT "offset", watermark_ns, ts_ns < watermark_ns - {LATE_GRACE_NS} AS is_late FROM seen')
def watermark_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(spark, sf_dir).select("offset", "watermark_ns", "is_late")


@query("late_events_still_counted", f"WITH {o.APP_EVENTS}, {_ARRIVED} SELECT metric_code, CAST({o.period_sql('day')} AS BIGINT) AS period_id, count(*) AS count, count(*) FILTER (WHERE ts_ns < watermark_ns - {LATE_GRACE_NS}) AS n_late FROM seen GROUP BY ALL")
def late_events_still_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(spark, sf_dir).groupBy("metric_code", day_period(F.col("ts_ns")).alias("period_id")).agg(F.count("*").alias("count"), F.count_if("is_late").alias("n_late"))


# --- partitions, retention, definitions, monitoring


@query("partition_counts", f"WITH {o.ORDERS} SELECT CAST(account_id % 256 AS INTEGER) AS partition_id, count(*) AS n_events FROM app GROUP BY ALL")
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.partition_counts(order_events(spark, sf_dir))


@query("partition_events", f'WITH {o.ORDERS} SELECT "offset", account_id FROM app WHERE account_id % 256 = 57')
def partition_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.of_partition(order_events(spark, sf_dir), 57).select("offset", "account_id")


@query("partition_map", "SELECT CAST(range AS INTEGER) AS partition_id, CAST(range % 3 AS INTEGER) AS leader, CAST((range + 1) % 3 AS INTEGER) AS replica_1, CAST((range + 2) % 3 AS INTEGER) AS replica_2 FROM range(256)")
def partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.partition_map(spark, 3)


@query("partition_moves_2_to_3", "SELECT CAST(range AS INTEGER) AS partition_id, CAST(range % 2 AS INTEGER) AS from_node, CAST(range % 3 AS INTEGER) AS to_node FROM range(256) WHERE range % 2 <> range % 3")
def partition_moves_2_to_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.partition_moves(partitions.partition_map(spark, 2), partitions.partition_map(spark, 3))


_NOW = JAN20 + 80 * NS_PER_DAY
_CUTOFF = _NOW - 90 * NS_PER_DAY
_CUTOFFS = " ".join(f"WHEN '{m.code}' THEN {o.period_at(m, _CUTOFF)}" for m in EVENT_METRICS)


@query("retention_survivors", f"WITH {o.APP_EVENTS} SELECT \"offset\", ts_ns FROM app WHERE ts_ns >= {_CUTOFF}")
def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.keep_events(app_events(spark, sf_dir), _NOW).select("offset", "ts_ns")


@query("retention_rollup", f"WITH {o.APP_EVENTS}, {o.rollup_sql(EVENT_METRICS)} SELECT {o.FLAT} FROM roll WHERE period_id >= CASE metric_code {_CUTOFFS} END")
def retention_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = metrics_table(spark, EVENT_METRICS)
    return _rows(retention.keep_rollup(rollup(app_events(spark, sf_dir), metrics), metrics, _NOW))


@query(
    "registry_fold",
    """WITH log AS (SELECT 'm' || (event_id % 50) AS metric_code, event_id AS version, event_type AS agg_type, event_id % 7 = 0 AS deleted FROM events),
    last AS (SELECT *, row_number() OVER (PARTITION BY metric_code ORDER BY version DESC) AS nth FROM log) SELECT metric_code, version, agg_type FROM last WHERE nth = 1 AND NOT deleted""",
)
def registry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.concat(F.lit("m"), (F.col("event_id") % 50).cast("string")).alias("metric_code"), F.col("event_id").alias("version"), F.col("event_type").alias("agg_type"), (F.col("event_id") % 7 == 0).alias("deleted"))
    return registry.fold(log).drop("deleted")


def _metric_values() -> str:
    rows = []
    for m in ALERT_METRICS:
        filters = ";".join(f"{k}={'|'.join(v)}" for k, v in m.filters.items())
        thresholds = ";".join(f"{t.code}:{t.value}:{str(t.recurring).lower()}" for t in m.thresholds)
        rows.append(f"('{m.code}', '{m.agg_type}', '', false, '{m.period_type}', {m.billing_cycle_day}, {m.period_ns}, '{filters}', '{thresholds}')")
    return ", ".join(rows)


@query("metric_list", f"SELECT col0 AS metric_code, col1 AS agg_type, col2 AS field_name, col3 AS recurring, col4 AS period_type, CAST(col5 AS INTEGER) AS billing_cycle_day, CAST(col6 AS BIGINT) AS period_ns, col7 AS filters, col8 AS thresholds FROM (VALUES {_metric_values()})")
def metric_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.metric_list(metrics_table(spark, ALERT_METRICS))


_BUCKETS = " ".join(f"WHEN d <= {b} THEN {i}" for i, b in enumerate(observability.BUCKETS_NS))
_BOUNDS = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(observability.BUCKETS_NS))


@query(
    "latency_histogram",
    f"""WITH {o.APP_EVENTS}, d AS (SELECT value * 7 AS d FROM app WHERE metric_code <> 'signup'), c AS (SELECT CASE {_BUCKETS} ELSE {len(observability.BUCKETS_NS)} END AS bucket, count(*) AS n FROM d GROUP BY ALL),
    f AS (SELECT CAST(range AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM range({len(observability.BUCKETS_NS) + 1}) LEFT JOIN c ON bucket = range)
    SELECT bucket, CAST(CASE bucket {_BOUNDS} END AS BIGINT) AS le_ns, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS cumulative FROM f""",
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = app_events(spark, sf_dir).where("metric_code <> 'signup'")
    return observability.latency_histogram(rows, F.col("value") * 7)


@query("engine_status", f"WITH {o.APP_EVENTS}, {o.rollup_sql(EVENT_METRICS)} SELECT (SELECT count(*) FROM app) AS n_events, (SELECT max(\"offset\") FROM app) AS last_offset, (SELECT count(DISTINCT account_id) FROM app) AS n_accounts, count(*) AS n_keys, count(DISTINCT metric_code) AS n_metrics FROM roll")
def engine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = app_events(spark, sf_dir)
    return observability.engine_status(events, rollup(events, metrics_table(spark, EVENT_METRICS)))


@query("quality_checks", f"WITH {o.APP_EVENTS} SELECT count(*) AS n_events, 0::BIGINT AS n_null, count(*) FILTER (WHERE ts_ns <= 0) AS n_without_time, count(*) FILTER (WHERE value < 0) AS n_negative, 0::BIGINT AS n_unknown_operation, count(*) FILTER (WHERE \"offset\" % 100 = 0) AS n_broken FROM app")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event in a hundred is changed after its checksum was taken."""
    events = quality.with_checksum(app_events(spark, sf_dir))
    return quality.checks(events.withColumn("value", F.when(F.col("offset") % 100 == 0, F.col("value") + 1).otherwise(F.col("value"))))


@query("metric_code_fnv1a", "SELECT * FROM (VALUES ('', -3750763034362895579), ('api_calls', -6650755458845778815), ('region', -4083174813776337699), ('us', 631696951056195225)) t(code, hash)")
def metric_code_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.range(1).select(F.explode(F.array(*map(F.lit, ("", "api_calls", "region", "us")))).alias("code"))
    return codes.select("code", fnv1a64(F.col("code")).alias("hash"))


# --- streams, run to the end of what is there


def _landed(spark: SparkSession, events: DataFrame, files: int = 4) -> str:
    """Events as so many files, in the order of their offsets: written one after the other, as streams read by the files' times."""
    path = new_dir(spark, "landing")
    bounds = events.approxQuantile("offset", [i / files for i in range(1, files)], 0.01)
    part = F.lit(0)
    for b in bounds:
        part = part + (F.col("offset") > b).cast("int")
    for i in range(files):
        events.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return path


@query("stream_rollup_equals_batch", f"WITH {o.APP_EVENTS}, {o.rollup_sql(EVENT_METRICS)} SELECT {o.FLAT} FROM roll")
def stream_rollup_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, some of them replayed, read file by file; every event counts once."""
    stream = rollup_stream.read_events_stream(spark, _landed(spark, replayed(app_events(spark, sf_dir))), files_per_trigger=2)
    target = new_dir(spark, "rollup")
    running = rollup_stream.start_rollup(stream, metrics_table(spark, EVENT_METRICS), target, new_dir(spark, "progress"))
    running.awaitTermination()
    return _rows(rollup_stream.read_rollup(spark, target))


@query("stream_alerts_equals_batch", f"WITH {o.APP_EVENTS}, {o.alerts_sql(ALERT_METRICS)} SELECT {_FIRED} FROM fired")
def stream_alerts_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = rollup_stream.read_events_stream(spark, _landed(spark, app_events(spark, sf_dir)))
    target = new_dir(spark, "alerts")
    alert_stream.start_alerts(stream, metrics_table(spark, ALERT_METRICS), target, new_dir(spark, "progress")).awaitTermination()
    return alert_stream.read_alerts(spark, target).withColumn("value_at_cross", F.col("value_at_cross").cast("long"))


# --- record logs, side-cars, synthetic events


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fixed-length records, read back, with the code that a hash stands for."""
    events = app_events(spark, sf_dir).withColumn("metric_hash", fnv1a64(F.col("metric_code")))
    codes = metrics_table(spark, EVENT_METRICS).select("metric_code", fnv1a64(F.col("metric_code")).alias("metric_hash"))
    back = segments.decode_events(segments.encode_events(events)).join(F.broadcast(codes), "metric_hash")
    return back.select("offset", "ts_ns", "account_id", "metric_code", F.col("value").cast("long").alias("value"), "operation_type")


@query("segment_records", f"WITH {o.APP_EVENTS} SELECT {_EVENT_COLUMNS} FROM app")
def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


@query("segment_from_offset", f'WITH {o.APP_EVENTS} SELECT {_EVENT_COLUMNS} FROM app WHERE "offset" >= 500')
def segment_from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.between(_records(spark, sf_dir), 500)


@query("segment_point_read", f'WITH {o.APP_EVENTS} SELECT {_EVENT_COLUMNS} FROM app WHERE "offset" = 500')
def segment_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.between(_records(spark, sf_dir), 500, 501)


@query("props_sidecar", f"WITH {o.APP_EVENTS} SELECT \"offset\", CAST(k // 25 AS VARCHAR) AS kband, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, 2 AS n_props FROM (SELECT event_id AS \"offset\", k FROM raw)")
def props_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties in records of their own, read back and put to their events."""
    events = app_events(spark, sf_dir)
    props = segments.decode_props(segments.encode_props(events))
    return segments.with_props(events.drop("props"), props).select("offset", F.col("props.kband").alias("kband"), F.col("props.parity").alias("parity"), F.size("props").alias("n_props"))


@query("synthetic_profile", "SELECT 20000::BIGINT AS n_events, 20000::BIGINT AS n_offsets, 20::BIGINT AS n_metrics, true AS accounts_fit, true AS accounts_are_skewed, true AS a_tenth_is_removed, true AS some_repeat, true AS some_are_late")
def synthetic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = synthetic_events(spark, 20_000)
    repeated = ingest.duplicates(events).agg(F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("n"))
    seen = events.agg(
        F.count("*").alias("n_events"),
        F.count_distinct("offset").alias("n_offsets"),
        F.count_distinct("metric_code").alias("n_metrics"),
        ((F.min("account_id") == 1) & (F.max("account_id") <= 1000)).alias("accounts_fit"),
        (F.count_if(F.col("account_id") == 1) > 0.1 * F.count("*")).alias("accounts_are_skewed"),
        F.avg((F.col("operation_type") == 2).cast("int")).between(0.08, 0.12).alias("a_tenth_is_removed"),
        F.avg((F.col("ts_ns") < BASE_NS + F.col("offset") * NS_PER_SECOND - 2 * NS_PER_SECOND).cast("int")).between(0.01, 0.03).alias("some_are_late"),
    )
    return seen.join(F.broadcast(repeated.select(F.col("n").between(100, 300).alias("some_repeat"))))  # one row each


@query("rotated_files", f"WITH {o.APP_EVENTS} SELECT metric_code, CAST(CAST(DATE '1970-01-01' + CAST(ts_ns // {NS_PER_DAY} AS INTEGER) AS DATE) AS VARCHAR) AS event_date, count(*) AS n_events, true AS files_are_small FROM app GROUP BY ALL")
def rotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by metric and day into files of at most 50, and counted by where they are."""
    path = new_dir(spark, "rotated")
    segments.write_events(app_events(spark, sf_dir).coalesce(2), path, records_per_file=50)
    files = spark.read.parquet(path).groupBy("metric_code", F.col("event_date").cast("string").alias("event_date"), F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return files.groupBy("metric_code", "event_date").agg(F.sum("n").alias("n_events"), (F.max("n") <= 50).alias("files_are_small"))


@query("uuid7_roundtrip", f"WITH {o.APP_EVENTS} SELECT \"offset\", ts_ns // 1000000 AS ms, true AS is_version_7 FROM app")
def uuid7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = app_events(spark, sf_dir).select("offset", uuid7(F.expr("ts_ns div 1000000"), F.col("offset")).alias("uuid"))
    return key.select("offset", uuid7_ms(F.col("uuid")).alias("ms"), F.col("uuid").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("is_version_7"))


_HUGE = Metric("purchase", "sum", "calendar", 1, thresholds=(Threshold("full", 2**64 - 1),))


@query(
    "sum_saturates",
    f"""WITH {o.APP_EVENTS}, placed AS (SELECT *, {o.period_sql("calendar", 1)} AS period_id FROM app WHERE metric_code = 'purchase'),
    counted AS (SELECT *, row_number() OVER (PARTITION BY account_id, period_id ORDER BY "offset") AS nth FROM placed)
    SELECT account_id, CAST(period_id AS BIGINT) AS period_id, '18446744073709551615' AS value_at_cross, "offset" FROM counted WHERE nth = 4""",
)
def sum_saturates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payment is 2 ** 62, so the fourth of a month brings the sum beyond 64 bits."""
    events = app_events(spark, sf_dir).where("metric_code = 'purchase'").withColumn("value", F.lit(2**62))
    return al.alerts(events, metrics_table(spark, [_HUGE])).select("account_id", "period_id", F.col("value_at_cross").cast("string").alias("value_at_cross"), "offset")
