"""The same mappings and periods as SQL text, for checking against another engine."""

from __future__ import annotations

from tallyforge.operators.registry import Metric
from tallyforge.schemas import DEFAULT_PERIOD_NS, NS_PER_DAY, NS_PER_WEEK
from tallyforge.sources.tables import LINE_ORDER

APP_EVENTS = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
app AS (
  SELECT event_id AS "offset", epoch_us(ts) * 1000 AS ts_ns, user_id AS account_id, event_type AS metric_code,
    CASE WHEN event_type = 'signup' THEN k ELSE CAST(round(value * 1000000) AS BIGINT) END AS value,
    CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 2 WHEN event_type = 'signup' THEN 1 ELSE 0 END AS operation_type,
    CASE WHEN k // 25 IN (0, 1, 2) THEN 'kband=' || (k // 25) END AS d1, CASE WHEN k % 2 = 0 THEN 'parity=even' ELSE 'parity=odd' END AS d2, CAST(NULL AS VARCHAR) AS d3
  FROM raw
)"""
SHIPMENTS = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) AS "offset" FROM lineitem),
app AS (
  SELECT "offset", epoch_us(l_shipdate) * 1000 AS ts_ns, o_custkey AS account_id, 'shipped' AS metric_code,
    CAST(round(l_extendedprice * (1 - l_discount) * 1000000) AS BIGINT) AS value, 0 AS operation_type,
    CASE WHEN l_linestatus IN ('F', 'O') THEN 'linestatus=' || l_linestatus END AS d1,
    CASE WHEN l_returnflag IN ('A', 'R') THEN 'returnflag=' || l_returnflag END AS d2,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') THEN 'segment=' || c_mktsegment END AS d3
  FROM numbered JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""
ORDERS = """
app AS (
  SELECT o_orderkey AS "offset", epoch_us(o_orderdate) * 1000 AS ts_ns, o_custkey AS account_id, 'orders' AS metric_code,
    CAST(round(o_totalprice * 1000000) AS BIGINT) AS value, 0 AS operation_type, CAST(NULL AS VARCHAR) AS d1, CAST(NULL AS VARCHAR) AS d2, CAST(NULL AS VARCHAR) AS d3
  FROM orders
)"""


def period_sql(period_type: str, cycle_day: int = 0, period_ns: int = 0, ts: str = "ts_ns") -> str:
    if period_type == "calendar":
        day = f"(DATE '1970-01-01' + CAST({ts} // {NS_PER_DAY} AS INTEGER))"
        return f"CASE WHEN {ts} <= 0 THEN 0 ELSE greatest(0, (year({day}) - 2000) * 12 + month({day}) - 1 - CASE WHEN day({day}) < {cycle_day or 1} THEN 1 ELSE 0 END) END"
    shift, length = {"day": (0, NS_PER_DAY), "week": (3 * NS_PER_DAY, NS_PER_WEEK)}.get(period_type, (0, period_ns or DEFAULT_PERIOD_NS))
    return f"CASE WHEN {ts} + {shift} <= 0 THEN 0 ELSE ({ts} + {shift}) // {length} END"


def period_at(metric: Metric | None, ts_ns: int) -> str:
    """The period of an instant, as SQL; a metric that isn't known has periods of 30 days."""
    kind = (metric.period_type, metric.billing_cycle_day, metric.period_ns) if metric else ("fixed",)
    return f"({period_sql(*kind, ts=str(ts_ns))})"


def touched(metric: Metric | None, start_ns: int, end_ns: int) -> str:
    """That period_id is one that [start, end) touches; an empty range touches the period of its start."""
    return f"period_id BETWEEN {period_at(metric, start_ns)} AND {period_at(metric, max(start_ns, end_ns - 1))}"


def metric_period_sql(metrics: list[Metric]) -> str:
    cases = " ".join(f"WHEN '{m.code}' THEN {period_sql(m.period_type, m.billing_cycle_day, m.period_ns)}" for m in metrics)
    return f"CASE metric_code {cases} END"


def spread_sql(metrics: list[Metric], source: str = "app") -> str:
    """CTEs ``placed`` (known metrics, period) and ``spread`` (a row per dimension set)."""
    kinds = " ".join(f"WHEN '{m.code}' THEN '{m.agg_type}'" for m in metrics)
    known = ", ".join(f"'{m.code}'" for m in metrics)
    return f"""
placed AS (SELECT *, CAST({metric_period_sql(metrics)} AS BIGINT) AS period_id, CASE metric_code {kinds} END AS agg_type, concat_ws(';', d1, d2, d3) AS matched FROM {source} WHERE metric_code IN ({known})),
spread AS (SELECT * EXCLUDE (sets), unnest(sets) AS dims FROM (SELECT *, list_distinct([x FOR x IN ['', d1, d2, d3, matched] IF x IS NOT NULL]) AS sets FROM placed))"""


def rollup_sql(metrics: list[Metric], source: str = "app") -> str:
    """CTE ``roll`` with one row per key, on top of ``spread_sql``."""
    return f"""{spread_sql(metrics, source)},
plain AS (
  SELECT account_id, metric_code, agg_type, period_id, dims,
    coalesce(sum(value) FILTER (WHERE agg_type = 'sum'), 0) AS sum, count(*) AS count, coalesce(max(value) FILTER (WHERE agg_type = 'max'), 0) AS max,
    coalesce(arg_max(value, {{'ts': ts_ns, 'no': -"offset"}}) FILTER (WHERE agg_type = 'latest' AND ts_ns > 0), 0) AS last_value,
    coalesce(max(ts_ns) FILTER (WHERE agg_type = 'latest' AND ts_ns > 0), 0) AS last_timestamp, max("offset") AS last_seg_offset
  FROM spread WHERE agg_type <> 'count_unique' GROUP BY ALL
),
members AS (
  SELECT account_id, metric_code, agg_type, period_id, dims, value, arg_max(operation_type, "offset") AS last_op, max("offset") AS last_offset
  FROM spread WHERE agg_type = 'count_unique' GROUP BY ALL
),
roll AS (
  SELECT * FROM plain
  UNION ALL
  SELECT account_id, metric_code, agg_type, period_id, dims, 0, count(*) FILTER (WHERE last_op <> 2), 0, 0, 0, max(last_offset) FROM members GROUP BY account_id, metric_code, agg_type, period_id, dims
)"""


MERGED = """CAST(coalesce(sum(sum), 0) AS BIGINT) AS sum, CAST(coalesce(sum(count), 0) AS BIGINT) AS count, CAST(coalesce(max(max), 0) AS BIGINT) AS max,
  CAST(coalesce(arg_max(last_value, {'ts': last_timestamp, 'p': -period_id}) FILTER (WHERE last_timestamp > 0), 0) AS BIGINT) AS last_value,
  CAST(coalesce(max(last_timestamp), 0) AS BIGINT) AS last_timestamp, CAST(coalesce(max(last_seg_offset), 0) AS BIGINT) AS last_seg_offset"""
FLAT = "account_id, metric_code, period_id, dims, CAST(sum AS BIGINT) AS sum, CAST(count AS BIGINT) AS count, CAST(max AS BIGINT) AS max, CAST(last_value AS BIGINT) AS last_value, CAST(last_timestamp AS BIGINT) AS last_timestamp, CAST(last_seg_offset AS BIGINT) AS last_seg_offset"


def alerts_sql(metrics: list[Metric], source: str = "app") -> str:
    """CTEs ``cur`` (usage by event and key) and ``fired``."""
    rows = ", ".join(f"('{m.code}', {i}, '{t.code}', {t.value}, {str(t.recurring).lower()})" for m in metrics for i, t in enumerate(m.thresholds))
    key = "account_id, metric_code, period_id, dims"
    return f"""{spread_sql(metrics, source)},
thresholds(code, threshold_index, threshold_code, threshold, recurring) AS (VALUES {rows}),
changed AS (
  SELECT *, CASE WHEN agg_type = 'count_unique' THEN CASE WHEN operation_type <> 2 THEN 1 ELSE 0 END - coalesce(lag(CASE WHEN operation_type <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, value ORDER BY "offset"), 0) ELSE 0 END AS change
  FROM spread
),
cur AS (
  SELECT {key}, "offset", ts_ns, CAST(CASE agg_type
      WHEN 'count' THEN count(*) OVER w WHEN 'sum' THEN sum(value) OVER w WHEN 'max' THEN max(value) OVER w WHEN 'count_unique' THEN sum(change) OVER w
      ELSE arg_max(value, {{'ts': ts_ns, 'no': -"offset"}}) OVER w END AS BIGINT) AS cur
  FROM changed WINDOW w AS (PARTITION BY {key} ORDER BY "offset" ROWS UNBOUNDED PRECEDING)
),
crossings AS (SELECT cur.*, t.*, cur >= threshold AS crossed FROM cur JOIN thresholds t ON metric_code = code),
fired AS (
  SELECT * FROM (SELECT *, coalesce(lag(crossed) OVER (PARTITION BY {key}, threshold_index ORDER BY "offset"), false) AS was FROM crossings)
  WHERE crossed AND (recurring OR NOT was)
)"""
