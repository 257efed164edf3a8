"""Operators against golden values and a scalar model."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import alerts as al
from tallyforge.operators import ingest, observability, partitions, progress, registry, retention, usage
from tallyforge.operators.dims import dims_text, first_wins
from tallyforge.operators.registry import Metric, Threshold, metrics_table
from tallyforge.operators.rollup import rollup
from tallyforge.operators.running import with_running
from tallyforge.schemas import ADD, EVENTS, NONE, NS_PER_DAY, REMOVE

D = NS_PER_DAY
DIMS = {"region": ["r0", "r1"], "tier": ["t0"]}


def event(offset, ts=1, account=1, metric="m", value=1, op=NONE, **props):
    return (offset, ts, account, metric, value, op, props)


def table(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def rolled(spark, rows, *metrics):
    out = rollup(table(spark, rows), metrics_table(spark, list(metrics)))
    return {(r.account_id, r.metric_code, r.period_id, r.d): r for r in out.withColumn("d", dims_text(F.col("dims"))).collect()}


def test_count_sum_max_latest(spark):
    rows = [event(i, value=v, metric=m) for i, (m, v) in enumerate([("c", 5), ("c", 6), ("s", 1_000_000), ("s", 2_500_000), ("x", 5), ("x", 3), ("x", 9)])]
    rows += [event(10, ts=3000, metric="l", value=999), event(11, ts=1000, metric="l", value=111), event(12, ts=3000, metric="l", value=5), event(13, ts=0, metric="l", value=7)]
    got = rolled(spark, rows, Metric("c", "count"), Metric("s", "sum"), Metric("x", "max"), Metric("l", "latest"))
    at = lambda m: got[(1, m, 0, "")]
    assert at("c")["count"] == 2 and (at("s")["sum"], at("s")["count"]) == (3_500_000, 2) and (at("x")["max"], at("x")["count"]) == (9, 3)
    assert (at("l")["last_value"], at("l")["last_timestamp"], at("l")["count"], at("l")["last_seg_offset"]) == (999, 3000, 4, 13)


def test_count_unique(spark):
    rows = [event(i, value=v, op=ADD) for i, v in enumerate((100, 200, 100))]
    assert rolled(spark, rows, Metric("m", "count_unique"))[(1, "m", 0, "")]["count"] == 2
    rows += [event(3, value=100, op=REMOVE), event(4, value=999, op=REMOVE)]
    assert rolled(spark, rows, Metric("m", "count_unique"))[(1, "m", 0, "")]["count"] == 1
    rows = [event(i, value=i, op=ADD) for i in range(20)] + [event(20 + i, value=i, op=REMOVE) for i in range(10)]
    assert rolled(spark, rows, Metric("m", "count_unique"))[(1, "m", 0, "")]["count"] == 10


def test_dimension_sets(spark):
    got = rolled(spark, [event(1, value=1_000_000, region="r0", tier="t0"), event(2, value=5, region="r9")], Metric("m", "sum", filters=DIMS))
    assert {k[3]: int(r["sum"]) for k, r in got.items()} == {"": 1_000_005, "region=r0": 1_000_000, "tier=t0": 1_000_000, "region=r0;tier=t0": 1_000_000}


def test_three_dimensions_match_as_an_exact_set(spark):
    metric = Metric("m", "sum", filters={"a": ["1"], "b": ["1"], "c": ["1"]})
    events = table(spark, [event(1, value=7, a="1", b="1", c="1"), event(2, value=3, a="1", b="1")])
    metrics = metrics_table(spark, [metric])
    rows = rollup(events, metrics)
    assert usage.usage_query(rows, 1, "m", metric, 0, D, {"b": "1", "a": "1"}).first()["sum"] == 3
    assert usage.usage_query_subset(events, metrics, 1, metric, 0, D, {"a": "1", "b": "1"}).first()["sum"] == 10


def test_first_property_wins(spark):
    pairs = F.array(F.struct(F.lit("k").alias("key"), F.lit("a").alias("value")), F.struct(F.lit("k").alias("key"), F.lit("b").alias("value")))
    assert spark.range(1).select(first_wins(pairs)).first()[0] == {"k": "a"}


def test_unknown_metrics_are_not_aggregated(spark):
    assert rolled(spark, [event(1, metric="other")], Metric("m", "count")) == {}


def test_usage_of_nothing_is_zeros(spark):
    rows = rollup(table(spark, []), metrics_table(spark, [Metric("m", "count")]))
    assert tuple(usage.usage_query(rows, 1, "m", None, 0, D).first()) == (0, 0, 0, 0, 0, 0)


def test_breakdown_wants_declared_keys(spark):
    rows = rollup(table(spark, []), metrics_table(spark, [Metric("m", "count", filters=DIMS)]))
    for metric, keys in ((None, ["region"]), (Metric("m", "count", filters=DIMS), []), (Metric("m", "count", filters=DIMS), ["color"])):
        with pytest.raises(ValueError):
            usage.breakdown(rows, 1, metric, 0, D, keys)


def test_breakdown_order_is_that_of_declaration(spark):
    metric = Metric("m", "count", filters={"region": ["r1", "r0"], "tier": ["t0", "t1"]})
    events = [event(i, region=r, tier=t) for i, (r, t) in enumerate([("r0", "t1"), ("r1", "t1"), ("r1", "t0"), ("r0", "t0")])]
    rows = usage.breakdown(rollup(table(spark, events), metrics_table(spark, [metric])), 1, metric, 0, D, ["region", "tier"])
    assert [(r.dim_0, r.dim_1) for r in rows.collect()] == [("r1", "t0"), ("r1", "t1"), ("r0", "t0"), ("r0", "t1")]


def test_overlay_prefers_fresh_rows(spark):
    metrics = metrics_table(spark, [Metric("m", "count", "day")])
    stored, fresh = rollup(table(spark, [event(1, ts=3 * D)]), metrics), rollup(table(spark, [event(1, ts=3 * D), event(2, ts=3 * D), event(3, ts=4 * D)]), metrics)
    assert {r.period_id: r["count"] for r in usage.account_usage(stored, fresh, 1, 3, 4).collect()} == {3: 2, 4: 1}


def test_events_list(spark):
    rows = [event(i, ts=1000 * i, account=5 if i % 2 else 6) for i in range(1, 7)]
    listed = usage.events_list(table(spark, rows), metrics_table(spark, []), 5, 0, 5000).collect()
    assert [r.offset for r in listed] == [1, 3, 5] and {r.metric_code for r in listed} == {""}


def test_registry_limits_and_fold(spark):
    with pytest.raises(ValueError):
        Metric("m", "average")
    with pytest.raises(ValueError):
        Metric("m", "count", filters={str(i): ["x"] for i in range(5)})
    log = spark.createDataFrame([("a", 1, False, "x"), ("a", 3, False, "z"), ("b", 2, False, "y"), ("b", 4, True, "")], "metric_code string, version int, deleted boolean, what string")
    assert [(r.metric_code, r.what) for r in registry.fold(log).collect()] == [("a", "z")]


def test_ingest(spark):
    events = table(spark, [event(1, ts=5, value=2), event(2, ts=5, value=2, op=REMOVE), event(3, ts=6)])
    assert sorted(r.offset for r in ingest.dedup(events).collect()) == [1, 3]
    assert tuple(ingest.ingest_result(events, metrics_table(spark, [Metric("m", "count")])).first()) == (2, 1, 3, "ok")
    assert ingest.ingest_result(events, metrics_table(spark, [])).first()["status"] == "unknown_metric"
    numbered = ingest.assign_offsets(events.select("ts_ns", "value"), ["ts_ns", "value"], start=10, partitions=3)
    assert sorted((r.offset, r.ts_ns) for r in numbered.collect()) == [(10, 5), (11, 5), (12, 6)]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_offsets_of_many_wide_rows_have_no_gap(spark, coalesce):
    """With Spark's own number of partitions, and rows large enough that adaptive execution deals them out anew."""
    n, held = 2_000_000, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), F.repeat(F.col("id").cast("string"), 8).alias("payload"))
        out = ingest.assign_offsets(rows, ["k"], start=5)
        got = out.agg(F.count("*"), F.count_distinct("offset"), F.min("offset"), F.max("offset"), F.count_distinct("payload")).first()
        assert tuple(got) == (n, n, 5, n + 4, n)
        blocks = out.groupBy("k").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.count("*").alias("n")).orderBy("k").collect()
        assert all(b.hi - b.lo + 1 == b.n for b in blocks) and all(a.hi + 1 == b.lo for a, b in zip(blocks, blocks[1:]))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_a_rollup_reads_events_once(spark, sf_dir):
    from tallyforge.sources.tables import EVENT_METRICS, app_events

    text = rollup(app_events(spark, sf_dir), metrics_table(spark, EVENT_METRICS))._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "SortAggregate" not in text


def test_uuid7(spark):
    from tallyforge.functions.scalars import uuid7, uuid7_ms

    ms = [0, 1, 1_704_067_200_000, (1 << 48) - 1]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(ms)], "ms long, id int").select("ms", uuid7(F.col("ms"), F.col("id")).alias("u")).withColumn("back", uuid7_ms(F.col("u"))).collect()
    assert all(r.back == r.ms and uuid.UUID(r.u).version == 7 and uuid.UUID(r.u).variant == uuid.RFC_4122 for r in rows) and len({r.u[-12:] for r in rows}) == 4


def test_watermark(spark):
    minute = 60 * 1_000_000_000
    rows = [event(1, ts=1000 * minute), event(2, ts=2000 * minute), event(3, ts=500 * minute), event(4, ts=1995 * minute), event(5, ts=1995 * minute - 1)]
    got = {r.offset: (r.watermark_ns // minute, r.is_late) for r in progress.with_watermark(table(spark, rows), block=2).collect()}
    assert got == {1: (1000, False), 2: (2000, False), 3: (2000, True), 4: (2000, False), 5: (2000, True)}


def test_retention(spark):
    events = table(spark, [event(i, ts=i * D) for i in range(1, 6)])
    assert sorted(r.offset for r in retention.keep_events(events, 93 * D).collect()) == [3, 4, 5]
    metrics = metrics_table(spark, [Metric("m", "count", "day")])
    assert sorted(r.period_id for r in retention.keep_rollup(rollup(events, metrics), metrics, 93 * D).collect()) == [3, 4, 5]


def test_partition_moves(spark):
    moves = partitions.partition_moves(partitions.partition_map(spark, 2), partitions.partition_map(spark, 3))
    assert (2, 0, 2) in {tuple(r) for r in moves.collect()}
    assert partitions.partition_moves(partitions.partition_map(spark, 3), partitions.partition_map(spark, 3)).isEmpty()
    assert [r.replica_2 for r in partitions.partition_map(spark, 2).limit(2).collect()] == [None, None]


def test_histogram(spark):
    rows = spark.createDataFrame([(400_000,), (600_000,), (2**62,)], "d long")
    got = observability.latency_histogram(rows, F.col("d"))
    assert [r.n for r in got.orderBy("bucket").collect()] == [1, 1, *[0] * 9, 1]
    text = observability.histogram_exposition("wait_seconds", "Waiting", got, 10**9)
    assert 'wait_seconds_bucket{le="+Inf"} 3' in text and "wait_seconds_sum 1.000000000" in text and text.endswith("wait_seconds_count 3\n")
    assert observability.exposition("counter", "n", "N", [({"mode": "sync"}, 2), ({}, 3)]) == '# HELP n N\n# TYPE n counter\nn{mode="sync"} 2\nn 3\n'


def test_running_over_blocks_equals_running_over_all(spark):
    r = random.Random(3)
    rows = table(spark, [event(i, account=r.randrange(3), value=r.randrange(100)) for i in range(60)])
    got = with_running(rows, ["account_id"], {"total": ("sum", F.col("value")), "top": ("max", F.col("value"))}, block=7).orderBy("offset").collect()
    seen: dict = {}
    for x in got:
        before = seen.setdefault(x.account_id, [])
        assert (x.prev_total, x.prev_top) == ((sum(before), max(before)) if before else (None, None))
        before.append(x.value)
        assert (x.total, x.top) == (sum(before), max(before))


def model_alerts(rows, metrics):
    by, state, out = {m.code: m for m in metrics}, {}, []
    for offset, ts, account, code, value, op, props in sorted(rows):
        m = by[code]
        matched = sorted((k, props[k]) for k, v in m.filters.items() if props.get(k) in v)
        sets = {()} | {(d,) for d in matched} | {tuple(matched)}
        for dims in sets:
            st = state.setdefault((account, code, m.period_of(ts), dims), {"n": 0, "sum": 0, "max": 0, "ts": 0, "last": 0, "set": set(), "flags": set()})
            st["n"] += 1
            st["sum"] += value
            st["max"] = max(st["max"], value)
            if ts > st["ts"]:
                st["ts"], st["last"] = ts, value
            (st["set"].discard if op == REMOVE else st["set"].add)(value)
            cur = {"count": st["n"], "sum": st["sum"], "max": st["max"], "latest": st["last"], "count_unique": len(st["set"])}[m.agg_type]
            for i, t in enumerate(m.thresholds):
                if cur >= t.value:
                    if t.recurring or i not in st["flags"]:
                        out.append((account, code, m.period_of(ts), ";".join(f"{k}={v}" for k, v in dims), i, cur, offset))
                    st["flags"].add(i)
                else:
                    st["flags"].discard(i)
    flags = {(a, c, p, ";".join(f"{k}={v}" for k, v in d)): sum(1 << i for i in st["flags"]) for (a, c, p, d), st in state.items()}
    return sorted(out), flags, state


def random_case(seed, n=250):
    r = random.Random(seed)
    metrics = [Metric(k, k, "day", filters=DIMS, thresholds=(Threshold("a", {"count": 4, "sum": 60, "max": 25, "latest": 15, "count_unique": 3}[k]), Threshold("b", {"count": 7, "sum": 90, "max": 28, "latest": 20, "count_unique": 5}[k], True))) for k in ("count", "sum", "max", "latest", "count_unique")]
    rows = [event(i, ts=r.randrange(1, 3 * D), account=r.randrange(2), metric=r.choice(metrics).code, value=r.randrange(1, 30), op=r.choice((NONE, ADD, REMOVE)), region=r.choice(("r0", "r1", "r2")), tier=r.choice(("t0", "t1"))) for i in range(n)]
    return rows, metrics


@pytest.mark.parametrize("seed", [0, 7, 42])
def test_alerts_and_rollups_equal_a_scalar_model(spark, seed):
    rows, metrics = random_case(seed)
    events, defined = table(spark, rows), metrics_table(spark, metrics)
    expected, flags, state = model_alerts(rows, metrics)
    fired = al.alerts(events, defined, block=50)
    got = sorted((r.account_id, r.metric_code, r.period_id, r.d, r.threshold_index, int(r.value_at_cross), r.offset) for r in fired.withColumn("d", dims_text(F.col("dims"))).collect())
    assert got == expected
    held = {(r.account_id, r.metric_code, r.period_id, r.d): r.alert_flags for r in al.alert_flags(events, defined, block=50).withColumn("d", dims_text(F.col("dims"))).collect()}
    assert held == flags
    kept = rolled(spark, rows, *metrics)
    assert len(kept) == len(state)
    for (account, code, period, dims), st in state.items():
        row = kept[(account, code, period, ";".join(f"{k}={v}" for k, v in dims))]
        want = {"count": ("count", st["n"]), "sum": ("sum", st["sum"]), "max": ("max", st["max"]), "latest": ("last_value", st["last"]), "count_unique": ("count", len(st["set"]))}[code]
        assert int(row[want[0]]) == want[1]


def test_alert_log_and_listing(spark):
    rows, metrics = random_case(1, 80)
    log = al.alert_log(al.alerts(table(spark, rows), metrics_table(spark, metrics)))
    every = [r.log_index for r in usage.alerts_list(log, 0, 0, limit=10_000).collect()]
    assert every == list(range(len(every)))
    assert all(r.account_id == 1 and r.log_index >= 5 for r in usage.alerts_list(log, 1, 5).collect())
