"""Readers, the fixed-record log, and streams that must equal the batch."""

import re
import struct
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.alerts import alerts
from tallyforge.operators.dims import dims_text
from tallyforge.operators.registry import metrics_table
from tallyforge.operators.rollup import rollup
from tallyforge.schemas import EVENTS, NS_PER_DAY
from tallyforge.sources import json_events, segments
from tallyforge.sources.synthetic import synthetic_events
from tallyforge.streaming import alert_stream, ingest_stream, monitoring, rollup_stream, windows
from tests.test_operators import event, random_case, table


def test_json_batches(spark):
    good = '[{"account_id":1,"metric_code":"a","value":5,"delivery_mode":"sync","more":{"x":[1,2]}},{"account_id":2,"metric_code":"b","value":7}]'
    raw = spark.createDataFrame([(1, good), (2, "[]"), (3, "nonsense")], "id int, body string")
    rows = json_events.parse_batches(raw).orderBy("id", "idx").collect()
    assert [(r.id, r.is_sync, r.idx, r.account_id, r.metric_code, r.value) for r in rows] == [(1, True, 0, 1, "a", 5), (1, True, 1, 2, "b", 7)]
    assert [r.id for r in json_events.broken_batches(raw).collect()] == [3]
    with pytest.raises(Exception, match="(?i)malformed"):
        json_events.parse_batches(raw, strict=True).collect()


def test_json_numbers_are_whole_and_not_negative(spark):
    one = lambda value: f'[{{"account_id":1,"metric_code":"a","value":{value}}},{{"account_id":2}}]'
    bodies = [one("5"), one("-5"), one("1.5"), one("9223372036854775807"), one("9223372036854775808"), one("18446744073709551616"), '[{"account_id":-1}]', "[{}]", None]
    raw = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    rows = json_events.parse_batches(raw).orderBy("id", "idx").collect()
    assert [(r.id, r.account_id, r.metric_code, r.value) for r in rows] == [(0, 1, "a", 5), (0, 2, "", 0), (3, 1, "a", 2**63 - 1), (3, 2, "", 0), (7, 0, "", 0)]
    assert sorted(r.id for r in json_events.broken_batches(raw).collect()) == [1, 2, 4, 5, 6, 8]
    with pytest.raises(Exception, match="(?i)malformed"):
        json_events.parse_batches(raw.where("id = 1"), strict=True).collect()


def test_segments(spark, tmp_path):
    pack = lambda *x: struct.pack("<QqQQQQQB3xI", *x)
    (tmp_path / "a.seg").write_bytes(pack(1, -5, 1, 2, 3, 2**64 - 1, 9, 1, 77) + pack(2, 1_704_067_200 * 10**9, 0, 0, 42, 6, 2**63 + 5, 2, 2**32 - 1) + b"torn")
    (tmp_path / "b.seg").write_bytes(b"")
    rows = segments.read_segments(spark, str(tmp_path)).orderBy("offset").collect()
    assert [tuple(r) for r in rows] == [(1, -5, 3, -1, 9, 1, 77), (2, 1_704_067_200 * 10**9, 42, 6, 2**63 + 5, 2, 2**32 - 1)]
    assert segments.read_segments(spark, str(tmp_path), start_offset=2).count() == 1
    assert [r.offset for r in segments.read_segments(spark, str(tmp_path), 1, end_offset=2).collect()] == [1]
    (tmp_path / "c.seg").write_bytes(b"".join(pack(i, i, 0, 0, 42, 6, i, 0, 0) for i in range(3, 2000)))
    (tmp_path / "c.props").write_bytes(b"p" * 208)
    assert sorted(r.offset for r in segments.read_segments(spark, str(tmp_path)).collect()) == list(range(1, 2000))
    assert tuple(segments.file_checks(spark, str(tmp_path)).first()) == (3, 2, 1, 1, 1, 0)


def test_properties_come_from_their_side_car(spark, tmp_path):
    pack = lambda offset, key, value: struct.pack("<Q32s64s", offset, key.encode(), value.encode())
    (tmp_path / "a.props").write_bytes(pack(7, "tier", "pro") + pack(8, "region", "eu") + pack(7, "region", "us") + pack(7, "tier", "basic"))
    (tmp_path / "b.props").write_bytes(pack(9, "größe", "ß" * 32))
    props = segments.read_props(spark, str(tmp_path))
    events = table(spark, [event(i) for i in (6, 7, 8, 9)]).drop("props")
    assert {r.offset: r.props for r in segments.with_props(events, props).collect()} == {6: {}, 7: {"tier": "pro", "region": "us"}, 8: {"region": "eu"}, 9: {"größe": "ß" * 32}}
    (tmp_path / "c.props").write_bytes(b"torn")
    with pytest.raises(ValueError, match="corrupt"):
        segments.read_props(spark, str(tmp_path))


def test_events_are_written_by_metric_and_day(spark, tmp_path):
    segments.write_events(table(spark, [event(i, ts=i * NS_PER_DAY) for i in range(1, 4)]), str(tmp_path / "e"), records_per_file=1)
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.where("event_date = date'1970-01-03'").count() == 1 and set(EVENTS.names) <= set(back.columns)


def test_synthetic_events_repeat(spark):
    a, b = synthetic_events(spark, 2000, partitions=3), synthetic_events(spark, 2000, partitions=5)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    top = a.groupBy("account_id").count().orderBy(F.desc("count")).first()
    assert top.account_id == 1 and top["count"] > 100 and a.where("account_id between 1 and 1000").count() == 2000


def flat(df):
    return sorted(map(repr, df.withColumn("dims", dims_text(F.col("dims"))).select("account_id", "metric_code", "period_id", "dims", F.col("sum").cast("long"), "count", "max", "last_value", "last_timestamp", "last_seg_offset").collect()))


def test_stream_rollup_equals_batch_in_any_order(spark, tmp_path):
    rows, metrics = random_case(5)
    defined = metrics_table(spark, metrics)
    for part in (2, 0, 1):
        spark.createDataFrame([r for r in rows if r[0] % 3 == part], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rollup_stream.read_events_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = rollup_stream.start_rollup(stream, defined, str(tmp_path / "out"), str(tmp_path / "check"), deduplicate=False)
    query.awaitTermination()
    expected = flat(rollup(table(spark, rows), defined))
    assert flat(rollup_stream.read_rollup(spark, str(tmp_path / "out"))) == expected
    rollup_stream.compact(spark, str(tmp_path / "out"), str(tmp_path / "compact"))
    assert flat(rollup_stream.read_rollup(spark, str(tmp_path / "compact"))) == expected


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    rows, metrics = random_case(6, 60)
    defined, events = metrics_table(spark, metrics), table(spark, rows)
    for batch in (0, 1, 1):
        rollup_stream.write_batch(events, defined, str(tmp_path / "out"), batch)
    from tallyforge.operators.ingest import dedup

    assert flat(rollup_stream.read_rollup(spark, str(tmp_path / "out"))) == flat(rollup(dedup(events), defined))


def test_replays_after_compaction_count_once_and_caches_are_released(spark, tmp_path):
    rows, metrics = random_case(6, 60)
    defined, (old, new) = metrics_table(spark, metrics), (str(tmp_path / "old"), str(tmp_path / "new"))
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = cached()
    for batch, part in enumerate((rows[:30], rows[30:], rows[:10])):
        rollup_stream.write_batch(table(spark, part), defined, old, batch)
    assert cached() == before
    rollup_stream.compact(spark, old, new)
    rollup_stream.write_batch(table(spark, rows[20:50]), defined, new, 3)
    from tallyforge.operators.ingest import dedup

    assert flat(rollup_stream.read_rollup(spark, new)) == flat(rollup(dedup(table(spark, rows)), defined))


def test_keys_are_read_and_pruned_by_day(spark, tmp_path):
    metrics, target = metrics_table(spark, []), str(tmp_path / "out")
    for day in range(4):
        rollup_stream.write_batch(table(spark, [event(day, ts=day * NS_PER_DAY + 5)]), metrics, target, day)
    seen = lambda ts: rollup_stream.seen_keys(table(spark, [event(9, ts=ts)]), target, 9)
    assert [r.ts_ns for r in seen(2 * NS_PER_DAY).collect()] == [2 * NS_PER_DAY + 5] and seen(9 * NS_PER_DAY).isEmpty()
    assert re.search(r"PartitionFilters: \[[^\]]*day#", seen(2 * NS_PER_DAY)._jdf.queryExecution().toString())
    assert rollup_stream.prune_keys(spark, target, 2 * NS_PER_DAY) == 2
    assert spark.read.parquet(f"{target}/keys").count() == 2 and seen(1).isEmpty()


def test_stream_alerts_equal_batch(spark, tmp_path):
    rows, metrics = random_case(8, 150)
    defined = metrics_table(spark, metrics)
    for start in (0, 50, 100):
        spark.createDataFrame([r for r in rows if start <= r[0] < start + 50], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = rollup_stream.read_events_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    alert_stream.start_alerts(stream, defined, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = alert_stream.read_alerts(spark, str(tmp_path / "out"))
    batch = alerts(table(spark, rows), defined).withColumn("dims", dims_text(F.col("dims"))).select(*got.columns)
    expected = sorted(map(repr, batch.collect()))
    assert sorted(map(repr, got.collect())) == expected
    alert_stream.write_alerts(table(spark, rows[100:]), defined, str(tmp_path / "out"), 2)  # the last batch once more
    assert sorted(map(repr, alert_stream.read_alerts(spark, str(tmp_path / "out")).collect())) == expected


def test_windows_are_periods(spark):
    rows = table(spark, [event(i, ts=1_704_067_200 * 10**9 + i * NS_PER_DAY) for i in range(10)])
    weeks = windows.windowed_counts(rows, "week").orderBy("window").collect()
    assert [r["count"] for r in weeks] == [7, 3] and weeks[0].window.start.weekday() == 0


def test_json_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"account_id":1,"metric_code":"a","value":5},{"account_id":2,"metric_code":"b","delivery_mode":"sync"}]\n')
    stream = ingest_stream.read_json_stream(spark, str(tmp_path / "in"))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.account_id, r.value, r.is_sync) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5, True), (2, 0, True)]


def test_dedup_stream_keeps_late_events_or_drops_them(spark, tmp_path):
    hour = 3_600 * 10**9
    base = 1_704_067_200 * 10**9
    for i, ts in enumerate((base + 10 * hour, base + 20 * hour, base + 10 * hour, base)):
        spark.createDataFrame([event(i, ts=ts)], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    found = {}
    for late in ("keep", "drop"):
        stream = ingest_stream.dedup_stream(rollup_stream.read_events_stream(spark, str(tmp_path / "in"), 1), late)
        stream.writeStream.format("parquet").option("path", str(tmp_path / late)).option("checkpointLocation", str(tmp_path / f"c{late}")).trigger(availableNow=True).start().awaitTermination()
        found[late] = {r.ts_ns for r in spark.read.parquet(str(tmp_path / late)).collect()}
    assert found["keep"] == {base, base + 10 * hour, base + 20 * hour} and base not in found["drop"]
    with pytest.raises(ValueError):
        ingest_stream.dedup_stream(spark.createDataFrame([], EVENTS), "other")


def test_alerts_are_pushed_and_streams_counted(spark, tmp_path):
    rows, metrics = random_case(9, 60)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    counters, got = monitoring.StreamCounters(), []
    spark.streams.addListener(counters)
    try:
        stream = rollup_stream.read_events_stream(spark, str(tmp_path / "in"))
        deliver = lambda batch, page: got.extend(page)
        monitoring.push_alerts(stream, metrics_table(spark, metrics), deliver, str(tmp_path / "out"), str(tmp_path / "c"), 3, counters).awaitTermination()
        for _ in range(100):
            if counters.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert len(got) == alerts(table(spark, rows), metrics_table(spark, metrics)).count() > 0
    assert "stream_rows_total 60" in counters.render() and counters.health()["status"] == "ok"
    counters.add("events_ingested_total", 5, mode="sync")
    text = counters.render(rollup(table(spark, rows), metrics_table(spark, metrics)), subscribers=1)
    assert 'events_ingested_total{mode="sync"} 5' in text and f"alerts_pushed_total {len(got)}" in text and "events_duplicate_total 0" in text
    assert "batch_duration_seconds_count 1" in text and "log_commit_duration_seconds_bucket" in text and "alert_subscribers 1" in text and "agg_keys 0" not in text
    with pytest.raises(ValueError):
        counters.add("other")
