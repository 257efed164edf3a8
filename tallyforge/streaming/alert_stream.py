"""Streaming alerts, by the operators that make them in batch.

A micro-batch's running usage goes on from what came before it: the rollup rows and members of the batches before, of the keys and
periods that it touches. Both are stored as in ``rollup_stream``, as partials under the batch's id, and so are the alerts; a batch
that runs again overwrites its own folders and fires the same. No row passes through Python.

Batches that come out of order define another order of arrival; alerts then follow that one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallyforge.operators.alerts import alerts
from tallyforge.operators.dims import dims_text
from tallyforge.operators.rollup import merge_members, merge_partials, ordinary_rollup, unique_members
from tallyforge.schemas import KEY

OUTPUT = "account_id long, metric_code string, period_id long, dims string, threshold_index int, threshold_code string, value_at_cross decimal(20,0), event_timestamp long, offset long"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def _earlier(spark: SparkSession, now: DataFrame, path: str, batch_id: int, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What batches before this one stored, of the keys that it touches. Only the folders of its metrics are read, and of these by
    their statistics only what may hold its periods."""
    bounds = now.groupBy("metric_code").agg(F.min("period_id").alias("lo"), F.max("period_id").alias("hi")).collect()  # a row a metric
    near = reduce(lambda x, y: x | y, ((F.col("metric_code") == r["metric_code"]) & F.col("period_id").between(r["lo"], r["hi"]) for r in bounds), F.lit(False))
    stored = spark.read.schema(StructType([*now.schema.fields, StructField("batch_id", LongType())])).parquet(path).where((F.col("batch_id") < batch_id) & near)
    return merge(stored.join(now.select(*KEY).distinct(), KEY, "left_semi").select(*now.columns))


def write_alerts(events: DataFrame, metrics: DataFrame, target: str, batch_id: int) -> DataFrame:
    """One micro-batch under its id: its state, and the alerts that it fires, which are returned as written."""
    spark, metrics, events = events.sparkSession, metrics.where(F.size("thresholds") > 0), events.persist()
    try:
        parts = []
        for name, make, merge in (("usage", ordinary_rollup, merge_partials), ("members", unique_members, merge_members)):
            now, path = make(events, metrics), f"{target}/{name}"
            now.write.mode("overwrite").partitionBy("metric_code").parquet(f"{path}/batch_id={batch_id}")
            own = spark.read.schema(now.schema).parquet(f"{path}/batch_id={batch_id}")
            parts.append(_earlier(spark, own, path, batch_id, merge))
        fired = alerts(events, metrics, earlier=(parts[0], parts[1])).withColumn("dims", dims_text(F.col("dims"))).select(*_NAMES)
        fired.write.mode("overwrite").parquet(f"{target}/alerts/batch_id={batch_id}")
    finally:
        events.unpersist()
    return spark.read.schema(OUTPUT).parquet(f"{target}/alerts/batch_id={batch_id}")


def start_alerts(stream: DataFrame, metrics: DataFrame, target: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """A stream of events to alerts in ``target``; ``then`` gets each batch's alerts and its id."""

    def batch(events: DataFrame, batch_id: int) -> None:
        fired = write_alerts(events, metrics, target, batch_id)
        if then:
            then(fired, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_alerts(spark: SparkSession, target: str) -> DataFrame:
    """All alerts that fired so far."""
    return spark.read.schema(OUTPUT).parquet(f"{target}/alerts").select(*_NAMES)
