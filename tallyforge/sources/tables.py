"""Usage events from the star-schema tables: three mappings with different histories, dimensions and ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import epoch_ns, scaled
from tallyforge.operators.ingest import assign_offsets
from tallyforge.operators.registry import Metric, Threshold
from tallyforge.schemas import ADD, NONE, REMOVE

#: The total order that makes up offsets of line items, which have no key of their own.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_PROPS = {"kband": ["0", "1", "2"], "parity": ["even", "odd"]}

EVENT_METRICS = [
    Metric("click", "count", "day", filters=_PROPS),
    Metric("purchase", "sum", "calendar", 1, filters=_PROPS),
    Metric("view", "max", "week", filters=_PROPS),
    Metric("signup", "count_unique", "calendar", 15, filters=_PROPS),
    Metric("error", "latest", "fixed", filters=_PROPS),
]
ALERT_METRICS = [
    Metric("click", "count", "day", filters=_PROPS, thresholds=(Threshold("two", 2), Threshold("three", 3, True))),
    Metric("purchase", "sum", "calendar", 1, filters=_PROPS, thresholds=(Threshold("much", 500_000_000), Threshold("more", 900_000_000, True))),
    Metric("view", "max", "week", filters=_PROPS, thresholds=(Threshold("high", 300_000_000),)),
    Metric("signup", "count_unique", "calendar", 15, filters=_PROPS, thresholds=(Threshold("some", 3), Threshold("many", 6, True))),
    Metric("error", "latest", "fixed", filters=_PROPS, thresholds=(Threshold("above", 200_000_000),)),
]
SHIPPED = Metric("shipped", "sum", "calendar", 1, filters={"returnflag": ["A", "R"], "linestatus": ["F", "O"], "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]})
SHIPPED_LATEST = Metric("shipped", "latest", "fixed", filters=SHIPPED.filters)
ORDERS = Metric("orders", "sum", "calendar", 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an application: counts, payments, sign-ups that come and go."""
    k = F.get_json_object("props", "$.k").cast("long")
    signup = F.col("event_type") == "signup"
    props = F.create_map(F.lit("kband"), F.expr("cast(k div 25 as string)"), F.lit("parity"), F.when(F.col("k") % 2 == 0, "even").otherwise("odd"))
    return (
        read(spark, sf_dir, "events")
        .select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
        .select(
            F.col("event_id").alias("offset"),
            epoch_ns(F.col("ts")).alias("ts_ns"),
            F.col("user_id").alias("account_id"),
            F.col("event_type").alias("metric_code"),
            F.when(signup, F.col("k")).otherwise(scaled(F.col("value"))).alias("value"),
            F.when(signup & (F.col("event_id") % 5 == 0), REMOVE).when(signup, ADD).otherwise(NONE).alias("operation_type"),
            props.alias("props"),
        )
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shipped for a customer: three dimensions, many equal times, no key."""
    lines = assign_offsets(read(spark, sf_dir, "lineitem"), LINE_ORDER, start=1)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    props = F.create_map(F.lit("returnflag"), "l_returnflag", F.lit("linestatus"), "l_linestatus", F.lit("segment"), "c_mktsegment")
    return joined.select(
        "offset",
        epoch_ns(F.col("l_shipdate")).alias("ts_ns"),
        F.col("o_custkey").alias("account_id"),
        F.lit("shipped").alias("metric_code"),
        scaled(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
        F.lit(NONE).alias("operation_type"),
        props.alias("props"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer: a long history without dimensions."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("offset"),
        epoch_ns(F.col("o_orderdate")).alias("ts_ns"),
        F.col("o_custkey").alias("account_id"),
        F.lit("orders").alias("metric_code"),
        scaled(F.col("o_totalprice")).alias("value"),
        F.lit(NONE).alias("operation_type"),
        F.create_map().cast("map<string,string>").alias("props"),
    )


def replayed(events: DataFrame, every: int = 10, shift: int = 1_000_000_000) -> DataFrame:
    """Events, and each so-manieth of them once more at a later offset."""
    return events.unionByName(events.where(F.col("offset") % every == 0).withColumn("offset", F.col("offset") + shift))
