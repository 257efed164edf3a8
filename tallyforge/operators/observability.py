"""Latency histograms and the text form in which monitoring systems read counters, gauges and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in nanoseconds; a last one holds all beyond.
BUCKETS_NS = (500_000, 1_000_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000, 100_000_000, 250_000_000, 500_000_000, 1_000_000_000, 2_500_000_000)


def bucket_of(duration_ns: Column) -> Column:
    """The first bucket whose bound isn't below the duration."""
    out = F.lit(len(BUCKETS_NS))
    for i, bound in reversed(list(enumerate(BUCKETS_NS))):
        out = F.when(duration_ns <= bound, i).otherwise(out)
    return out


def latency_histogram(rows: DataFrame, duration_ns: Column) -> DataFrame:
    """All buckets, with their own and the cumulative count: bucket, le_ns (null for the last), n, cumulative."""
    spark = rows.sparkSession
    bounds = F.array(*(F.lit(b).cast("long") for b in BUCKETS_NS))
    frame = spark.range(len(BUCKETS_NS) + 1).select(F.col("id").cast("int").alias("bucket"), F.get(bounds, F.col("id").cast("int")).alias("le_ns"))
    counted = rows.groupBy(bucket_of(duration_ns).alias("bucket")).agg(F.count("*").alias("n"))
    full = frame.join(counted, "bucket", "left").select("bucket", "le_ns", F.coalesce("n", F.lit(0)).alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("cumulative", F.sum("n").over(upto))


def exposition(kind: str, name: str, help_text: str, samples: list[tuple[dict[str, str], float]]) -> str:
    """A counter's or gauge's lines."""
    lines = [f"# HELP {name} {help_text}", f"# TYPE {name} {kind}"]
    for labels, value in samples:
        inner = ",".join(f'{k}="{v}"' for k, v in labels.items())
        lines.append(f"{name}{{{inner}}} {value}" if inner else f"{name} {value}")
    return "\n".join(lines) + "\n"


def histogram_text(name: str, help_text: str, counts: list[int], total_ns: int) -> str:
    """A histogram's lines, in seconds, from the count of each bucket."""
    lines, upto = [f"# HELP {name} {help_text}", f"# TYPE {name} histogram"], 0
    for bound, n in zip([*BUCKETS_NS, None], counts, strict=True):
        upto += n
        le = "+Inf" if bound is None else f"{bound / 1e9:g}"
        lines.append(f'{name}_bucket{{le="{le}"}} {upto}')
    return "\n".join([*lines, f"{name}_sum {total_ns / 1e9:.9f}", f"{name}_count {upto}"]) + "\n"


def histogram_exposition(name: str, help_text: str, histogram: DataFrame, total_ns: int) -> str:
    """The lines of a histogram that ``latency_histogram`` made."""
    return histogram_text(name, help_text, [r["n"] for r in histogram.orderBy("bucket").collect()], total_ns)  # one row a bucket


def engine_status(events: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row: stored events, last offset, accounts, and live aggregate keys."""
    left = events.agg(F.count("*").alias("n_events"), F.coalesce(F.max("offset"), F.lit(0)).alias("last_offset"), F.count_distinct("account_id").alias("n_accounts"))
    right = rollup.agg(F.count("*").alias("n_keys"), F.count_distinct("metric_code").alias("n_metrics"))
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").drop("_k")
