"""Metric definitions: what each metric counts, by which periods, under which dimensions, with which thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.functions.periods import period_of, period_range
from tallyforge.schemas import AGG_TYPES, MAX_FILTER_VALUES, MAX_FILTERS, MAX_THRESHOLDS, METRICS, PERIOD_TYPES


@dataclass(frozen=True)
class Threshold:
    code: str
    value: int
    recurring: bool = False


@dataclass(frozen=True)
class Metric:
    """A metric. ``filters`` declares dimensions: keys, and the values that count."""

    code: str
    agg_type: str
    period_type: str = "fixed"
    billing_cycle_day: int = 0
    period_ns: int = 0
    filters: dict[str, list[str]] = field(default_factory=dict)
    thresholds: tuple[Threshold, ...] = ()
    field_name: str = ""
    recurring: bool = False

    def __post_init__(self):
        if self.agg_type not in AGG_TYPES or self.period_type not in PERIOD_TYPES:
            raise ValueError(f"{self.code}: unknown kind {self.agg_type} or {self.period_type}")
        if len(self.filters) > MAX_FILTERS or any(len(v) > MAX_FILTER_VALUES for v in self.filters.values()) or len(self.thresholds) > MAX_THRESHOLDS:
            raise ValueError(f"{self.code}: too many filters, values or thresholds")

    def period_of(self, ts_ns: int) -> int:
        return period_of(ts_ns, self.period_type, self.billing_cycle_day, self.period_ns)

    def period_range(self, start_ns: int, end_ns: int) -> tuple[int, int]:
        return period_range(start_ns, end_ns, self.period_type, self.billing_cycle_day, self.period_ns)


def metrics_table(spark: SparkSession, metrics: list[Metric]) -> DataFrame:
    """The definitions as a local relation, whose size the optimizer knows: a join with it broadcasts it, not the events."""
    rows = [
        {
            "metric_code": m.code,
            "agg_type": m.agg_type,
            "field_name": m.field_name,
            "recurring": m.recurring,
            "period_type": m.period_type,
            "billing_cycle_day": m.billing_cycle_day,
            "period_ns": m.period_ns,
            "filters": [{"key": k, "values": v} for k, v in m.filters.items()],
            "thresholds": [{"code": t.code, "value": Decimal(t.value), "recurring": t.recurring} for t in m.thresholds],
        }
        for m in metrics
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(METRICS)), METRICS)


def fold(changes: DataFrame, key: str = "metric_code", order: str = "version", deleted: str = "deleted") -> DataFrame:
    """The present state of a log of puts and deletes: each key's last entry, unless that deletes it."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return changes.withColumn("_nth", F.row_number().over(last)).where((F.col("_nth") == 1) & ~F.col(deleted)).drop("_nth")


def metric_list(metrics: DataFrame) -> DataFrame:
    """All definitions, flat, with dimensions and thresholds as text."""
    filters = F.array_join(F.transform("filters", lambda f: F.concat(f["key"], F.lit("="), F.array_join(f["values"], "|"))), ";")
    thresholds = F.array_join(F.transform("thresholds", lambda t: F.concat_ws(":", t["code"], t["value"].cast("string"), t["recurring"].cast("string"))), ";")
    return metrics.select("metric_code", "agg_type", "field_name", "recurring", "period_type", "billing_cycle_day", "period_ns", filters.alias("filters"), thresholds.alias("thresholds"))
