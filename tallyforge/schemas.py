"""Table layouts, enumerations and defaults of the metering engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: Codes of operation_type. Any other code behaves as NONE.
NONE, ADD, REMOVE = 0, 1, 2
AGG_TYPES = ("count", "sum", "max", "latest", "count_unique")
PERIOD_TYPES = ("fixed", "calendar", "day", "week")
NS_PER_SECOND = 1_000_000_000
NS_PER_DAY = 86_400 * NS_PER_SECOND
NS_PER_WEEK = 7 * NS_PER_DAY
DEFAULT_PERIOD_NS = 30 * NS_PER_DAY
LATE_GRACE_NS = 5 * 60 * NS_PER_SECOND
#: Values are integers in millionths.
SCALE = 1_000_000
PARTITIONS = 256
#: Limits of a metric's definition and of listings.
MAX_FILTERS, MAX_FILTER_VALUES, MAX_THRESHOLDS, MAX_GROUP_KEYS = 4, 8, 8, 4
EVENTS_PAGE, ALERTS_PAGE, BREAKDOWN_PAGE = 1024, 256, 614

DIMS = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))
FILTERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("values", T.ArrayType(T.StringType()))]))
THRESHOLDS = T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("value", T.DecimalType(20, 0)), T.StructField("recurring", T.BooleanType())]))

EVENTS = T.StructType(
    [
        T.StructField("offset", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("metric_code", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("operation_type", T.IntegerType()),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    ]
)
METRICS = T.StructType(
    [
        T.StructField("metric_code", T.StringType()),
        T.StructField("agg_type", T.StringType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("recurring", T.BooleanType()),
        T.StructField("period_type", T.StringType()),
        T.StructField("billing_cycle_day", T.IntegerType()),
        T.StructField("period_ns", T.LongType()),
        T.StructField("filters", FILTERS),
        T.StructField("thresholds", THRESHOLDS),
    ]
)
#: What identifies an aggregate, and what it holds; partial aggregates merge.
KEY = ["account_id", "metric_code", "period_id", "dims"]
MEASURES = ["sum", "count", "max", "last_value", "last_timestamp", "last_seg_offset"]
