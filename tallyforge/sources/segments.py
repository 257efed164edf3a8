"""Event logs in fixed 64-byte records, and their side-car of properties in fixed 104-byte ones.

Files whose length is a whole number of records are read by Spark's reader of fixed-length records, which cuts them into splits, so
a large file is many tasks and no task holds it. Only files that end in a torn record are read as one value each. Records are
decoded by column expressions alone, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, PROPS_RECORD = 64, 104
#: Where each little-endian field starts, and its bytes.
FIELDS = {"offset": (0, 8), "ts_ns": (8, 8), "account_id": (32, 8), "metric_hash": (40, 8), "value": (48, 8), "operation_type": (56, 1), "checksum": (60, 4)}
#: The same of a property; key and value are padded with NUL bytes.
PROPS_FIELDS = {"offset": (0, 8), "key": (8, 32), "value": (40, 64)}


def _number(record: Column, start: int, size: int) -> Column:
    """An unsigned little-endian integer."""
    digits = F.hex(record)
    swapped = F.concat(*(F.substring(digits, 2 * (start + i) + 1, 2) for i in reversed(range(size))))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def _signed(number: Column) -> Column:
    wrap = F.lit("18446744073709551616").cast("decimal(21,0)")
    return F.when(number > F.lit("9223372036854775807").cast("decimal(20,0)"), number - wrap).otherwise(number).cast("long")


def _bytes(number: Column, size: int) -> Column:
    """A long as so many little-endian bytes, in hex."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size)))


def _text(record: Column, start: int, size: int) -> Column:
    """UTF-8 up to the first NUL."""
    return F.substring_index(F.decode(F.substring(record, start + 1, size), "utf-8"), "\0", 1)


def _padded(text: Column, size: int) -> Column:
    """UTF-8 in hex, cut or padded to so many bytes."""
    return F.rpad(F.hex(F.encode(text, "utf-8")), 2 * size, "0")


def files_of(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path and length of a folder's files, empty ones too; their content isn't read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{glob}")
    found = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(folder)
    return spark.createDataFrame([(x.getPath().toString(), x.getLen()) for x in found or ()], "path string, length long")


def read_records(spark: SparkSession, path: str, glob: str, size: int) -> DataFrame:
    """A row for each whole record of a folder's files: record (binary) and place, which rises within a file."""
    found = files_of(spark, path, glob).where(F.col("length") >= size).collect()  # a row a file
    whole, torn = ([r["path"] for r in found if (r["length"] % size == 0) is kind] for kind in (True, False))
    out = spark.createDataFrame([], "record binary, place long")
    if whole:
        jvm = spark._jvm
        rows = spark.sparkContext._jsc.sc().binaryRecords(",".join(whole), size, spark._jsparkSession.sessionState().newHadoopConf())
        frame = DataFrame(spark._jsparkSession.createDataset(rows, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
        out = out.unionByName(frame.select(F.col("value").alias("record"), F.monotonically_increasing_id().alias("place")))
    if torn:
        content = spark.read.format("binaryFile").load(torn)
        starts = F.sequence(F.lit(0), F.expr(f"int(length(content) div {size})") - 1)
        cut = content.select(F.explode(F.transform(starts, lambda i: F.struct(F.substring(F.col("content"), i * size + 1, F.lit(size)).alias("record"), i.cast("long").alias("place")))).alias("r"))
        out = out.unionByName(cut.select("r.*"))
    return out


def decode_events(records: DataFrame) -> DataFrame:
    """Events of a column of binary records."""
    field = lambda name: _number(F.col("record"), *FIELDS[name])
    return records.select(
        field("offset").cast("long").alias("offset"),
        _signed(field("ts_ns")).alias("ts_ns"),
        field("account_id").cast("long").alias("account_id"),
        _signed(field("metric_hash")).alias("metric_hash"),
        field("value").alias("value"),
        field("operation_type").cast("int").alias("operation_type"),
        field("checksum").cast("long").alias("checksum"),
    )


def encode_events(events: DataFrame) -> DataFrame:
    """Records of events with metric_hash, and checksum where there is one; the idempotency key is left blank."""
    check = F.col("checksum") if "checksum" in events.columns else F.lit(0)
    parts = [_bytes(F.col("offset"), 8), _bytes(F.col("ts_ns"), 8), F.lit("0" * 32), _bytes(F.col("account_id"), 8), _bytes(F.col("metric_hash"), 8)]
    parts += [_bytes(F.col("value"), 8), _bytes(F.col("operation_type"), 1), F.lit("0" * 6), _bytes(check, 4)]
    return events.select(F.unhex(F.concat(*parts)).alias("record"))


def read_segments(spark: SparkSession, path: str, start_offset: int = 0, glob: str = "*.seg", end_offset: int | None = None) -> DataFrame:
    """Events at and after an offset, and before another if that is given. A file's records beyond its last whole one are
    ignored."""
    return between(decode_events(read_records(spark, path, glob, RECORD)), start_offset, end_offset)


def between(events: DataFrame, start_offset: int = 0, end_offset: int | None = None) -> DataFrame:
    """Events at and after an offset, and before another if that is given; one event is [n, n + 1)."""
    rows = events.where(F.col("offset") >= start_offset)
    return rows if end_offset is None else rows.where(F.col("offset") < end_offset)


def decode_props(records: DataFrame) -> DataFrame:
    """offset, place, key and value of a column of binary records of properties."""
    return records.select(_number(F.col("record"), *PROPS_FIELDS["offset"]).cast("long").alias("offset"), "place", *(_text(F.col("record"), *PROPS_FIELDS[c]).alias(c) for c in ("key", "value")))


def encode_props(events: DataFrame) -> DataFrame:
    """Records of the properties of events, with their place among those of an event."""
    each = events.select("offset", F.posexplode(F.map_entries("props")).alias("place", "p"))
    record = F.concat(_bytes(F.col("offset"), 8), _padded(F.col("p.key"), 32), _padded(F.col("p.value"), 64))
    return each.select(F.unhex(record).alias("record"), F.col("place").cast("long").alias("place"))


def read_props(spark: SparkSession, path: str, glob: str = "*.props") -> DataFrame:
    """Properties of a folder's side-car files; one that is torn is corrupt."""
    torn = files_of(spark, path, glob).where(F.col("length") % PROPS_RECORD != 0)
    if not torn.isEmpty():
        raise ValueError(f"corrupt properties: {torn.first()['path']}")
    return decode_props(read_records(spark, path, glob, PROPS_RECORD))


def with_props(events: DataFrame, props: DataFrame) -> DataFrame:
    """Events with their properties as a map; of a key that repeats the first counts, events without any have an empty map."""
    first = props.groupBy("offset", "key").agg(F.min_by("value", "place").alias("value"))
    maps = first.groupBy("offset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))  # an event's own
    return events.join(maps, "offset", "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))


def file_checks(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many log files there are, and how many are a whole number of records or aren't; the same of side-cars."""
    logs, props = files_of(spark, path, "*.seg"), files_of(spark, path, "*.props")
    count = lambda df, name, size: df.agg(F.count("*").alias(f"n_{name}"), F.count_if(F.col("length") % size == 0).alias(f"{name}_ok"), F.count_if(F.col("length") % size != 0).alias(f"{name}_bad"))
    left, right = count(logs, "segments", RECORD), count(props, "props", PROPS_RECORD)
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").drop("_k")


def write_events(events: DataFrame, path: str, records_per_file: int = 1_000_000) -> None:
    """Events as Parquet by metric and day, so that reads are pruned; a file is rotated at so many records."""
    day = F.date_from_unix_date(F.expr("int(ts_ns div 86400000000000)"))
    events.withColumn("event_date", day).write.option("maxRecordsPerFile", records_per_file).partitionBy("metric_code", "event_date").mode("append").parquet(path)
