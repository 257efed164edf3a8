"""The fixed partitions of accounts, and how they spread over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import partition_of
from tallyforge.schemas import PARTITIONS


def partition_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(partition_of(F.col("account_id")).alias("partition_id")).agg(F.count("*").alias("n_events"))


def of_partition(events: DataFrame, partition: int) -> DataFrame:
    return events.where(partition_of(F.col("account_id")) == partition)


def partition_map(spark: SparkSession, nodes: int, partitions: int = PARTITIONS) -> DataFrame:
    """A balanced map: leader, and the next two nodes as replicas where there are as many."""
    p = F.col("partition_id")
    replica = lambda i: F.when(F.lit(nodes > i), ((p + i) % nodes).cast("int"))
    rows = spark.range(partitions).select(F.col("id").cast("int").alias("partition_id"))
    return rows.select(p, (p % nodes).cast("int").alias("leader"), replica(1).alias("replica_1"), replica(2).alias("replica_2"))


def partition_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partitions that change their leader."""
    to = new.select("partition_id", F.col("leader").alias("to_node"))
    return old.join(to, "partition_id").where("leader <> to_node").select("partition_id", F.col("leader").alias("from_node"), "to_node")
