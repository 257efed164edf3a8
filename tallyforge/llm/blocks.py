"""Links inside clusters of any size, without a task that holds a large cluster and without emitting its pairs.

A cluster of at most ``block`` nodes is compared in one go. A larger one is compared in two rounds. First each block is compared in
itself and with some leaders that stand in all blocks, which joins most of what belongs together. Then what is still outside the
cluster's largest group is compared with everything; pairs inside the largest group are known to belong together. What is emitted
are forests, whose connected components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, join_by_key
from tallyforge.llm.components import connected_components

#: From nodes and what they hold to links among them.
Links = Callable[[list[int], list[np.ndarray]], list[tuple[int, int]]]


def _compare(find: Links):
    """Links inside each run of rows that agree in root, i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            found = find(nodes, sets)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for *group, node, held in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                if group != now:
                    if len(nodes) > 1:
                        yield done()
                    now, nodes, sets = group, [], []
                nodes.append(node)
                sets.append(held.values.to_numpy(zero_copy_only=False).view("u8"))
        if len(nodes) > 1:
            yield done()

    return run


def _compared(groups: DataFrame, find: Links) -> DataFrame:
    """Links (a, b) of groups: root, i, j, node, held."""
    rows = groups.select("root", "i", "j", "node", "held")
    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_compare(find), "a long, b long")


def _block(n: str, size: int) -> Column:
    """A node's block, of as few as hold so many nodes each."""
    return F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / size)).cast("int")


def linked(rows: DataFrame, n: int, scratch: Scratch, find: Links, block: int, leaders: int) -> DataFrame:
    """Components (node, root) of all links that ``find`` sees inside clusters; rows is a written table of n rows: node, root (its
    cluster; a node may be in several), held (array of longs)."""
    sized = scratch.save(rows.groupBy("root").agg(F.count("*").alias("n_nodes")).where("n_nodes > 1"), n)
    inner = join_by_key(rows, sized, ["root"], "n_nodes", n).where("n_nodes is not null")
    parts = F.ceil(F.col("n_nodes") / block).cast("int")
    leads = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n_nodes") / leaders)) == 0
    stands = F.when((parts > 1) & leads, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(_block("n_nodes", block)))
    first = scratch.save(_compared(inner.withColumn("i", F.explode(stands)).withColumn("j", F.lit(0)), find), n)
    joined = scratch.save(connected_components(first, scratch), n)
    large = scratch.save(sized.where(F.col("n_nodes") > block), n)
    if large.isEmpty():
        return joined
    groups = joined.select("node", F.col("root").alias("group"))
    known = rows.select("node", "root").join(F.broadcast(large), "root").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))  # at most n / block clusters
    known = scratch.save(known, n)
    per = scratch.save(known.groupBy("root", "group").agg(F.count("*").alias("n_group")), n)
    most = per.groupBy("root").agg(F.max(F.struct("n_group", "group")).alias("most"), F.sum("n_group").alias("n_nodes"))
    most = most.select("root", F.col("most.group").alias("largest"), F.col("most.n_group").alias("n_in"), (F.col("n_nodes") - F.col("most.n_group")).alias("n_out")).where("n_out > 0")
    most = scratch.save(most, n)
    if most.isEmpty():
        return joined
    left = known.drop("n_nodes").join(F.broadcast(most), "root")
    outside = F.ceil(F.col("n_out") / block).cast("int")
    left = left.withColumn("x", F.when(F.col("group") == F.col("largest"), outside + _block("n_in", block)).otherwise(_block("n_out", block)))
    others = F.when(F.col("x") >= outside, F.sequence(F.lit(0), outside - 1)).otherwise(F.sequence(F.lit(0), outside + F.ceil(F.col("n_in") / block).cast("int") - 1))
    pairs = left.select("node", "root", F.col("x"), F.explode(others).alias("y")).select("node", "root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    again = _compared(pairs.join(rows, ["node", "root"]), find)
    return scratch.save(connected_components(joined.toDF("a", "b").unionByName(again), scratch), n)
