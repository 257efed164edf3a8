"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, join_by_key

#: Edges that one task folds at a time.
FOLD_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to stars of the same components, smallest node first, over at most FOLD_EDGES edges at a time."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen > FOLD_EDGES:
            yield stars()
            seen = 0
    if root:
        yield stars()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node of its component) of every node on an edge; edges are pairs of longs.

    Each round makes a large and a small star (Kiveris et al., 2014) over all edges, in which every node is joined to the smallest
    node it sees, and folds the edges of a partition into stars, until all components are stars. A round's edges are a written
    table.
    """

    def with_smallest(e: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The edges of a written table, each with the smallest neighbour m of its u; and the smallest neighbours alone. A hub's
        edges stay where they are: its smallest neighbour is broadcast to them."""
        least = scratch.save(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), n)
        return join_by_key(e, least, ["u"], "degree", n), least

    now = scratch.save(edges.toDF("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long").distinct())
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        n, unsettled = seen.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        if not unsettled:  # all components are stars
            break
        n *= 2
        both, low = with_smallest(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
        large = both.select("u", "v", F.least("u", "m").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, n)
        down, least = with_smallest(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u <> v").distinct().mapInArrow(_forest, "u long, v long").distinct(), n)
        scratch.drop(now, large, low, least)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
