"""Running aggregates whose keys may be hot, or that have no key at all.

Rows are cut into blocks by offset. A block's total is a partial aggregate; totals of earlier blocks are summed up by key over
blocks alone, and within a block a window over key and block adds the rest. So no task holds more of a key than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20
_AGG = {"sum": F.sum, "max": F.max}


def _combined(kind: str, a: Column, b: Column) -> Column:
    if kind == "max":
        return F.when(a.isNull(), b).when(b.isNull(), a).when(a >= b, a).otherwise(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def with_running(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, Column]], order: str = "offset", block: int = BLOCK, initial: DataFrame | None = None) -> DataFrame:
    """Adds, for each measure (kind sum or max, and a column), ``name`` over the rows of the same keys up to and with this one
    in order, and ``prev_name`` over those before it (null for the first).

    ``initial`` has, by key, what the measures are before the first row (columns keys and measures); orders aren't negative then.
    Keys and block go into one struct, whose equality takes nulls as equal, so that the join with the totals and the window
    after it ask for the same partitioning and rows are shuffled once."""
    number = F.call_function("div", F.col(order), F.lit(block).cast("long"))
    rows = df.withColumn("_by", F.struct(*keys, number.alias("_block")))
    for name, (_, col) in measures.items():
        rows = rows.withColumn(f"_{name}", col)
    totals = rows.groupBy("_by").agg(*(_AGG[kind](f"_{name}").alias(f"_t_{name}") for name, (kind, _) in measures.items()))
    if initial is not None:
        before_all = initial.select(F.struct(*keys, F.lit(-1).cast("long").alias("_block")).alias("_by"), *(F.col(name).cast(totals.schema[f"_t_{name}"].dataType).alias(f"_t_{name}") for name in measures))
        totals = totals.unionByName(before_all)
    same = F.struct(*(F.col(f"_by.{k}") for k in keys)) if keys else F.lit(0)
    before = Window.partitionBy(same).orderBy("_by._block").rowsBetween(Window.unboundedPreceding, -1)
    prior = totals.select("_by", *(_AGG[kind](f"_t_{name}").over(before).alias(f"_p_{name}") for name, (kind, _) in measures.items()))
    rows = rows.join(prior, "_by")
    inside = Window.partitionBy("_by").orderBy(order)
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in measures.items():
        prior_, own = F.col(f"_p_{name}"), f"_{name}"
        rows = rows.withColumn(name, _combined(kind, prior_, _AGG[kind](own).over(upto)))
        rows = rows.withColumn(f"prev_{name}", _combined(kind, prior_, _AGG[kind](own).over(earlier)))
    return rows.drop("_by", *(f"_{n}" for n in measures), *(f"_p_{n}" for n in measures))
