"""Dimensions: which declared ones an event matches, and the sets under which it is counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.schemas import DIMS


def matched_dims(filters: Column, props: Column) -> Column:
    """The declared dimensions whose value is a declared one, as structs (k, v) in order of k."""
    fits = F.filter(filters, lambda f: F.coalesce(F.array_contains(f["values"], F.element_at(props, f["key"])), F.lit(False)))
    return F.array_sort(F.transform(fits, lambda f: F.struct(f["key"].alias("k"), F.element_at(props, f["key"]).alias("v"))))


def first_wins(pairs: Column) -> Column:
    """A map of pairs (key, value) in which the first pair of a key decides."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    first = F.transform(keys, lambda k: F.filter(pairs, lambda p: p["key"] == k)[0]["value"])
    return F.map_from_arrays(keys, first)


def dim_sets(matched: Column) -> Column:
    """The empty set, each matched dimension alone, and the full set: not the subsets between."""
    none = F.array().cast(DIMS)
    return F.array_distinct(F.concat(F.array(none), F.transform(matched, lambda d: F.array(d)), F.array(matched)))


def dims_literal(filters: dict[str, str]) -> Column:
    pairs = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sorted(filters.items())]
    return F.array(*pairs).cast(DIMS)


def dims_text(dims: Column) -> Column:
    return F.array_join(F.transform(dims, lambda d: F.concat(d["k"], F.lit("="), d["v"])), ";")
