"""Words and rolling word shingles as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.llm.common import ascii_lower

#: Runs of digits, letters and anything beyond ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(column: str, k: int) -> Column:
    """Hashes of each k neighbouring words of an array column, in order, repeats included. The column must be materialised
    by a select of its own, so that the words are cut once and not once a gram."""
    each = ", ".join(f"`{column}`[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size(`{column}`) >= {k} THEN transform(sequence(0, size(`{column}`) - {k}), i -> xxhash64({each})) ELSE array() END").cast("array<bigint>")
