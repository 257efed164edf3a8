"""Sharding along a Hilbert curve over document metadata, in DataFrame operations only.

Length, source and language are quantised to BITS bits each, all of them in order, so that a class is a range of values; rows are
ordered by the Hilbert index of their cell, and the order is cut into runs of equal row counts (law ``rows``: counts at most one
apart). A run is compact in all three dimensions: its least and greatest length, source and language span a small box, so a filter
on any of them leaves out most files.

Classes of a name are cut at quantiles over all rows, of a number that its first bytes make after what all names begin with
alike; names that agree in these share a class. The order of rows is one range partitioning of a written table (see
``assign_offsets``), dealt out by cell, row and at last a row number, so that neither a cell that holds a third of all rows nor
rows that repeat are a task's alone.

Defined cases: a null text counts as none (8 bytes), null source or language as an empty one, rows are ordered within a cell
by doc_id (nulls first), checksum and size, so repeated rows take neighbouring slots; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, table
from tallyforge.operators.ingest import assign_offsets

DIMS, BITS, SHARDS = 3, 5, 24
#: Bytes of a name that make a number; how exact its quantiles are.
NAME_BYTES, EXACT = 7, 10_000


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _trailing_ones(i: int) -> int:
    return (~i & (i + 1)).bit_length() - 1


_SIDE = 1 << DIMS
#: By rank within a cell: the corner where the curve enters a sub-cell, and the direction in which it crosses it.
ENTRY = [0 if w == 0 else _gray(2 * ((w - 1) // 2)) for w in range(_SIDE)]
CROSS = [0 if w == 0 else _trailing_ones(w - 1 if w % 2 == 0 else w) % DIMS for w in range(_SIDE)]
RANK_OF_CORNER = [next(w for w in range(_SIDE) if _gray(w) == corner) for corner in range(_SIDE)]


def hilbert_index(*dims: str, bits: int = BITS) -> Column:
    """The index on the curve of a point whose coordinates are DIMS int columns of so many bits.

    From the highest bit down, the coordinates' bits name a corner of the present cell; it is turned into the curve's own
    frame (entry corner e, direction d), where its place in Gray order is the next digit.
    """
    listed = lambda values: f"array({', '.join(map(str, values))})"
    mask, turn = _SIDE - 1, f"(acc.d + 1) % {DIMS}"
    corner = " | ".join(f"shiftleft(shiftright(`{c}`, i) & 1, {j})" for j, c in enumerate(dims))
    place = f"{listed(RANK_OF_CORNER)}[(shiftright(l, {turn}) | shiftleft(l, {DIMS} - {turn})) & {mask}]"
    entry = f"((shiftleft({listed(ENTRY)}[w], {turn}) | shiftright({listed(ENTRY)}[w], {DIMS} - {turn})) & {mask})"
    state = f"named_struct('e', acc.e ^ {entry}, 'd', (acc.d + {listed(CROSS)}[w] + 1) % {DIMS}, 'h', acc.h * {_SIDE} + w)"
    step = f"transform(transform(transform(array({corner}), l -> l ^ acc.e), l -> {place}), w -> {state})[0]"
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), named_struct('e', 0, 'd', 0, 'h', 0), (acc, i) -> {step}, acc -> acc.h)")


def length_class(size: Column) -> Column:
    """Two classes to each doubling, in integers; the last of 2 ** BITS holds all beyond."""
    digits = F.bin(size)
    return F.least(F.lit((1 << BITS) - 1), 2 * F.length(digits) - 8 + F.substring(digits, 2, 1).cast("int"))


def name_number(name: Column, skip: Column) -> Column:
    """The bytes of a name after the first so many, as a number in the order of the names."""
    cut = F.rpad(F.substring(F.hex(F.encode(name, "utf-8")), 2 * skip + 1, F.lit(2 * NAME_BYTES)), 2 * NAME_BYTES, "0")
    return F.conv(cut, 16, 10).cast("long")


def _alike(a: str, b: str) -> int:
    """How many bytes two names begin with alike."""
    left, right = a.encode(), b.encode()
    return next((i for i, (x, y) in enumerate(zip(left, right, strict=False)) if x != y), min(len(left), len(right)))


def name_classes(rows: DataFrame, names: list[str]) -> dict[str, Column]:
    """By column of names (without nulls), its class: how many of at most 2 ** BITS - 1 quantiles aren't above it."""
    ends = rows.agg(*(f(c).alias(f"{c}{i}") for c in names for i, f in enumerate((F.min, F.max)))).first()
    numbers = {c: name_number(F.col(c), F.lit(_alike(ends[f"{c}0"] or "", ends[f"{c}1"] or ""))) for c in names}
    cuts = [F.lit(i / (1 << BITS)) for i in range(1, 1 << BITS)]
    found = rows.agg(*(F.percentile_approx(number, F.array(*cuts), EXACT).alias(c) for c, number in numbers.items())).first()
    out = {}
    for c, number in numbers.items():
        bounds = found[c] or []  # those that repeat count as often: classes of few values spread over the whole range
        spots = F.array(*(F.lit(b).cast("long") for b in bounds)).cast("array<bigint>")
        out[c] = F.size(F.filter(spots, lambda b: b <= number)).cast("int")  # noqa: B023
    return out


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, curve, law, shard, slot, grown_shard."""
    return _sharded(docs, shards, id_col, text_col, source_col, lang_col)


def _sharded(docs: DataFrame, shards: int, id_col: str, text_col: str, source_col: str, lang_col: str, whole: bool = False) -> DataFrame:
    """The rows of hilbert_shards; with ``whole``, _row too, all columns of the document."""
    more = ["_row"] if whole else []
    carried = [F.struct(*docs.columns).alias("_row")] if whole else []
    scratch = Scratch(docs.sparkSession)
    text, blank = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(F.col(source_col).cast("string"), blank).alias("y"), F.coalesce(F.col(lang_col).cast("string"), blank).alias("z"), *carried)
    rows = scratch.save(rows.withColumn("number", F.monotonically_increasing_id()))
    n, classes = rows.count(), name_classes(rows, ["y", "z"])
    placed = rows.withColumn("x", length_class(F.col("size"))).withColumns(classes).withColumn("curve", hilbert_index("x", "y", "z")).drop("x", "y", "z")
    ranked = assign_offsets(placed, ["curve", "doc_id", "text_crc32", "size", "number"], name="rank")
    out = ranked.withColumn("shard", F.expr(f"int(rank * {shards} div {max(n, 1)})"))
    slot = F.expr(f"rank - (shard * {n}L + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *more)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet, a folder a shard, with files sorted along the curve and cut by range, so that no task holds
    a shard of any size alone and each file's statistics span a small box. Each row is written once, whatever its doc_id."""
    whole = _sharded(docs, shards, "doc_id", "text", "source", "lang", whole=True).select("_row.*", "shard", "slot")
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))
