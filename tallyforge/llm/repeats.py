"""Repeated passages by a depth-limited radix sort of suffixes.

A repeated window is a string of DEPTH bytes that starts at two places. Suffixes are ordered only through DEPTH bytes, most
significant digit first, and a suffix leaves as soon as its group is alone; what is equal after the last pass are exactly the
repeated windows. Digits are not read from the left but from the window's anchor, the KEY bytes in it whose hash is least
(leftmost among equals), which depends on the window's content alone, so equal windows have equal digits:

* Pass 1, digit: the KEY bytes at the anchor. Neighbouring windows that share an anchor are one entry (about 60 windows).
* Pass 2, digit: of each CELL offsets to the anchor, the bytes that all windows there have in common.
* Pass 3, digit: the whole window.

An entry whose digit is alone is dropped. One whose hull (all bytes that its windows touch) occurs twice is done at once, as all
its windows are repeated; one entry stands for it in the next pass, for others that share a part of it. Only this and the rest is spread out further. Groups are told by their digit's hash together with
the hull's or the window's, 128 bits in all; groups are counted by partial aggregation and never gathered in a task.

Defined cases: texts are UTF-8 bytes, a null one is empty; texts of fewer than DEPTH bytes keep all; rows with equal text are
repeats of each other, also with the same or a null doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, join_by_key, release_shuffles, table, text_batches

DEPTH, KEY, CELL = 200, 64, 8
#: Windows that are looked at together, so that memory doesn't follow a text's length.
CHUNK = 1 << 20
#: Up to so many keys of texts, at 12 bytes, are broadcast.
BROADCAST_ROWS = 500_000
#: How far a window's anchor may be from its start.
REACH = DEPTH - KEY
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_DOC = "doc long, print long"


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _MIX + ((right << np.uint64(17)) | (right >> np.uint64(47)))
    return out ^ (out >> np.uint64(31))


def key_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the KEY bytes (a power of two) at each place."""
    out = data.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(12345)
    out = (out ^ (out >> np.uint64(29))) * _MIX
    n = 1
    while n < KEY:
        out, n = _joined(out[:-n], out[n:]), 2 * n
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each run of so many."""
    n = len(keys)
    blocks = np.concatenate([keys, np.full(-n % width, np.iinfo("u8").max, "u8")]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def entries(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a text by anchor: the anchor's digit, the first window, how many windows, from the first to the anchor."""
    digits, firsts, counts, reach = [], [], [], []
    for start in range(0, len(text) - DEPTH + 1, CHUNK):
        data = np.frombuffer(text, "u1", min(CHUNK + DEPTH - 1, len(text) - start), start)
        hashes = key_hashes(data)
        keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype="u8")
        anchors = (_least(keys, REACH + 1) & np.uint64(0xFFFFFFFF)).astype("i8")
        at = np.flatnonzero(np.diff(anchors, prepend=-1))
        digits.append(hashes[anchors[at]].view("i8"))
        firsts.append(at + start)
        counts.append(np.diff(at, append=len(anchors)))
        reach.append(anchors[at] - at)
    if not digits:
        return (np.empty(0, "i8"),) * 4
    return tuple(np.concatenate(x) for x in (digits, firsts, counts, reach))


def _packed(first: np.ndarray, count: np.ndarray, reach: np.ndarray) -> np.ndarray:
    return (first << 16) | (count << 8) | reach


def _unpacked(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spot >> 16, (spot >> 8) & 255, spot & 255


def _hash(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def _folded(digit: np.ndarray, hull: np.ndarray) -> np.ndarray:
    """For the first of entries that agree in digit and hull, how many there are; for the others 0."""
    order = np.lexsort((hull, digit))
    new = np.ones(len(order), bool)
    new[1:] = (digit[order][1:] != digit[order][:-1]) | (hull[order][1:] != hull[order][:-1])
    at = np.flatnonzero(new)
    out = np.zeros(len(order), "i4")
    out[order[at]] = np.diff(at, append=len(order))
    return out


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for doc, print_, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()), strict=True):
            text = text.as_py()
            digit, first, count, reach = entries(text)
            hull = np.array([_hash(text[a : a + n + DEPTH - 1], r) for a, n, r in zip(first.tolist(), count.tolist(), reach.tolist(), strict=True)], "u8").view("i8")
            for held, x in zip(out, (digit, hull, np.full(len(digit), doc, "i8"), np.full(len(digit), print_, "i8"), _packed(first, count, reach)), strict=True):
                held.append(x)
        if out[0]:
            columns = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, _folded(*columns[:2]))], ["digit", "hull", "doc", "print", "spot", "n"])


def _cells(first: int, count: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """Some windows with one anchor, by cell: the cell, its first window here and its last."""
    anchor, last = first + reach, first + count - 1
    while first <= last:
        cell = (anchor - first) // CELL
        end = min(last, anchor - cell * CELL)
        yield cell, first, end
        first = end + 1


def _common(text: bytes, anchor: int, cell: int) -> int:
    """The digit of a cell: the bytes that all its windows have in common, whether they're here or not."""
    start = anchor - cell * CELL
    return _signed(_hash(text[start : start - CELL + 1 + DEPTH], cell))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, int, bytes, int, int, int]]]:
    """By batch: doc, print, text, first, count and reach of each spot."""
    for batch in batches:
        yield (
            (doc, print_, text, *spot)
            for doc, print_, text, spots in zip(*(batch.column(i).to_pylist() for i in range(2)), (x.as_py() for x in batch.column(2).cast(pa.binary())), batch.column(3), strict=True)
            for spot in zip(*(x.tolist() for x in _unpacked(np.array(spots.as_py(), "i8"))), strict=True)
        )


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 5
    for spots in _spots(batches):
        rows = []
        for doc, print_, text, first, count, reach in spots:
            anchor = first + reach
            for cell, a, b in _cells(first, count, reach):
                hull = _signed(_hash(text[a : b + DEPTH], anchor - a))
                rows.append((_common(text, anchor, cell), hull, doc, print_, (a << 16) | ((b - a + 1) << 8) | (anchor - a)))
        if rows:
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_folded(columns[0].to_numpy(), columns[1].to_numpy()))], ["digit", "hull", "doc", "print", "spot", "n"])


def _by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 5
    for spots in _spots(batches):
        rows = []
        for doc, print_, text, first, count, reach in spots:
            anchor = first + reach
            for cell, a, b in _cells(first, count, reach):
                common = _common(text, anchor, cell)
                rows += [(common, _signed(_hash(text[p : p + DEPTH], anchor - p)), doc, print_, (p << 16) | (1 << 8) | (anchor - p)) for p in range(a, b + 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["digit", "window", "doc", "print", "spot"])


def _pass(entries: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of a written table of entries, which is then removed: those that are done as their hull is repeated, and those to spread
    out further.

    Entries that agree within a batch of texts are folded: n counts them at the first, and the others (n = 0) are done. One
    entry of each repeated hull goes on too where its digit has other hulls, as windows of these may be repeated in it."""
    columns = ["digit", "hull", "doc", "print", "spot"]
    rows, spark = entries.where("n > 0"), entries.sparkSession
    total = rows.count()
    folded = scratch.save(entries.where("n = 0").select(*columns))
    alike = rows.groupBy("digit").agg(F.sum("n").alias("n_digit"), F.count("*").alias("n_rows")).where("n_digit > 1")
    alike = scratch.save(alike, total)
    release_shuffles(spark)
    shared = scratch.save(join_by_key(rows, alike, ["digit"], "n_rows", total).where("n_rows is not null").drop("n_rows"), total)
    scratch.drop(entries, alike)
    release_shuffles(spark)
    one = F.min(F.struct("doc", "print", "spot")).alias("one")
    hulls = shared.groupBy("digit", "hull").agg(F.sum("n").alias("n_hull"), F.count("*").alias("n_rows"), F.first("n_digit").alias("n_digit"), one)
    hulls = scratch.save(hulls.where("n_hull > 1"), total)
    judged = scratch.save(join_by_key(shared.select(*columns), hulls.select("digit", "hull", "n_rows"), ["digit", "hull"], "n_rows", total), total)
    going_on = scratch.save(hulls.where("n_hull < n_digit").select("digit", "hull", "one.*"), total)
    scratch.drop(shared, hulls)
    release_shuffles(spark)
    done = judged.where("n_rows is not null").select(*columns).unionByName(folded)
    return done, judged.where("n_rows is null").select(*columns).unionByName(going_on)


def _spans(rows: DataFrame) -> DataFrame:
    """From spots to doc, print, start and end, in bytes."""
    start = F.shiftright("spot", 16)
    return rows.select("doc", "print", start.alias("start"), (start + F.shiftright("spot", 8).bitwiseAND(255) + (DEPTH - 1)).alias("end"))


def _copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, print, n_bytes and whether it's the first, of all texts that occur more than once in whole."""
    sums = [F.xxhash64("text"), F.xxhash64("text", F.lit("again"))]
    rows = scratch.save(docs.select("doc", "print", F.octet_length("text").alias("n_bytes"), sums[0].alias("h1"), sums[1].alias("h2")))
    groups = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "print")).alias("first"))
    n = rows.count()
    groups = scratch.save(groups.where("n > 1"), n)
    found = join_by_key(rows, groups, ["h1", "h2"], "n", n).where("n is not null")
    return scratch.save(found.select("doc", "print", "n_bytes", (F.struct("doc", "print") == F.col("first")).alias("is_first")).distinct(), n)


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, print and spans (start, end in bytes) of all texts with a repeated window; of doc, print and text.

    A text that occurs more than once is repeated in whole; only its first copy goes through the passes, for others that
    share a part of it.
    """
    whole = docs.where(F.octet_length("text") >= DEPTH)
    copies = _copies(whole, scratch)
    others = copies.where("not is_first").select("doc", "print")
    few = others.count() <= BROADCAST_ROWS
    whole = whole.join(F.broadcast(others) if few else others, ["doc", "print"], "left_anti")
    entry = f"digit long, hull long, {_DOC}, spot long, n int"

    def with_spots(left: DataFrame) -> DataFrame:
        spots = left.groupBy("doc", "print").agg(F.collect_set("spot").alias("spots"))  # at most a text's own
        return whole.join(spots, ["doc", "print"]).select("doc", "print", "text", "spots")

    done, left = _pass(scratch.save(whole.mapInArrow(_by_anchor, entry)), scratch)
    cells = scratch.save(with_spots(left).mapInArrow(_by_cell, entry))
    release_shuffles(docs.sparkSession)
    done_cells, left = _pass(cells, scratch)
    each = scratch.save(with_spots(left).mapInArrow(_by_window, f"digit long, window long, {_DOC}, spot long"))
    release_shuffles(docs.sparkSession)
    n = each.count()
    same = scratch.save(each.groupBy("digit", "window").agg(F.count("*").alias("n")).where("n > 1"), n)
    windows = join_by_key(each, same, ["digit", "window"], "n", n).where("n is not null")
    spans = _spans(done).unionByName(_spans(done_cells)).unionByName(_spans(windows))
    spans = spans.unionByName(copies.select("doc", "print", F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end")))
    out = scratch.finish(_runs(spans))
    release_shuffles(docs.sparkSession)
    return out


def _runs(spans: DataFrame) -> DataFrame:
    """doc, print and spans, of which those that touch are one: a periodic text has a span at every byte, but few runs. They are
    sorted by text in tasks that spill, and only runs are gathered."""
    upto = Window.partitionBy("doc", "print").orderBy("start", "end")
    before = F.max("end").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = new.withColumn("run", F.sum("new").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc", "print", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc", "print").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def runs_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, kept = [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            starts = [] if spans.as_py() is None else [(x["start"], x["end"]) for x in spans.as_py()]
            runs.append(runs_of(starts))
            kept.append(without(text.as_py(), runs[-1]))
        sizes = [pa.array(x, pa.int64()) for x in ([len(k) + sum(b - a for a, b in r) for k, r in zip(kept, runs, strict=True)], [sum(b - a for a, b in r) for r in runs], [len(r) for r in runs])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: characters may be cut through)."""
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rows that agree in both parts of the key, the whole 64-bit hash among them, have the same text and so the same repeats
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"))
    spans = repeated_spans(keyed.select("doc", "print", "text"), scratch)
    return keyed.join(spans, ["doc", "print"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
