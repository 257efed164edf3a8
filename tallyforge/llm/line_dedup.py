"""Line dedup: documents probe sharded minimal perfect hashes instead of joining their lines.

Pass 1 hashes every line's key to 128 bits, and sums up per hash the smallest doc_id that holds it and how many do (first in each
batch of documents, so that a line in a third of all documents arrives as one row a batch). All distinct hashes are sharded by
their first half; each shard of about SHARD_KEYS hashes gets a minimal perfect hash (levels of bit arrays), which indexes flat
arrays: a compact fingerprint (32 bits of the other half, which tells lines of other documents) and a count (to 255), and for
counts above one the first doc_id. Pass 2 streams the documents once more and probes the arrays: a line goes if its count is above
one and its document isn't the first.

What is broadcast is bounded by ``sweep_bytes``: if the arrays are larger, groups of shards are broadcast one after the other. The
lines' hashes (16 bytes a line) are then written once by group, so each sweep reads its own lines alone, in place of the texts, and
the marks are joined to the documents.

Defined cases: a null or empty text is one empty line; a row with a null doc_id belongs to one nameless document that comes
after all others; rows that share a doc_id are one document, which alone doesn't make a line repeated; keys of fewer than
MIN_CHARS code points always stay; an empty table gives no rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import Scratch, table, text_batches

MIN_CHARS = 10
SHARD_KEYS = 1 << 16
SWEEP_BYTES = 48 << 20
GAMMA = 1.5
LAST = np.iinfo(np.int64).max


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def long_enough(key: bytes) -> bool:
    return len(key) >= 4 * MIN_CHARS or (len(key) >= MIN_CHARS and len(key.decode("utf-8", "replace")) >= MIN_CHARS)


def line_hashes(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """The lines of each text; for all lines with a key that counts: the text's index, the line's index, two hash halves."""
    lines, owner, index, sums = [], [], [], []
    for i, text in enumerate(texts):
        cut = (text or b"").split(b"\n")
        lines.append(cut)
        for j, line in enumerate(cut):
            key = line_key(line)
            if long_enough(key):
                owner.append(i)
                index.append(j)
                sums.append(xxhash.xxh3_128_digest(key))
    halves = np.frombuffer(b"".join(sums), dtype=">u8").astype("u8").reshape(-1, 2)
    return lines, np.array(owner, "i8"), np.array(index, "i8"), halves


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def _summed(ids: np.ndarray, halves: np.ndarray, n: np.ndarray | None = None) -> list[np.ndarray]:
    """h1, h2, first, last, n by distinct hash."""
    order = np.lexsort((ids, halves[:, 1], halves[:, 0]))
    ids, halves = ids[order], halves[order]
    new = np.ones(len(ids), bool)
    new[1:] = (halves[1:] != halves[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(ids)) - 1
    fresh = new.copy()
    fresh[1:] |= ids[1:] != ids[:-1]
    return [halves[at, 0].view("i8"), halves[at, 1].view("i8"), ids[at], ids[end], np.add.reduceat(fresh.astype("i8"), at)]


def _sum_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, owner, _, halves = line_hashes(batch.column(1).cast(pa.binary()).to_pylist())
        if len(owner):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(_ids(batch.column(0))[owner], halves)], ["h1", "h2", "first", "last", "n"])


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Keys to 0 .. n - 1 without gaps: at each level the keys alone in their slot are placed, the rest go on.

    Keys are pairs of hash halves folded to 64 bits; keys equal after folding are kept in a small list at the end.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        uniq, counts = np.unique(keys, return_counts=True)
        self.odd = uniq[counts > 1]
        left, placed = uniq[counts == 1], 0
        while len(left):
            size = max(8, int(len(left) * GAMMA))
            spots = (_mixed(left, len(self.levels)) % np.uint64(size)).astype("i8")
            alone = np.bincount(spots, minlength=size) == 1
            ranks = np.where(alone, np.cumsum(alone) - 1 + placed, -1).astype("i4")
            self.levels.append((ranks, size))
            placed += int(alone.sum())
            left = left[~alone[spots]]
        self.n = placed

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Where a key is, if it is one of the set; any place or -1 if it isn't."""
        out, left = np.full(len(keys), -1, "i8"), np.arange(len(keys))
        for level, (ranks, size) in enumerate(self.levels):
            got = ranks[(_mixed(keys[left], level) % np.uint64(size)).astype("i8")]
            out[left[got >= 0]] = got[got >= 0]
            left = left[got < 0]
        return out


def fold(halves: np.ndarray) -> np.ndarray:
    return halves[:, 0] ^ ((halves[:, 1] << np.uint64(31)) | (halves[:, 1] >> np.uint64(33)))


class LineArrays:
    """A shard: a perfect hash that indexes fingerprints and counts, and by these the first doc_ids of repeated lines."""

    def __init__(self, halves: np.ndarray, first: np.ndarray, n: np.ndarray):
        keys = fold(halves)
        self.hash = PerfectHash(keys)
        odd = np.isin(keys, self.hash.odd)
        at = self.hash(keys[~odd])
        firsts = np.empty(self.hash.n, "i8")
        self.prints, self.count = np.empty(self.hash.n, "u4"), np.empty(self.hash.n, "u1")
        self.prints[at], self.count[at], firsts[at] = halves[~odd, 1].astype("u4"), np.minimum(n[~odd], 255), first[~odd]
        self.first = firsts[self.count > 1]
        self.rest = {(int(a), int(b)): int(f) if m > 1 else int(LAST) for (a, b), f, m in zip(halves[odd], first[odd], n[odd], strict=True)}
        self._rank()

    def _rank(self) -> None:
        """Where a repeated line's first doc_id is."""
        self.place = np.cumsum(self.count > 1, dtype="i4") - 1

    def firsts(self, halves: np.ndarray) -> np.ndarray:
        """The first doc_id of each repeated line, LAST for lines that aren't repeated."""
        at = self.hash(fold(halves))
        hit = at >= 0
        hit[hit] = (self.prints[at[hit]] == halves[hit, 1].astype("u4")) & (self.count[at[hit]] > 1)
        out = np.full(len(halves), LAST, "i8")
        out[hit] = self.first[self.place[at[hit]]]
        if self.rest:
            for i, (a, b) in enumerate(halves):
                out[i] = self.rest.get((int(a), int(b)), out[i])
        return out

    def dumps(self) -> bytes:
        sizes = np.array([s for _, s in self.hash.levels], "i8")
        bits = [np.packbits(r >= 0) for r, _ in self.hash.levels]
        rest = np.array([(a, b, f & (2**64 - 1)) for (a, b), f in self.rest.items()], "u8").reshape(-1, 3)
        np.savez(out := io.BytesIO(), sizes=sizes, bits=np.concatenate(bits or [np.empty(0, "u1")]), prints=self.prints, first=self.first, count=self.count, odd=self.hash.odd, rest=rest)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> LineArrays:
        held, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.prints, self.first, self.count = held["prints"], held["first"], held["count"]
        self.rest = {(int(a), int(b)): int(np.uint64(f).astype("i8")) for a, b, f in held["rest"]}
        self.hash = PerfectHash.__new__(PerfectHash)
        self.hash.levels, self.hash.odd, self.hash.n = [], held["odd"], len(self.prints)
        at = placed = 0
        for size in held["sizes"].tolist():
            alone = np.unpackbits(held["bits"][at : at + (size + 7) // 8], count=size).astype(bool)
            self.hash.levels.append((np.where(alone, np.cumsum(alone) - 1 + placed, -1).astype("i4"), size))
            at, placed = at + (size + 7) // 8, placed + int(alone.sum())
        self._rank()
        return self


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by shard: a shard is whole in its task, and only one is held at a time."""

    def done(shard: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        h1, h2, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        data = LineArrays(np.stack([h1.view("u8"), h2.view("u8")], 1), first, n).dumps()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["shard", "arrays", "size"])

    shard, parts = None, []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        for part in zip(*(np.split(c, cuts) for c in columns), strict=True):
            if not len(part[0]):
                continue
            if parts and part[0][0] != shard:
                yield done(shard, parts)
                parts = []
            shard = int(part[0][0])
            parts.append(list(part[1:]))
    if parts:
        yield done(shard, parts)


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1 % np.uint64(shards)).astype("i8")


class Probe:
    """Which lines go, by the arrays of a sweep."""

    def __init__(self, arrays, shards: int):
        self.arrays, self.shards, self.loaded = arrays, shards, None

    def __call__(self, ids: np.ndarray, halves: np.ndarray) -> np.ndarray:
        if self.loaded is None:
            self.loaded = {k: LineArrays.loads(v) for k, v in self.arrays.value}
        goes, at = np.zeros(len(ids), bool), shard_of(halves[:, 0], self.shards)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            if held := self.loaded.get(int(at[rows[0]])):
                goes[rows] = held.firsts(halves[rows]) < ids[rows]
        return goes


def _cleaned(batch: pa.RecordBatch, id_at: int, text_at: int, decide, names: list[str]) -> pa.RecordBatch:
    """decide: from ids, owners, line indices and halves to which of these lines go."""
    lines, owner, index, halves = line_hashes(batch.column(text_at).cast(pa.binary()).to_pylist())
    goes = decide(_ids(batch.column(id_at)), owner, index, halves)
    dropped: dict[int, set[int]] = {}
    for i, j in zip(owner[goes].tolist(), index[goes].tolist(), strict=True):
        dropped.setdefault(i, set()).add(j)
    texts = [b"\n".join(x for j, x in enumerate(cut) if j not in d) if (d := dropped.get(i)) else b"\n".join(cut) for i, cut in enumerate(lines)]
    columns = list(batch.columns)
    columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
    columns += [pa.array([len(x) for x in lines], pa.int64()), pa.array([len(dropped.get(i, ())) for i in range(len(lines))], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names)


def line_arrays(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Of doc_id and text: the shards' arrays, and how many shards there are."""
    sums = docs.mapInArrow(_sum_lines, "h1 long, h2 long, first long, last long, n long")
    distinct = sums.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    # batches count a document that rows share each for itself
    distinct = scratch.save(distinct.select("h1", "h2", "first", F.when(F.col("first") == F.col("last"), 1).otherwise(F.col("n")).alias("n")))
    shards = -(-max(1, distinct.count()) // SHARD_KEYS)
    unsigned = F.pmod(F.pmod(F.shiftrightunsigned("h1", 1), F.lit(shards)) * 2 + F.col("h1").bitwiseAND(1), F.lit(shards)).cast("int")
    keyed = distinct.select(unsigned.alias("shard"), "h1", "h2", "first", "n")
    built = scratch.save(keyed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_build, "shard int, arrays binary, size long"))
    scratch.drop(distinct)
    return built, shards


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweep_bytes: int = SWEEP_BYTES) -> DataFrame:
    """The documents with text cut, and columns _n_lines (before) and _n_dropped."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    text_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    arrays, shards = line_arrays(narrow, scratch)
    sweeps, room = [[]], sweep_bytes
    for r in arrays.select("shard", "size").orderBy("shard").collect():  # 12 bytes for each SHARD_KEYS distinct lines
        if r["size"] > room and sweeps[-1]:
            sweeps, room = [*sweeps, []], sweep_bytes
        sweeps[-1].append(r["shard"])
        room -= r["size"]

    def loaded(which: list[int]) -> Probe:
        rows = arrays.where(F.col("shard").isin(which)).select("shard", "arrays").collect() if which else []
        return Probe(spark.sparkContext.broadcast([(r["shard"], bytes(r["arrays"])) for r in rows]), shards)

    names = [*docs.columns, "_n_lines", "_n_dropped"]
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in docs.schema.fields), T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])
    if len(sweeps) == 1:
        probe = loaded(sweeps[0])
        scratch.keep()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _cleaned(batch, id_at, text_at, lambda ids, owner, index, halves: probe(ids[owner], halves), names)

        return docs.mapInArrow(run, schema)

    sweep_of = np.zeros(shards, "i4")
    for i, some in enumerate(sweeps):
        sweep_of[some] = i

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, owner, index, halves = line_hashes(batch.column(1).cast(pa.binary()).to_pylist())
            sweep = sweep_of[shard_of(halves[:, 0], shards)]
            order = np.lexsort((sweep, owner))
            owner, index, halves, sweep = owner[order], index[order], halves[order], sweep[order]
            new = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(sweep, prepend=-1))
            ends = np.append(new[1:], len(owner))
            at = [index[a:b].astype("<i8").tobytes() for a, b in zip(new, ends, strict=True)]
            sums = [halves[a:b].astype("<u8").tobytes() for a, b in zip(new, ends, strict=True)]
            rows = pa.array(owner[new])
            columns = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(at, pa.binary()), pa.array(sums, pa.binary()), pa.array(sweep[new], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "at", "sums", "sweep"])

    def marks(probe: Probe):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc, print_, at, sums in zip(_ids(batch.column(0)).tolist(), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    halves = np.frombuffer(sums, "<u8").reshape(-1, 2)
                    goes = probe(np.full(len(halves), doc, "i8"), halves)
                    if goes.any():
                        out.append((None if doc == LAST else doc, print_, np.frombuffer(at, "<i8")[goes].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "print", "goes"])

        return run

    print_ = F.xxhash64(F.col(text_col).cast("string"))
    sums = scratch.save(narrow.withColumn("print", F.xxhash64("text")).mapInArrow(hashed, "doc_id long, print long, at binary, sums binary, sweep int"), by="sweep")
    marked = []
    for i, some in enumerate(sweeps):
        probe = loaded(some)
        marked.append(scratch.save(sums.where(F.col("sweep") == i).drop("sweep").mapInArrow(marks(probe), "doc_id long, print long, goes array<long>")))
        probe.arrays.destroy()
    scratch.drop(sums, arrays)
    every = marked[0]
    for m in marked[1:]:
        every = every.unionByName(m)
    each = every.groupBy("doc_id", "print").agg(F.array_distinct(F.flatten(F.collect_list("goes"))).alias("_goes"))
    joined = docs.withColumn("_print", print_).join(each.withColumnsRenamed({"doc_id": "_id", "print": "_print2"}), F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_print2")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goes = [set(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            narrow = pa.RecordBatch.from_arrays(batch.columns[:-1], names[:-2])
            yield _cleaned(narrow, id_at, text_at, lambda ids, owner, index, halves: np.array([j in goes[i] for i, j in zip(owner.tolist(), index.tolist(), strict=True)], bool), names)  # noqa: B023

    return joined.select(*docs.columns, "_goes").mapInArrow(cut, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS nr, unnest(lines) AS line FROM cut),
keyed AS (
  SELECT doc_id, nr, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
),
repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.*, coalesce(first <> doc_id, false) AS goes FROM keyed k LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
