"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints have 64 bits: a bit is set if more than half of a text's shingle hashes (XXH64, seed 42) set it. Documents whose
fingerprints differ in at most ``bits_apart`` bits are linked, and linked documents form groups.

Exact copies, and all other texts with one fingerprint, fold into one row first. The bits are then grouped into partitions,
correlated bits together; with m partitions, any thresholds t_i >= -1 that add up to bits_apart - m + 1 find every link (some
partition differs in at most t_i bits). The number of partitions and the thresholds come from a dynamic program over estimated
costs: keys to probe, and candidates by the bits' spread over all fingerprints. Fingerprints are filed by the value of each
used partition, probed with all values within t_i, and candidates are verified on all 64 bits, and on 64 more where the table of
fingerprints has a second word (``check``).

A bucket in which what is filed and what probes it would make far more pairs than others do emits none. All fingerprints that
touch such a bucket meet exactly in another way. At few bits apart each is filed under every value within bits_apart / 2 of it, so
fingerprints are linked exactly if they share such a value; at most as many fingerprints share one as there are values that near,
and they're joined to the smallest as a star. At more bits apart there are too many such values, and the bucket is compared in
blocks (``tallyforge.llm.blocks``), which emits a forest of its links.

Groups are the connected components of the links, found by alternating large and small stars over tables.

Defined cases: null and empty texts have fingerprint zero, linked like any other; texts of fewer words than a shingle are one
shingle; rows that share a doc_id or repeat are judged one by one; a null doc_id is grouped but never names a group, unless all
ids of it are null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import blocks
from tallyforge.llm.common import Scratch, join_by_key, table, text_batches
from tallyforge.llm.components import connected_components

BITS, SEED = 64, 42
SHINGLE, BITS_APART = 3, 2
#: A bucket is hot if it would make more pairs than HOT_BUCKET ** 2, and than so many times the mean of all buckets, which grows
#: with the table.
HOT_BUCKET, HOT_TIMES = 64, 32
#: Bytes of a text whose words are held at a time.
BLOCK = 1 << 20
#: Up to so many bits apart, fingerprints of a hot bucket meet halfway.
STAR_BITS = 2
#: Fingerprints of a hot bucket that are compared at a time, and how many of them stand in all of its blocks, about.
BLOCK_PRINTS, LEADERS = 4096, 128
#: Up to so many hot buckets, at 12 bytes, are broadcast.
BROADCAST_ROWS = 500_000
#: Costs of filing or probing one key and of verifying one candidate, in the same unit.
KEY_COST, CANDIDATE_COST = 1.0, 0.2
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype("i8")


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """A text's words, in lists of a block's words, as those of a very long text take many times its own size."""
    start = 0
    while start < len(text):
        end = start + block
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[start:end].split()
        start = end


def shingles(text: bytes, k: int, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Each k neighbouring words, repeats included; of fewer words, all of them as one. They come in lists of a block's words."""
    carry, none = [], True
    for cut in word_blocks(text.lower(), block):
        words = carry + cut
        if len(words) >= k:
            whole = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
            yield [whole[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[k - 1 :], strict=False)]
            words, none = words[len(words) - k + 1 :], False
        carry = words
    if none and carry:
        yield [b" ".join(carry)]


def bit_counts(text: bytes, k: int) -> tuple[np.ndarray, int]:
    """By bit, how many shingle hashes set it; how many shingles there are."""
    counts, n = np.zeros((8, 8), "i8"), 0
    for cut in shingles(text, k):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in cut], "<u8")
        spots = hashes.view("u1").reshape(-1, 8) + np.arange(8) * 256
        counts += np.bincount(spots.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
        n += len(cut)
    return counts.ravel(), n


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    counts, n = bit_counts(text, k)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py() or b"", k) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, "u8").view("i8"))], ["doc_id", "fp"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of bits is set together, in a task's fingerprints."""
    sums = np.zeros((BITS, BITS))
    for batch in batches:
        prints = batch.column(0).to_numpy().view("u1").reshape(-1, 8)
        bits = np.unpackbits(prints, axis=1, bitorder="little").astype("f4")
        sums += (bits.T @ bits).astype("f8")
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype("i4")), pa.array(j.astype("i4")), pa.array(sums.ravel().astype("i8"))], ["i", "j", "n"])


def group_bits(together: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size: a group starts from the free bit that is most correlated with the other free
    bits, and takes on the bit most correlated with the group, until it is full."""
    n = max(float(together.diagonal().max()), 1.0)
    p = together.diagonal() / n
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    strength = np.abs(together / n - np.outer(p, p)) / spread
    np.fill_diagonal(strength, 0)
    free, groups = list(range(BITS)), []
    for g in range(m):
        size = len(free) // (m - g)
        group = [max(free, key=lambda b: (strength[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (strength[b, group].sum(), -b)))  # noqa: B023
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def near_chance(differ: np.ndarray, most: int) -> list[float]:
    """By t up to most: the chance that two fingerprints differ in at most t of some bits, each of which differs so often."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for q in differ:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance)[: most + 1].tolist()


def ball(bits: int, t: int) -> int:
    return sum(comb(bits, i) for i in range(t + 1))


def allocate(groups: list[list[int]], differ: np.ndarray, n: int, bits_apart: int) -> tuple[float, list[int]]:
    """Thresholds of least cost that add up to bits_apart - m + 1, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        chance, after = near_chance(differ[group], bits_apart), {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, bits_apart + 1):
                more = 0.0 if t < 0 else KEY_COST * n * (1 + ball(len(group), t)) + CANDIDATE_COST * n * n * chance[t]
                if total + t not in after or cost + more < after[total + t][0]:
                    after[total + t] = (cost + more, [*chosen, t])
        best = after
    return best[bits_apart - len(groups) + 1]


def plan(together: np.ndarray, n: int, bits_apart: int) -> list[tuple[list[int], int]]:
    """The used partitions, with their thresholds, of the cheapest plan over all numbers of partitions that make sense."""
    p = together.diagonal() / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 0.0, 0.5)
    plans = []
    for m in range(1, bits_apart + 3):
        groups = group_bits(together, m)
        plans.append((*allocate(groups, differ, n, bits_apart), groups))
    _, thresholds, groups = min(plans, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], t: int) -> list[int]:
    return [_signed(sum(1 << b for b in some)) for i in range(t + 1) for some in combinations(bits, i)]


def _near(fp: str, flips: list[int]) -> Column:
    return F.transform(F.array(*(F.lit(x).cast("long") for x in flips)), lambda x: x.bitwiseXOR(F.col(fp)))


def within(bits_apart: int, check_apart: int | None):
    """Which of a bucket's fingerprints (held: one word, or two) are near: links whose components are those of all near pairs."""

    def run(nodes: list[int], held: list[np.ndarray]) -> list[tuple[int, int]]:
        words, out, group = np.stack(held), [], np.arange(len(nodes))
        for i in range(len(nodes) - 1):
            near = np.bitwise_count(words[i + 1 :, 0] ^ words[i, 0]) <= bits_apart
            if check_apart is not None:
                near &= np.bitwise_count(words[i + 1 :, 1] ^ words[i, 1]) <= check_apart
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if group[j] != group[i]:
                    out.append((nodes[i], nodes[j]))
                    group[group == group[j]] = group[i]
        return out

    return run


def links(prints: DataFrame, n: int, bits_apart: int, scratch: Scratch, hot_bucket: int = HOT_BUCKET, check_apart: int | None = None) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs of distinct fingerprints at most bits_apart bits apart;
    prints is a written table of n distinct fingerprints in column fp. With check_apart, only pairs whose second words (column
    check) are at most so many bits apart are meant."""
    if not n:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    rows = prints.select("fp").mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # BITS * BITS rows
    together = np.zeros((BITS, BITS))
    for r in rows:
        together[r["i"], r["j"]] = r["n"]
    parts = plan(together, n, bits_apart)
    masks = [_signed(sum(1 << b for b in bits)) for bits, _ in parts]
    words = ["fp"] if check_apart is None else ["fp", "check"]
    at = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for i, mask in enumerate(masks)))
    filed = scratch.save(prints.select(*words, F.inline(at)))
    probes = [
        prints.select(*words, F.lit(i).alias("part"), F.explode(_near("fp", _flips(bits, t)[1:])).alias("value")).withColumn("value", F.col("value").bitwiseAND(F.lit(masks[i])))
        for i, (bits, t) in enumerate(parts)
        if t
    ]
    entries = filed.withColumn("is_filed", F.lit(True))
    if probes:
        probing = reduce(lambda x, y: x.unionByName(y), probes).withColumn("is_filed", F.lit(False))
        entries = scratch.save(entries.unionByName(probing))
    sizes = entries.groupBy("part", "value").agg((F.count_if("is_filed") * F.count("*")).alias("n_pairs")).where("n_pairs > 1")
    sizes = scratch.save(sizes, n * len(parts))
    mean = sizes.agg(F.avg("n_pairs")).first()[0] or 0.0
    hot = scratch.save(sizes.where(F.col("n_pairs") > max(hot_bucket**2, HOT_TIMES * mean)).select("part", "value"))
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    other = filed.join(hot, ["part", "value"], "left_anti").withColumnsRenamed({w: f"other_{w}" for w in words})
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= bits_apart
    if check_apart is not None:
        apart = apart & (F.bit_count(F.col("check").bitwiseXOR(F.col("other_check"))) <= check_apart)
    pairs = entries.join(hot, ["part", "value"], "left_anti").join(other, ["part", "value"]).where((F.col("fp") < F.col("other_fp")) & apart)
    pairs = pairs.select(F.col("fp").alias("a"), F.col("other_fp").alias("b"))
    if not n_hot:
        return pairs
    touching = entries.join(hot, ["part", "value"], "left_semi")
    if bits_apart <= STAR_BITS and bits_apart % 2 == 0 and check_apart is None:
        near = _flips(list(range(BITS)), bits_apart // 2)
        spots = touching.select("fp").distinct().select("fp", F.explode(_near("fp", near)).alias("spot"))
        shared = spots.groupBy("spot").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most len(near) each
        return pairs.unionByName(shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))
    held = scratch.save(touching.select(F.col("fp").alias("node"), F.xxhash64("part", "value").alias("root"), F.array(*words).alias("held")))
    forest = blocks.linked(held, held.count(), scratch, within(bits_apart, check_apart), BLOCK_PRINTS, LEADERS)
    return pairs.unionByName(forest.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, bits_apart: int = BITS_APART, id_col: str = "doc_id", text_col: str = "text", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per document: doc_id, fp (as a signed long), component_id."""
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.save(narrow.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))
    total = rows.count()
    prints = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")), total)
    n = prints.count()
    roots = scratch.save(connected_components(links(prints, n, bits_apart, scratch, hot_bucket), scratch), n)
    rooted = scratch.save(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n_rows", F.coalesce("root", "fp").alias("root")), n)
    named = scratch.save(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_prints")), n)
    known = scratch.save(join_by_key(rooted, named, ["root"], "n_prints", n).select("fp", "n_rows", "component_id"), n)
    return scratch.finish(join_by_key(rows, known, ["fp"], "n_rows", total).select("doc_id", "fp", "component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
