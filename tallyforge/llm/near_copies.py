"""Near copies: SimHash finds candidates, and exact similarity of five-word shingles decides.

Two texts are near copies when the sets of their word 5-gram shingles (a text of fewer words is one shingle of all its words; words
as in SimHash) have a cosine similarity of at least SIMILAR, which is the similarity that SimHash approximates: shared shingles
over the geometric mean of the sets' sizes. Linked texts form groups, and one row of each stays.

Candidates come from the generalised pigeonhole search of ``tallyforge.llm.simhash``. An edited word changes five 5-word shingles but
a single word, so the fingerprints that are searched are those of words, each weighted by the root of how often it occurs. They
have two words of 64 bits: the first is indexed and probed (BITS_APART), the second only verified (CHECK_APART), so that chance
neighbours, whose number grows with the square of the table, don't pass. Fingerprints that hang together are a cluster, and inside
a cluster every pair of different texts is compared by its whole sets of shingles, so no link rests on a fingerprint. Texts whose
fingerprints are further apart than that are missed; the README says how many.

Rows are judged one by one: a row is known by its doc_id and 128 bits of its text's hash, and leaves only because of its own
text. Of a group the row with the smallest doc_id stays (nulls last, ties by hash), and of rows equal in doc_id and text one.

Defined cases: null, empty and blank texts have no words and are copies of each other; an empty table gives no rows; other columns
are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import blocks
from tallyforge.llm.common import KEY, Scratch, few, join_by_key, one_a_group, row_key, text_batches
from tallyforge.llm.components import connected_components
from tallyforge.llm.simhash import links, shingles, word_blocks

SHINGLE, SEED = 5, 42
#: Similarity as a fraction, so that it's compared in integers.
SIMILAR = (4, 5)
#: Bits in which the two words of the fingerprints of candidates differ at most.
BITS_APART, CHECK_APART = 6, 10
#: Texts of a cluster that are compared at a time, and how many of them stand in all of its blocks, about.
BLOCK, LEADERS = 256, 32
_KEY = "_none boolean, _id long, _h1 long, _h2 long"
#: Words whose bits are looked at together; hashes of words that are remembered.
_STEP, _CACHE_ROWS = 4096, 300_000
_PLACES = np.arange(16) * 256
_BYTE_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype("f8")


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > _CACHE_ROWS:
            self.clear()
        found = self[word] = xxhash.xxh3_128_digest(word, SEED)
        return found


class WordPrints:
    """Texts to fingerprints of two 64-bit words, over words weighted by the root of their number (in whole 1024ths, so that the
    order of words doesn't matter)."""

    def __init__(self):
        self.seen = _Hashes()

    def __call__(self, text: bytes) -> tuple[int, int]:
        counts: Counter = Counter()
        for words in word_blocks(text.lower()):
            counts.update(words)
        sums, total, words = np.zeros((16, 8)), 0.0, list(counts)
        weights = np.floor(np.sqrt(np.fromiter(counts.values(), "f8", len(words))) * 1024)
        for i in range(0, len(words), _STEP):
            hashes = np.frombuffer(b"".join(map(self.seen.__getitem__, words[i : i + _STEP])), "u1").reshape(-1, 16)
            spots = (hashes + _PLACES).ravel()
            sums += np.bincount(spots, np.repeat(weights[i : i + _STEP], 16), 4096).reshape(16, 256) @ _BYTE_BITS
            total += weights[i : i + _STEP].sum()
        first, second = np.packbits((2 * sums > total).ravel(), bitorder="little").view("<u8").tolist()
        return first, second


def shingle_set(text: bytes) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted; of a text without words, that of the empty shingle."""
    parts = [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in cut], "u8")) for cut in shingles(text, SHINGLE)]
    return np.unique(np.concatenate(parts)) if parts else np.array([xxhash.xxh64_intdigest(b"", SEED)], "u8")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prints = WordPrints()
    for batch in batches:
        words = [prints(x.as_py() or b"") for x in batch.column(len(KEY)).cast(pa.binary())]
        both = np.array(words, "u8").reshape(-1, 2).view("i8")
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEY)], *(pa.array(np.ascontiguousarray(both[:, i])) for i in range(2))], [*KEY, "fp", "check"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [shingle_set(x.as_py() or b"") for x in batch.column(2).cast(pa.binary())]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, held)], dtype="i4"), np.concatenate([np.empty(0, "i8"), *(x.view("i8") for x in held)]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], ["node", "root", "held"])


def similar_pairs(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links whose components are those of all pairs of near copies."""
    a, b = SIMILAR
    sizes = np.array([len(x) for x in sets], "i8")
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts, out = np.concatenate([[0], np.cumsum(sizes)]), []
    group = np.arange(len(nodes))
    for i in range(len(nodes) - 1):
        if (group == group[i]).all():
            break
        mark = np.zeros(len(words), "i8")
        mark[at[starts[i] : starts[i + 1]]] = 1
        common = np.add.reduceat(mark[at], starts[:-1])
        for j in np.flatnonzero(common * common * b * b >= sizes * sizes[i] * a * a).tolist():
            if group[j] != group[i]:
                out.append((nodes[i], nodes[j]))
                group[group == group[j]] = group[i]
    return out


def near_copy_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """A written table with KEY and group of all rows that have a candidate, and a bound on its number of rows."""
    text_batches(docs.sparkSession)
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    rows = scratch.save(keyed.mapInArrow(_sketch, f"{_KEY}, fp long, check long"))
    n = rows.count()
    prints = scratch.save(rows.groupBy("fp").agg(F.min("check").alias("check"), F.count("*").alias("n_rows")), n)
    found = links(prints, prints.count(), BITS_APART, scratch, check_apart=CHECK_APART)
    clusters = scratch.save(connected_components(found, scratch), n)
    rooted = scratch.save(prints.join(clusters.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n_rows", F.coalesce("root", "fp").alias("root")), n)
    sizes = scratch.save(rooted.groupBy("root").agg(F.sum("n_rows").alias("n_in"), F.count("*").alias("n_prints")).where("n_in > 1"), n)
    in_one = scratch.save(join_by_key(rooted, sizes, ["root"], "n_prints", n).where("n_in is not null").select("fp", "n_rows", "root"), n)
    told = scratch.save(join_by_key(rows.select(*KEY, "fp"), in_one, ["fp"], "n_rows", n).where("root is not null").select(*KEY, "root"), n)
    # one node for each different text of a cluster
    texts = told.groupBy("root", "_h1", "_h2").agg(F.min(F.struct("_none", "_id")).alias("one"), F.count("*").alias("n_rows"))
    nodes = scratch.save(texts.withColumn("node", F.monotonically_increasing_id()), n)
    several = scratch.save(nodes.groupBy("root").agg(F.count("*").alias("n_texts")).where("n_texts > 1"), n)
    picked = join_by_key(nodes, several, ["root"], "n_texts", n).where("n_texts is not null")
    picked = scratch.save(picked.select("node", "root", "one._none", "one._id", "_h1", "_h2"), n)
    whole = keyed.join(few(picked), KEY).select("node", "root", "text").dropDuplicates(["node"])
    sets = scratch.save(whole.mapInArrow(_sets, "node long, root long, held array<long>"))
    linked = blocks.linked(sets, sets.count(), scratch, similar_pairs, BLOCK, LEADERS).select("node", F.col("root").alias("group"))
    grouped = scratch.save(nodes.join(linked, "node", "left").select("root", "_h1", "_h2", "n_rows", F.coalesce("group", "node").alias("group")), n)
    out = scratch.save(join_by_key(told, grouped, ["root", "_h1", "_h2"], "n_rows", n).select(*KEY, "group"), n)
    return out, n


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, but of each group of near copies only one row."""
    scratch = Scratch(docs.sparkSession)
    rows, n = near_copy_groups(docs, scratch)
    return one_a_group(docs, rows, n, scratch)
