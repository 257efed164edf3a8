"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Words are runs of letters, of digits, and of other marks; 1-grams and 2-grams of them are hashed to 2 ** BITS features. A document
is its vector of feature counts at unit length, so its score is a sparse dot product, and length doesn't matter.

Training reads at most SAMPLE_ROWS labelled documents, those with the smallest hash of their id, and of these in that order as many
as have SAMPLE_BYTES of features together, without such as have more than MOST_BYTES alone (documented bounds of what the driver
holds: a linear model of this kind gains little beyond them). Features are computed on the executors and written; the sequential
updates of FTRL run over the sample on the driver. Scoring reads every document in whole.

Defined cases: a null or empty text has no features and scores the model's bias; without usable labels every score is the
prior 0.5; labels that are null are ignored, several labels of a document are averaged (0.5 and up counts as 1); repeated
rows are scored one by one; of rows that share a labelled id, one is learnt from; null ids are scored and count as held out by no fold; an empty table gives no rows; other columns
are carried along, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import Scratch, table, text_batches

BITS = 18
SAMPLE_ROWS = 6000
#: Of features, at 8 bytes each, in all and of one document.
SAMPLE_BYTES, MOST_BYTES = 64 << 20, 256 << 10
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
THRESHOLD = 0.3
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_SPACE = re.compile(r"\s")
#: Characters of a text whose words are held at a time; hashes of words that are remembered.
BLOCK = 1 << 20
_CACHE_ROWS = 300_000


def _blocks(text: str, block: int = BLOCK) -> Iterator[str]:
    """A text in parts that end at white space, so that only the words of a part are held at a time."""
    start = 0
    while start < len(text):
        space = _SPACE.search(text, start + block)
        end = space.start() if space else len(text)
        yield text[start:end]
        start = end


class Features:
    """Texts to sparse vectors of unit length. Hashes of words are remembered, up to a bound."""

    def __init__(self, bits: int = BITS):
        self.mask, self.seen = (1 << bits) - 1, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.empty(0, "i8"), *map(self._ids, _blocks(text or ""))])
        if not len(ids):
            return np.empty(0, "i8"), np.empty(0)
        pairs = ((ids[:-1] * 0x9E3779B1) ^ (ids[1:] * 0x85EBCA77)) >> 15
        spots, counts = np.unique(np.concatenate([ids, pairs]) & self.mask, return_counts=True)
        return spots, counts / np.sqrt((counts.astype("f8") ** 2).sum())

    def _ids(self, text: str) -> np.ndarray:
        """The hashes of a block's words."""
        words, seen = _WORD.findall(text), self.seen
        if len(seen) > _CACHE_ROWS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = zlib.crc32(w.encode("utf-8", "replace"))
        return np.fromiter(map(seen.__getitem__, words), "i8", len(words))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss (McMahan et al., 2013), with an unregularised bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n, self.bias, self.bias_n = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = sigmoid(self.bias + w @ x)
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_n += (p - y) ** 2
        self.bias -= ALPHA * (p - y) / (BETA + np.sqrt(self.bias_n))


def sigmoid(v: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(v, -35, 35))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        got = [features(x) for x in batch.column(2).to_pylist()]
        spots, values = [s.astype("<i4").tobytes() for s, _ in got], [v.astype("<f4").tobytes() for _, v in got]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spots, pa.binary()), pa.array(values, pa.binary())], ["order", "y", "spots", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from labelled rows that aren't held out."""
    text_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("y")).where("_id is not null and y is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    chosen = known.withColumn("order", F.xxhash64("_id", F.lit("sample"))).orderBy("order", "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    scratch = Scratch(docs.sparkSession)
    one = rows.groupBy("order", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    written = scratch.save(one.mapInArrow(_sparse, "order long, y double, spots binary, x binary"), sample_rows)
    sizes = written.select("order", (F.octet_length("spots") * 2).alias("size")).orderBy("order").collect()  # at most sample_rows
    last, room = None, sample_bytes
    for r in sizes:
        if r["size"] <= MOST_BYTES and r["size"] <= room:
            last, room = r["order"], room - r["size"]
        elif r["size"] <= MOST_BYTES:
            break
    fits = F.lit(False) if last is None else (F.col("order") <= last) & (F.octet_length("spots") * 2 <= MOST_BYTES)
    sample = written.where(fits).toArrow().sort_by([("order", "ascending")])
    scratch.drop(written)
    model = Ftrl()
    rows = [(np.frombuffer(s, "<i4"), np.frombuffer(x, "<f4").astype("f8"), y) for s, x, y in zip(*(sample.column(c).to_pylist() for c in ("spots", "x", "y")), strict=True)]
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(*rows[i])
    return model.weights(), model.bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """The documents with a column of scores between 0 and 1."""
    text_batches(docs.sparkSession)
    held, bias, at = docs.sparkSession.sparkContext.broadcast(model[0]), model[1], docs.columns.index(text_col)
    names = [*docs.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(), held.value
        for batch in batches:
            out = []
            for text in batch.column(at):
                spots, x = features(text.as_py())
                out.append(sigmoid(bias + float(weights[spots] @ x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
