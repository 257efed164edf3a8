import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import quality
from tests.llm.conftest import ODD, SF

BIG = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.op7_quality(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()
    test = out[out.held_out]
    good, bad = test[test.quality == 1].score.values, test[test.quality == 0].score.values
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.95
    assert (test[test.quality == 1].predicted == 1).mean() > 0.98
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


def test_held_out_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_odd_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (8, 1)], "doc_id long, quality int")
    docs = frame([*ODD, (1, "good text"), (2, "bad!!! ###"), (3, "x")])
    out = quality.score(docs, quality.train(docs, labels))
    scores = out.collect()
    assert len(scores) == len(ODD) + 3 and all(0 <= r._score <= 1 for r in scores)
    assert out.columns == [*docs.columns, "_score"]
    empty = {r._score for r in scores if not (r.text or "").strip()}
    assert len(empty) == 1


def test_no_labels_and_no_rows(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = frame([(1, "text")])
    assert quality.score(docs, quality.train(docs, labels)).first()._score == 0.5
    assert quality.score(frame([]), quality.train(frame([]), labels)).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    weights, _ = quality.train(docs, labels, sample_rows=1)
    assert np.count_nonzero(weights) < np.count_nonzero(quality.train(docs, labels)[0])


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    some = np.count_nonzero(quality.train(docs, labels, sample_bytes=20_000)[0])
    assert 0 < some < np.count_nonzero(quality.train(docs, labels)[0])
    monkeypatch.setattr(quality, "MOST_BYTES", 0)
    assert not quality.train(docs, labels)[0].any()


def plain_features(text):
    """Feature to share, by dictionaries."""
    words = [zlib.crc32(w.encode()) for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    found = [x & 0x3FFFF for x in words] + [(wrap(wrap(a * 0x9E3779B1) ^ wrap(b * 0x85EBCA77)) >> 15) & 0x3FFFF for a, b in zip(words, words[1:], strict=False)]
    counts = {x: found.count(x) for x in set(found)}
    length = math.sqrt(sum(n * n for n in counts.values()))
    return {x: n / length for x, n in counts.items()}


def plain_model(rows):
    """FTRL one coordinate at a time; rows: features and label, in the order of the sample."""
    z, n, bias, bias_n = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for epoch in range(quality.EPOCHS):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[at]
            now = {i: weight(i) for i in x}
            error = 1 / (1 + math.exp(-(bias + sum(now[i] * v for i, v in x.items())))) - y
            for i, v in x.items():
                g, before = error * v, n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / quality.ALPHA * now[i]
            bias_n += error * error
            bias -= quality.ALPHA * error / (quality.BETA + math.sqrt(bias_n))
    return {i: weight(i) for i in z}, bias


def test_scores_equal_a_plain_trainer_and_scorer(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.where(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality").withColumn("order", F.xxhash64("doc_id", F.lit("sample")))
    sample = docs.join(known, "doc_id").orderBy("order").collect()
    weights, bias = plain_model([(plain_features(r.text), float(r.quality >= 0.5)) for r in sample])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.op7_quality(spark, SF).collect():
        score = bias + sum(weights.get(i, 0.0) * v for i, v in plain_features(texts[r.doc_id]).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-score)), abs=1e-4) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_features_have_unit_length():
    features = quality.Features()
    spots, x = features("Word word, word word 12 ### ")
    assert np.isclose((x**2).sum(), 1) and len(set(spots)) == len(spots)
    assert len(features("")[0]) == len(features(None)[0]) == 0


def test_ftrl_separates():
    model, r = quality.Ftrl(bits=4), np.random.default_rng(0)
    for _ in range(500):
        y = r.integers(0, 2)
        model.learn(np.array([y, 2]), np.array([1.0, 0.5]), y)
    w = model.weights()
    assert w[1] > 0.5 > -0.5 > w[0] and (w[3:] == 0).all()


def test_blocks_of_long_texts_lose_no_word():
    text = "ab, cd!!  ef\n12 gh " * 30
    for block in (1, 5, 64):
        parts = list(quality._blocks(text, block))
        assert "".join(parts) == text and [w for p in parts for w in quality._WORD.findall(p)] == quality._WORD.findall(text)
