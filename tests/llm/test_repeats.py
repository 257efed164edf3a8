import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import repeats
from tests.llm.conftest import ODD, SF


def brute(docs):
    data = [(d, (t or "").encode()) for d, t in docs]
    n = Counter(t[i : i + 200] for _, t in data for i in range(len(t) - 199))
    out = []
    for d, t in data:
        hit = bytearray(len(t))
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        runs = sum(1 for i in range(len(t)) if hit[i] and not (i and hit[i - 1]))
        out.append(repr((d, len(t), sum(hit), runs, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def got(df):
    return sorted(repr(tuple(r)) for r in repeats.drop_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def passages(seed):
    """Shared passages of about the threshold, edited copies, repetition within a text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(r.randrange(30, 90)) for _ in range(6)]
    out = []
    for i in range(40):
        parts = [prose(r.randrange(5, 40))]
        for _ in range(r.randrange(3)):
            x = r.choice(shared)
            a = r.randrange(0, 20)
            x = x[a : len(x) - r.randrange(0, 20)]
            if r.random() < 0.4:
                at = r.randrange(len(x))
                x = x[:at] + "X" + x[at + 1 :]
            parts += [x, prose(r.randrange(0, 20))]
        out.append((i, " ".join(parts)))
    return [*out, (50, "ab" * 400), (51, "a" * 333), (52, "xyz " * 60 + "q" + "xyz " * 60), (53, "é" * 150), (53, "é" * 150)]


@pytest.mark.parametrize(("seed", "chunk"), [(0, 1 << 20), (1, 64), (2, 500)])
def test_passages_equal_brute_force(frame, monkeypatch, seed, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    assert got(frame(passages(seed))) == brute(passages(seed))


def test_odd_rows(frame):
    docs = [*ODD, (20, "t" * 199), (21, "t" * 199), (22, "u" * 200), (23, "u" * 200)]
    assert got(frame(docs)) == brute(docs)


def test_empty_table(frame):
    assert got(frame([])) == []


def test_whole_table_equals_brute_force(spark, documents):
    out = sorted(repr(tuple(r)) for r in repeats.op5_repeats(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert out == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_equal_windows_have_equal_anchors():
    r = random.Random(9)
    window = bytes(r.randrange(97, 100) for _ in range(repeats.DEPTH))
    seen = set()
    for _ in range(30):
        before = bytes(r.randrange(97, 100) for _ in range(r.randrange(300)))
        text = before + window + bytes(r.randrange(97, 100) for _ in range(r.randrange(300)))
        digit, first, count, reach = repeats.entries(text)
        i = next(i for i in range(len(first)) if first[i] <= len(before) < first[i] + count[i])
        seen.add((int(digit[i]), int(first[i] + reach[i] - len(before))))
        assert count.sum() == len(text) - repeats.DEPTH + 1
    assert len(seen) == 1


def test_runs_and_cuts():
    assert repeats.runs_of([(5, 9), (0, 3), (3, 4), (7, 12)]) == [(0, 4), (5, 12)]
    assert repeats.without(b"0123456789", [(0, 2), (5, 7)]) == b"234789"


def test_texts_are_told_apart_by_more_than_31_bits(spark, frame):
    from pyspark.sql import functions as F

    # two texts without an id whose hashes agree in their low 31 bits; one of them is repeated in whole
    made = spark.range(400_000).select(F.concat(F.lit("p" * 200), F.col("id").cast("string")).alias("t")).select("t", F.xxhash64("t").bitwiseAND(0x7FFFFFFF).alias("low"))
    a, b = made.groupBy("low").agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").first().ts[:2]
    assert a != b
    docs = [(None, a), (None, b), (5, a)]
    prints = []
    seen = repeats.repeated_spans
    try:
        repeats.repeated_spans = lambda docs, scratch: prints.extend(docs.collect()) or seen(docs, scratch)
        out = got(frame(docs))
    finally:
        repeats.repeated_spans = seen
    assert len({(r.doc, r.print) for r in prints if r.doc == -1}) == 2 and out == brute(docs)
