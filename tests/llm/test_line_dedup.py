import hashlib

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup
from tests.llm.conftest import ODD, SF, rows

SPACE = " \t\n\x0b\x0c\r"


def brute(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    far = 1 << 62
    where: dict = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                where.setdefault(key(line), set()).add(far if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(where[key(x)]) < 2 or min(where[key(x)]) == (far if d is None else d)]
        out.append(repr((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())))
    return sorted(out)


DOCS = [*ODD, (1, "A line of text\nshort\nA line of text\r\nown line number one"), (2, "  a LINE of text \nshort\nümläut line"), (3, "Ümläut line\na line of text"), (3, "twice the same id"), (3, "twice the same id"), (4, "twice the same\x0bid\n\n"), (None, "own line number one"), (13, "äöüäöüäöü\nÄäöüäöüäöü"), (14, "äöüäöüäöü")]


def got(df, **more):
    out = line_dedup.line_dedup(df, **more)
    return sorted(repr(tuple(r)) for r in out.select("doc_id", "_n_lines", "_n_dropped", F.sha2("text", 256)).collect())


def test_odd_rows_and_sweeps(frame, monkeypatch):
    assert got(frame(DOCS)) == brute(DOCS)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    assert got(frame(DOCS), sweep_bytes=1500) == brute(DOCS)


def test_columns_are_carried_along(frame):
    out = line_dedup.line_dedup(frame([(1, "a line that repeats"), (2, "a line that repeats")]))
    assert out.where("doc_id = 2").first().asDict() == {"doc_id": 2, "text": "", "lang": "x", "source": "y", "n_chars": 1, "row": 7, "sha": "z", "kept": True, "fp": 5, "_n_lines": 1, "_n_dropped": 1}


def test_empty_table(frame):
    assert got(frame([])) == []


def test_whole_table_equals_sql(spark, oracle):
    assert rows(line_dedup.op3_line_dedup(spark, SF).toPandas()) == rows(oracle(line_dedup.OP3_SQL))


def test_perfect_hash_is_perfect_and_minimal():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype="u8")
    held = line_dedup.PerfectHash(keys)
    assert sorted(held(keys).tolist()) == list(range(5000))


def test_arrays_survive_writing_and_tell_strangers():
    r = np.random.default_rng(2)
    halves = r.integers(0, 2**64, (3000, 2), dtype="u8")
    halves[1] = (halves[0, 0] ^ np.uint64(1), halves[0, 1])
    clash = np.array([[5, 0], [5 ^ (1 << 31), 1]], "u8")  # fold to the same key
    halves = np.concatenate([halves, clash])
    first = np.arange(len(halves))
    back = line_dedup.LineArrays.loads(line_dedup.LineArrays(halves, first, first + 2).dumps())
    assert (back.firsts(halves) == first).all()
    assert (back.firsts(r.integers(0, 2**64, (3000, 2), dtype="u8")) == line_dedup.LAST).all()
