import hashlib
import re

import pytest

from tallyforge.llm import exact_dedup
from tests.llm.conftest import ODD, SF, rows


def brute(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for d, t in docs:
        groups.setdefault(norm(t), []).append(d)
    first = {k: min(v, key=lambda d: (d is None, d or 0)) for k, v in groups.items()}
    return sorted(repr((d, first[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())) for d, t in docs), len(groups)


@pytest.mark.parametrize("bits", [exact_dedup.MAX_FILTER_BITS, 1 << 20])
def test_odd_rows(frame, bits):
    out = exact_dedup.exact_dedup(frame(ODD), max_filter_bits=bits).collect()
    expected, groups = brute(ODD)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex())) for r in out) == expected
    assert sum(r.kept for r in out) == groups
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_shards_of_the_filter_give_the_same(frame, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SEGMENT_BITS", 5)
    docs = ODD + [(100 + i, f"text {i % 20}") for i in range(30)]
    out = exact_dedup.exact_dedup(frame(docs), max_filter_bits=128).collect()  # 6 filters of at most 128 positions
    expected, groups = brute(docs)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex())) for r in out) == expected and sum(r.kept for r in out) == groups


def test_empty_table(frame):
    assert exact_dedup.exact_dedup(frame([])).count() == 0


def test_whole_table_equals_sql(spark, oracle):
    assert rows(exact_dedup.op2_exact_dedup(spark, SF).toPandas()) == rows(oracle(exact_dedup.OP2_SQL))


def test_filter_lets_every_repeated_hash_through(spark):
    sums = [hashlib.sha256(str(i % 700).encode()).digest() for i in range(1000)]
    df = spark.createDataFrame([(bytearray(s),) for s in sums], "sha binary").repartition(5)
    bits, twice = exact_dedup.repeated_filter(df, 1000)
    import numpy as np
    import pyarrow as pa

    spots = exact_dedup.positions(pa.array(sums, pa.binary()), bits)
    held = np.unpackbits(np.frombuffer(twice, "u1"), bitorder="little")
    assert held[spots[:300]].all() and not held[spots[300:700]].all(axis=1).any()


def test_squeeze_keeps_edges():
    assert exact_dedup.squeeze(b"\t a \x0b b\n") == b" a b " and exact_dedup.squeeze(b"\x0c\n") == b" " and exact_dedup.squeeze(b"") == b""
    assert exact_dedup.squeeze("a b".encode()) == "a b".encode()
