import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tallyforge.llm import simhash
from tallyforge.llm.common import Scratch
from tallyforge.llm.components import connected_components
from tests.llm.conftest import ODD, SF


def reference(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    cut = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in cut]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, apart):
    """prints: a set of fingerprints per row. Rows are linked if any of their fingerprints are near."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if any((a ^ b).bit_count() <= apart for a in prints[i] for b in prints[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def expected(docs, apart=2, k=3):
    prints = [{simhash.fingerprint((t or "").encode(), k)} for _, t in docs]
    found = groups(prints, apart)
    least = {g: min((d for (d, _), x in zip(docs, found, strict=True) if x == g and d is not None), default=None) for g in found}
    return sorted(repr((d, least[g])) for (d, _), g in zip(docs, found, strict=True))


def near_copies(n, seed=0):
    r = random.Random(seed)
    words = [f"w{r.randrange(400)}" for _ in range(400)]
    out = []
    for i in range(n):
        edited = list(words)
        for _ in range(r.randrange(0, 3)):
            edited[r.randrange(400)] = f"e{r.randrange(9)}"
        out.append((100 + i, " ".join(edited)))
    return out


def got(df, **more):
    return sorted(repr((r.doc_id, r.component_id)) for r in simhash.simhash_groups(df, **more).collect())


def test_fingerprints_equal_a_plain_reference(documents):
    texts = [t for _, t in ODD[:-1]] + [r.text for r in documents.limit(40).collect()] + ["a b", "a  B\tc", "one"]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == [reference(t) for t in texts]


def test_odd_rows(frame):
    assert got(frame(ODD)) == expected(ODD)


@pytest.mark.parametrize(("apart", "hot"), [(2, 64), (2, 2), (4, 64), (3, 2), (6, 3)])
def test_near_copies_equal_brute_force(frame, monkeypatch, apart, hot):
    monkeypatch.setattr(simhash, "HOT_TIMES", 0)
    docs = near_copies(60, seed=apart + hot) + ODD
    assert got(frame(docs), bits_apart=apart, hot_bucket=hot) == expected(docs, apart)


@pytest.mark.parametrize("hot", [64, 1])
def test_second_words_of_fingerprints_are_verified(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_TIMES", 0)
    r = random.Random(hot)
    first = [r.getrandbits(64) for _ in range(6)]
    rows = {(x := f ^ sum(1 << b for b in r.sample(range(64), r.randrange(5)))): r.choice((0, 3, 2**63)) for f in first for _ in range(12)}
    scratch = Scratch(spark)
    prints = scratch.save(spark.createDataFrame([(simhash._signed(f), simhash._signed(c)) for f, c in rows.items()], "fp long, check long"))
    edges = simhash.links(prints, len(rows), 4, scratch, hot, check_apart=1)
    found = {x.node: x.root for x in connected_components(edges, scratch).collect()}
    near = [(a, b) for a, b in itertools.combinations(rows, 2) if (a ^ b).bit_count() <= 4 and (rows[a] ^ rows[b]).bit_count() <= 1]
    parent = {f: f for f in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in near:
        parent[find(a)] = find(b)
    signed = simhash._signed
    for a, b in itertools.combinations(rows, 2):
        assert (find(a) == find(b)) == (found.get(signed(a), signed(a)) == found.get(signed(b), signed(b)))


def test_empty_table(frame):
    assert got(frame([])) == []


def test_whole_table_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    out = simhash.op1_simhash(spark, SF).collect()
    assert sorted(repr((r.doc_id, r.component_id)) for r in out) == expected(rows)
    texts = dict(rows)
    assert all(r.fingerprint == f"{reference(texts[r.doc_id]):016x}" for r in out)


def test_allocation_is_the_cheapest_of_all():
    r = np.random.default_rng(4)
    for apart, m in itertools.product((2, 3, 4), (1, 2, 3, 4)):
        together = np.diag(r.integers(1, 1000, 64)).astype(float)
        bits, differ, n = simhash.group_bits(together, m), r.uniform(0.05, 0.5, 64), int(r.integers(10, 10**7))

        def cost(thresholds):
            total = 0.0
            for group, t in zip(bits, thresholds, strict=True):  # noqa: B023
                if t >= 0:
                    total += simhash.KEY_COST * n * (1 + simhash.ball(len(group), t)) + simhash.CANDIDATE_COST * n * n * simhash.near_chance(differ[group], apart)[t]  # noqa: B023
            return total

        best = min(cost(t) for t in itertools.product(range(-1, apart + 1), repeat=m) if sum(t) == apart - m + 1)
        found, chosen = simhash.allocate(bits, differ, n, apart)
        assert sum(chosen) == apart - m + 1 and found == pytest.approx(best) == cost(chosen)


def test_thresholds_by_pigeonhole_miss_no_pair():
    r = random.Random(5)
    together = np.eye(64)
    for m, thresholds in ((3, (0, 0, 0)), (3, (1, 0, -1)), (2, (1, 0)), (2, (2, -1)), (1, (2,))):
        groups_ = simhash.group_bits(together, m)
        assert sorted(sum(groups_, [])) == list(range(64))
        for _ in range(300):
            flips = set(r.sample(range(64), r.randrange(3)))
            assert any(len(flips & set(g)) <= t for g, t in zip(groups_, thresholds, strict=True))


def test_correlated_bits_share_a_group():
    r = np.random.default_rng(6)
    bits = r.integers(0, 2, (2000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 41] = bits[:, 3]
    together = (bits.T @ bits).astype(float)
    assert any({3, 40, 41} <= set(g) for g in simhash.group_bits(together, 3))


def test_chance_of_near_values():
    q = np.array([0.1, 0.5, 0.3])
    every = [(sum(x), np.prod([p if b else 1 - p for b, p in zip(x, q, strict=True)])) for x in itertools.product((0, 1), repeat=3)]
    assert simhash.near_chance(q, 2) == pytest.approx([sum(p for n, p in every if n <= t) for t in range(3)])


def test_blocks_of_long_texts_give_the_same_shingles():
    r = random.Random(12)
    text = b"".join(r.choice([b"a", b"bc", b" ", b"\t", b"\n ", b"D"]) for _ in range(400))
    words = text.lower().split()
    for k, block in itertools.product((1, 2, 3, 5), (1, 7, 50, 10_000)):
        got = [s for part in simhash.shingles(text, k, block) for s in part]
        assert got == [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    assert [s for part in simhash.shingles(b" one  two ", 3, 2) for s in part] == [b"one two"] and list(simhash.shingles(b" \n", 3, 1)) == []
