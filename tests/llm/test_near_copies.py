import collections
import itertools
import math
import random

import pytest
import xxhash

import corpus_pipeline
from tallyforge.llm import near_copies
from tests.llm.conftest import ODD, SF


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def shingle_set(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def prints(text):
    """Two words of 64 bits: by words, each weighted by the root of its number in whole 1024ths."""
    counts = collections.Counter(words_of(text))
    weights = {int.from_bytes(xxhash.xxh3_128_digest(w, 42), "little"): math.floor(math.sqrt(n) * 1024) for w, n in counts.items()}
    bits = sum(1 << b for b in range(128) if 2 * sum(x for h, x in weights.items() if h >> b & 1) > sum(weights.values()))
    return bits & (2**64 - 1), bits >> 64


def alike(a, b):
    return len(a & b) ** 2 * 25 >= 16 * len(a) * len(b)


class Joined:
    def __init__(self, n):
        self.up = list(range(n))

    def __call__(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        self.up[self(i)] = self(j)


def brute(docs):
    """Groups of rows: fingerprints near in both words hang together as clusters, and in these exact similarity links."""
    sets, both = [shingle_set(t) for _, t in docs], [prints(t) for _, t in docs]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    check = {f: min((c for g, c in both if g == f), key=signed) for f, _ in both}
    clusters, groups = Joined(len(docs)), Joined(len(docs))
    for i, j in itertools.combinations(range(len(docs)), 2):
        f, g = both[i][0], both[j][0]
        if (f ^ g).bit_count() <= near_copies.BITS_APART and (check[f] ^ check[g]).bit_count() <= near_copies.CHECK_APART:
            clusters.join(i, j)
    for i, j in itertools.combinations(range(len(docs)), 2):
        if clusters(i) == clusters(j) and alike(sets[i], sets[j]):
            groups.join(i, j)
    out: dict = {}
    for i, row in enumerate(docs):
        out.setdefault(groups(i), []).append(row)
    return out.values()


def holds(kept, docs):
    groups = list(brute(docs))
    assert len(kept) == len(groups)
    for group in groups:
        ids = [d for d, _ in group if d is not None]
        mine = [r for r in kept if r in group]
        assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)


def edited(seed):
    """Texts with copies on both sides of 0.8."""
    r = random.Random(seed)
    out = []
    for i in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice((30, 60, 300)))]
        out.append((i, " ".join(words)))
        for c in range(3):
            copy = list(words)
            for p in r.sample(range(len(copy)), max(1, len(copy) * r.randrange(1, 7) // 100)):
                copy[p] = f"e{r.randrange(99)}"
            out.append((1000 * (c + 1) + i, " ".join(copy)))
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_stage_equals_brute_force(spark, frame, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "LEADERS", 2)
    docs = edited(block) + ODD
    holds([(r.doc_id, r.text) for r in corpus_pipeline.near_copy_stage(spark, frame(docs), SF).collect()], docs)


def test_one_large_chain_in_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    monkeypatch.setattr(near_copies, "LEADERS", 4)
    r = random.Random(3)
    words, docs = [f"w{i}" for i in range(200)], []
    for i in range(40):
        words[r.randrange(200)] = f"e{i}"
        docs.append((i, " ".join(words)))
    holds([(x.doc_id, x.text) for x in corpus_pipeline.near_copy_stage(spark, frame(docs), SF).collect()], docs)


def test_rows_leave_only_because_of_their_own_text(spark, frame):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    docs = [(1, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (7, text("a")), (7, text("e"))]
    kept = sorted(r.text[0] for r in corpus_pipeline.near_copy_stage(spark, frame(docs), SF).collect())
    assert kept == ["a", "b", "c", "d", "e"]


def test_prints_equal_a_plain_reference(documents):
    texts = [t for _, t in ODD] + [r.text for r in documents.limit(40).collect()]
    found = near_copies.WordPrints()
    assert [found((t or "").encode()) for t in texts] == [prints(t) for t in texts]


def test_edited_copies_are_found_and_others_kept(spark, frame):
    """Of copies with edits in 2 of 100 words, nearly all; of other texts, none."""
    r = random.Random(11)
    docs = []
    for i in range(60):
        words = [f"w{int(r.paretovariate(0.9)) % 3000}" for _ in range(300)]
        docs.append((i, " ".join(words)))
        for p in r.sample(range(300), 6):
            words[p] = f"edited{r.randrange(50)}"
        docs.append((1000 + i, " ".join(words)))
    kept = {x.doc_id for x in corpus_pipeline.near_copy_stage(spark, frame(docs), SF).collect()}
    assert set(range(60)) <= kept and len(kept) <= 66


def test_long_chains_do_not_join_strangers(spark, frame):
    """Texts that share words but no order of them stay apart, however near their fingerprints are."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(r.sample(words, 100))) for i in range(30)]
    assert corpus_pipeline.near_copy_stage(spark, frame(docs), SF).count() == 30


def test_empty_table(spark, frame):
    none = corpus_pipeline.near_copy_stage(spark, frame([]), SF)
    assert none.count() == 0 and none.columns == frame([]).columns


def test_documents_equal_brute_force(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    holds([(r.doc_id, r.text) for r in corpus_pipeline.near_copy_stage(spark, documents, SF).collect()], docs)
