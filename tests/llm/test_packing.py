import random
from itertools import combinations

from tallyforge.llm import packing
from tests.llm.conftest import ODD, SF


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_bounds_are_optimal():
    for seed in range(40):
        r = random.Random(seed)
        histogram = {r.randrange(1, 40): r.randrange(1, 9) for _ in range(9)}
        k, lengths = r.randrange(1, 5), sorted(histogram)
        best = min(padding(histogram, (*c, lengths[-1])) for j in range(min(k, len(lengths))) for c in combinations(lengths[:-1], j))
        bounds = packing.bucket_bounds(histogram, k)
        assert len(bounds) <= k and bounds == sorted(bounds) and padding(histogram, bounds) == best
    assert packing.bucket_bounds({}) == []


def held(out, docs, context, budget, buckets):
    rows = out.collect()
    tokens: dict = {}
    for d, t in docs:
        tokens.setdefault(d, []).append(len((t or "").encode().split()) + 1)
    sums: dict = {}
    for r in rows:
        sums.setdefault(r.doc_id, []).append(r.n_tokens)
        assert 1 <= r.n_tokens <= context and r.start_token == r.piece * context and r.padding == r.bucket - r.n_tokens >= 0
    assert {k: sum(v) for k, v in sums.items()} == {k: sum(v) for k, v in tokens.items()}
    assert sorted(sum(sums.values(), [])) == sorted(x for v in tokens.values() for n in v for x in [context] * (n // context) + [n % context] * bool(n % context))
    histogram: dict = {}
    for r in rows:
        histogram[r.n_tokens] = histogram.get(r.n_tokens, 0) + 1
    assert sum(r.padding for r in rows) == padding(histogram, packing.bucket_bounds(histogram, buckets))
    batches: dict = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    open_: dict = {}
    for members in batches.values():
        (bucket,) = {r.bucket for r in members}
        room = max(1, budget // bucket)
        assert sorted(r.slot for r in members) == list(range(len(members))) and len(members) <= room
        open_[bucket] = open_.get(bucket, 0) + (len(members) < room)
    assert all(n <= 1 for n in open_.values())


def test_odd_rows(frame, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 5)
    held(packing.pack(frame(ODD), context=64, token_budget=512, buckets=3), ODD, 64, 512, 3)


def test_empty_table(frame):
    assert packing.pack(frame([])).count() == 0


def test_whole_table(spark, documents):
    held(packing.op4_packing(spark, SF), [(r.doc_id, r.text) for r in documents.collect()], packing.CONTEXT, packing.TOKEN_BUDGET, packing.BUCKETS)


def test_tokenizer_file(frame, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"a": 0, "[UNK]": 1}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "t.json"))
    out = packing.pack(frame([(1, "a, a"), (2, None)]), tokenizer_path=str(tmp_path / "t.json"))
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {1: 4, 2: 1}
