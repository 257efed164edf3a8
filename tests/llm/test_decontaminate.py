import re

import pytest

from tallyforge.llm import decontaminate
from tests.llm.conftest import ODD, SF, rows

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
ITEMS = [(1, ITEM), (2, "tiny item"), (3, None), (4, ""), (None, "nameless item of several plain words"), (5, "one"), (6, "rho sigma tau"), (6, "rho sigma tau upsilon phi chi psi"), (7, "same " * 50)]
DOCS = [*ODD, (1, "Before. " + ITEM.title().replace(" ", ", ") + " after"), (2, ITEM.replace("alpha", "omega")), (3, ITEM.replace("theta", "omega")), (4, "some tiny item, one"), (13, "sigma tau upsilon phi chi psi rho sigma tau"), (14, "same " * 9), (15, "x " * 50_000 + ITEM + " y" * 50_000)]


def brute(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w, k: {(k, *w[i : i + k]) for i in range(len(w) - k + 1)}
    of: dict = {}
    for i, t in items:
        if w := cut(t):
            of.setdefault(i, set()).update(grams(w, min(5, len(w))))
    held: dict = {}
    for d, t in docs:
        w = cut(t)
        held.setdefault(d, set()).update(*(grams(w, k) for k in range(1, 6)))
    return sorted(repr((d, i, len(g), len(g & h), len(g & h) / len(g))) for d, h in held.items() for i, g in of.items() if 5 * len(g & h) >= 4 * len(g))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_ROWS, 0])
def test_odd_rows(frame, items, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    got = decontaminate.contaminated(frame(DOCS), items)
    assert sorted(repr((r.doc_id, r.item_id, r.n_item, r.n_common, r.containment)) for r in got.collect()) == brute(DOCS, ITEMS)


def test_empty_tables(spark, frame, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame([]), items).count() == 0
    assert decontaminate.contaminated(frame(DOCS), none).count() == 0
    assert decontaminate.drop_contaminated(frame(DOCS), none).count() == len(DOCS)


def test_clean_documents_stay_whole(frame, items):
    found = {eval(x)[0] for x in brute(DOCS, ITEMS)}
    kept = decontaminate.drop_contaminated(frame(DOCS), items)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(d) for d, _ in DOCS if d not in found)
    assert kept.columns == frame([]).columns


def test_a_sketch_is_met_by_every_document_with_enough(items):
    import itertools

    held = decontaminate.item_shingles(items).where("item_id = 1").collect()
    n, sketch = held[0].n_item, {r.shingle for r in held if r.in_sketch}
    need = -(-n * 4 // 5)
    every = [r.shingle for r in held]
    assert all(sketch & set(some) for some in itertools.combinations(every, need)) and len(sketch) < n


def test_whole_table_equals_sql(spark, oracle):
    assert rows(decontaminate.op10_decontaminate(spark, SF).toPandas()) == rows(oracle(decontaminate.OP10_SQL))


def test_no_python_on_the_path(documents, items, plans):
    assert plans(decontaminate.contaminated(documents, items), 2)


def test_rows_are_dropped_for_their_own_text_only(frame, items):
    half = len(ITEM.split()) // 2 + 2
    parts = [" ".join(ITEM.split()[:half]), " ".join(ITEM.split()[half - 4 :])]
    docs = [(None, f"so {ITEM} then"), (None, "a clean text of some words"), (7, f"{ITEM} again"), (7, "clean as well, all of it"), (8, parts[0]), (8, parts[1]), (None, None)]
    kept = decontaminate.drop_contaminated(frame(docs), items).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == sorted(map(repr, [docs[1], *docs[3:]]))
