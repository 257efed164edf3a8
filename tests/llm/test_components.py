import random

import pytest

from tallyforge.llm import components
from tallyforge.storage import Scratch


@pytest.mark.parametrize(("n", "m", "fold"), [(40, 30, 7), (60, 200, 10), (50, 49, 3)])
def test_components_equal_union_find(spark, monkeypatch, n, m, fold):
    monkeypatch.setattr(components, "FOLD_EDGES", fold)
    r = random.Random(n)
    edges = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(r.randrange(n) - n // 2, r.randrange(n) - n // 2) for _ in range(m)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {x.node: x.root for x in components.connected_components(df, Scratch(spark)).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0
