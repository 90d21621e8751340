import random

import pytest

from psephos.llm import components


@pytest.mark.parametrize("few", [0, 20, 1 << 18], ids=["rounds only", "rounds, then one task", "one task"])
def test_against_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3), (999, 500), (999, 998), (999, 999)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()
    assert sorted((r.node, r.component) for r in found) == sorted((x, root(x)) for x in parent)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
