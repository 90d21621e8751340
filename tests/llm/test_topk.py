import math
import random
from fractions import Fraction

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from psephos.llm import topk


def brute(data, k):
    usable = [(n, i, [math.floor(float(np.float32(x)) * 1024) for x in v]) for n, (i, v) in enumerate(data) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, m) for m, j, v in usable if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scores[:k])]
    return sorted(out)


def result(spark, data, kind="float", **options):
    d = spark.createDataFrame([(i, v, 1) for i, v in data], f"vec_id bigint, embedding array<{kind}>, row int").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(d, F.col("vec_id") % 100 == 0, **options).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(450)]
    data += [(i, [0.25] * 8) for i in range(1000, 1040)] + [(600, None), (700, [None] * 8), (800, [float("nan")] * 8), (900, [float("inf")] * 8), (None, [1.0] * 8), (1100, [1.0]), (1101, [2.0]), (1200, []), (1201, []), (300, [0.5] * 8)]
    assert result(spark, data) == brute(data, 10)
    assert result(spark, data, shard=7, block=2, k=3) == brute(data, 3)


def test_cases(spark):
    assert result(spark, []) == []
    assert result(spark, [(100, [1.0])]) == []
    big = [(i, [1e4 * (i + 1), -1e4]) for i in range(0, 300, 100)]
    assert result(spark, big) == brute(big, 10)


def test_large_components(spark):
    data = [(0, [1.0, 5e12]), (1, [3.0, -2e13]), (2, [1e300, 1e308]), (3, [1e300, 1.1e308]), (100, [-1e308, 2.0]), (4, [0.5, 0.25]), (5, [2.0**60, 1.0]), (200, [2.0**43, -(2.0**43)]), (6, [2.0**43, 2.0**43])]
    usable = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in data]
    wanted = []
    for i, q in usable:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i)
            wanted += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores)]
    assert result(spark, data, "double") == sorted(wanted)
    assert result(spark, data, "double", shard=2, block=1) == sorted(wanted)


def test_grid():
    for shards, blocks, cells in [(13, 1, 8), (1, 1, 8), (1000, 40, 2500), (3, 7, 100), (244141, 9766, 10**6)]:
        rows, columns = topk.grid(shards, blocks, 4096, 1024, cells)
        assert 1 <= rows <= shards and 1 <= columns <= blocks and min(cells, shards * blocks) <= rows * columns
    assert topk.grid(100, 100, 1000, 1000, 100) == (10, 10)


@given(st.lists(st.integers() | st.integers(-(2**70), 2**70) | st.integers(-(2**63) - 3, -(2**63) + 3), max_size=30))
def test_sortable(numbers):
    key = lambda x: (lambda score, length, digits: (length, digits, score))(*topk.sortable(x))
    assert sorted(numbers, key=key) == sorted(numbers)
