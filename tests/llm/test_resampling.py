import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from psephos.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    every = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in every for b in f), Counter(b for x in target for b in features(x)[1])
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000)))) for b in range(10_000)}
    rows = []
    for d, n, f in every:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in rows]


WORDS = st.lists(st.sampled_from(["a", "The", "é", "x" * 31, "y" * 32, "z" * 33, "Q" * 1000, "日本語", ".", "7", "\n"]), max_size=12).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), st.sampled_from([1, 3, 1 << 17]))
def test_buckets_are_those_of_the_strings(texts, block):
    import pyarrow as pa

    before, resampling.BLOCK_WORDS = resampling.BLOCK_WORDS, block
    try:
        found, counts = {}, []
        for _, n_words, runs in resampling.text_runs(iter([pa.record_batch({"text": pa.array(texts)})]), 10_000):
            counts += n_words.tolist()
            for bucket, doc in runs:
                for b, d in zip(bucket.tolist(), doc.tolist(), strict=True):
                    found.setdefault(d, []).append(b)
    finally:
        resampling.BLOCK_WORDS = before
    assert counts == [features(t)[0] for t in texts]
    assert [sorted(found.get(k, [])) for k in range(len(texts))] == [sorted(features(t)[1]) for t in texts]


def test_same_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, "a b"), (None, "w1 w2 " * 20), (-4, "long " * 200_000), (-5, "same words here " * 9), (-5, "same words here " * 9), (-6, "same words here " * 9)]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, score string")
    found = resampling.resampled(frame, spark.createDataFrame([(x,) for x in items], "text string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_draw_follows_the_target(spark):
    docs = [(i, ("apple pear plum " if i % 10 == 0 else "iron zinc lead ") * 10 + f"n{i}") for i in range(400)]
    rows = resampling.resampled(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("apple pear plum",)], "text string"), percent=10).collect()
    drawn = [r for r in rows if r["rank"] is not None]
    assert sorted(r["rank"] for r in drawn) == list(range(1, 41)) and all(r.doc_id % 10 == 0 for r in drawn)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resampled(none, none).collect() == []
    assert (resampling.gains(np.zeros(5, np.int64), np.zeros(5, np.int64)) == 0).all()
    one = resampling.resampled(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), none).collect()
    assert [(r.n_features, r["rank"]) for r in one] == [(1, None)]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000])
def test_zero_bytes(n):
    state = np.array([0xFFFFFFFF, 1, 0x12345678], np.uint32)
    out = resampling.shifted(state, np.full(3, n))
    assert [int(x) for x in out] == [zlib.crc32(bytes(n), int(s) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for s in state]
