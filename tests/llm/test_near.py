import random
import re

import numpy as np
from pyspark.sql import functions as F

from psephos.llm import near
from psephos.llm.storage import split_by

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = {d: d for d, _ in docs if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            b = docs[j][0]
            if a is None or b is None or not sets[i]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted([(d, len(s), None if d is None else root(d)) for (d, _), s in zip(docs, sets, strict=True)], key=str)


def result(spark, docs, **options):
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id bigint, text string, component long").repartition(3)
    return sorted([tuple(r) for r in near.near_duplicates(d, **options).collect()], key=str)


def test_cases(spark):
    base = " ".join(f"w{i}" for i in range(40))
    docs = [(9, None), (8, ""), (7, "a b"), (6, "A  b"), (5, "b a"), (4, "a b c d e"), (3, "a b c d E"), (None, "a b"), (2, base), (2, base), (1, base + " x"), (11, base.replace("w20", "y")), (12, "é " * 30000), (10, base[:60])]
    assert result(spark, docs) == brute(docs)
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == [(1, 0, 1)]


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "SHORT", 4)
    monkeypatch.setattr(near, "BLOCK", 3)
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    docs = []
    for g in range(8):
        base = [word() for _ in range(rng.randrange(6, 60))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            text = [w if rng.random() > 0.015 * rng.randrange(3) else word() for w in base]
            docs.append((len(docs) * 7 % 1009, " ".join(text + (passage if g % 2 else []))))
    assert len({c for _, _, c in brute(docs)}) > 8
    assert result(spark, docs) == brute(docs)
    assert result(spark, docs, range_bytes=500) == brute(docs)
    monkeypatch.setattr(near, "SPANNED", 8)
    assert result(spark, docs) == brute(docs)
    monkeypatch.setattr(near.classified, "__defaults__", (near.K, 3, 200))  # nearly all clusters are large
    assert result(spark, docs) == brute(docs)
    again = docs + [(docs[0][0], docs[30][1]), (5001, docs[0][1]), (docs[5][0], docs[-1][1]), (5000, docs[5][1]), (5000, docs[5][1])]
    assert result(spark, again) == brute(again)


def test_large_group_meets_in_tiles(spark):
    """A group of more than MEMBERS documents with the production limits; some sets are linked only through few others."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(w if rng.random() > 0.012 else f"x{rng.randrange(9)}" for w in base)) for i in range(near.MEMBERS + 150)]
    docs += [(5000 + k, " ".join(base[: 60 - k])) for k in range(30)] + [(6000 + k, " ".join(base[k:] + [f"y{j}" for j in range(k)])) for k in range(25)]
    assert result(spark, docs) == brute(docs)


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    size = np.sort(rng.integers(20, 4000, 700))
    place = (rng.random(700) * size * 0.3).astype(int)
    order = np.lexsort((place, size))
    size, place = size[order], place[order]
    a, b, skipped = near.spanning(size, place)
    parent = list(range(700))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(np.concatenate(a), np.concatenate(b), strict=True):
        assert near._possible(size[x], place[x], size[y], place[y], near.SHARED - 1)
        parent[root(x)] = root(y)
    for x in range(700):
        for y in np.flatnonzero(near._possible(size[x], place[x], size, place, near.SHARED - 1)):
            assert root(x) == root(y)
    assert skipped > 0


def test_one_id_of_several_texts_is_one_document(spark):
    texts = ["a b c d e f g", "h i j k l m n", "o p q"]
    assert result(spark, [(3, texts[0]), (2, texts[0]), (3, texts[1]), (1, texts[1]), (4, texts[2])]) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (3, 3, 1), (4, 1, 4)]


def stopword_docs(n, words=150):
    """Documents of few frequent words and many words of their own: they share shingles by chance only."""
    rng = random.Random(3)
    return [(i, " ".join(f"s{rng.randrange(4)}" if rng.random() < 0.75 else f"d{i}w{j}" for j in range(words))) for i in range(n)]


def lists_of(spark, docs, n_ranges=3):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    return [r.docs for r in near.index_lists(d, n_ranges).collect()]


def test_chance_meetings_are_not_indexed(spark):
    """What is sent grows with the input, not with its square."""
    docs = stopword_docs(240)
    copies = [(1000 + i, docs[i][1].replace(f"d{i}w", f"c{i}w", 2)) for i in range(20)]
    assert lists_of(spark, docs) == []
    found = lists_of(spark, docs + copies)
    assert found and all({x % 1000 for x in xs} == {xs[0] % 1000} for xs in found)
    assert result(spark, docs + copies) == brute(docs + copies)


def test_promising_sets(spark):
    docs = stopword_docs(60)
    near_copy = (1000, docs[7][1].replace("d7w", "c7w", 2))
    d = spark.createDataFrame([*docs, near_copy, (2000, docs[9][1]), (None, docs[3][1]), (3000, None)], "doc_id bigint, text string").repartition(3)
    found = {r.doc_id for r in near.promising(d, 4).collect()}
    assert {7, 1000} <= found <= {7, 1000, 9, 2000}


def test_rows_are_told_apart_by_their_ids(spark):
    rows = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(3000)], "doc_id bigint, text string")
    ids = spark.createDataFrame([(i,) for i in range(5, 3000, 7)], "d bigint")
    told = {r.doc_id: r._maybe for r in split_by(rows, F.col("doc_id"), ids).collect()}
    assert all(told[i] for i in range(5, 3000, 7)) and sum(told.values()) < 450 and not told[None]
