import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from psephos.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = []
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        if key is not None and w:
            windows += [(str(key), w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for key, part in windows:
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(key)
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def result(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, n_words string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.contamination(d, b, **options).collect()
    assert all(r.contaminated == (r.n_hit > 0) for r in rows)
    return sorted([(r.doc_id, r.n_words, r.n_hit, sorted(r.items)) for r in rows], key=str)


def test_cases(spark):
    docs = [(1, None), (2, ""), (3, "a b c d e f g h i j k l"), (4, "x A b-C d"), (5, "Été a b c d e f g h i j"), (5, "Été a b c d e f g h i j"), (None, "z q"), (6, "!!"), (7, "z " * 30000 + "q z q")]
    items = [(1, "a b c d e f g h i j"), (2, "z q"), (3, None), (4, ""), (None, "a"), (10, "z q"), (11, "c d e f g h i j k l"), (12, "é"), (13, "q " * 40), (2, "a b c d"), (2, "z q"), (12, "j k l")]
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, docs, items, block_words=12) == brute(docs, items)
    assert result(spark, docs, []) == brute(docs, [])
    assert result(spark, [], items) == []


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab é.", max_size=60), max_size=12), st.lists(st.text("ab é.", max_size=40), max_size=4))
def test_against_brute_force(spark, texts, bench):
    docs, items = list(enumerate(texts)), list(enumerate(bench))
    assert result(spark, docs, items, window=3) == brute(docs, items, 3)


def test_proximity(spark):
    docs = [(1, "one x two y three"), (2, "three two one"), (3, "one x x x x x two three"), (4, "one two")]
    items = [(9, "one two three")]
    found = {d: (hit > 0) for d, _, hit, _ in result(spark, docs, items, window=3, within=5)}
    assert found == {1: True, 2: True, 3: False, 4: False}


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
