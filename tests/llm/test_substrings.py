import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from psephos.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, width):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def result(spark, docs, width, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, block string")
    rows = substrings.repeated_substrings(d, width, **options).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in rows], key=str)


def test_cases(spark):
    docs = [(1, None), (2, ""), (3, "a b c d e"), (4, "x\ta b\nc d"), (5, "é f g"), (5, "é f g"), (None, "q q q q q q"), (6, "\x1c \x85 u\xa0v"), (7, "r s " * 20000)]
    for size in (8, 1 << 20):
        assert result(spark, docs, 3, block_bytes=size) == brute(docs, 3)
    assert result(spark, [], 3) == []
    assert result(spark, [(1, None)], 3) == brute([(1, None)], 3)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25).map(" ".join), max_size=10))
def test_against_brute_force(spark, texts):
    docs = list(enumerate(texts))
    assert result(spark, docs, 4, block_bytes=50) == brute(docs, 4)
