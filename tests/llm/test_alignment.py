import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from psephos.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.TOKENIZER_A, alignment.TOKENIZER_B)


def token_bytes(pair, text):
    """Both tokenizations of a text as lists of (id, bytes), decoded a token at a time; None where they don't spell it."""
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in pair.a.id_to_token(i))) for i in pair.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in pair.b.encode(text):
        piece = pair.b.id_to_piece(i)
        b.append((i, bytes([int(piece[1:-1], 0)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()))
    wanted = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == wanted for side in (a, b)) else None


def groups_of(pair, text):
    """Groups as lists of A and B ids, by plain loops over ends."""
    both = token_bytes(pair, text) if text else None
    if both is None:
        return []
    ends = []
    for side in both:
        at, out = 0, {}
        for k, (_, x) in enumerate(side):
            at += len(x)
            out[at] = k
        ends.append(out)
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0][end] + 1, ends[1][end] + 1
        groups.append(([t for t, _ in both[0][i:p]], [t for t, _ in both[1][j:q]]))
        i, j = p, q
    return groups


def brute(pair, docs):
    every = [(d, groups_of(pair, t)) for d, t in docs]
    counts = Counter((a[-1], b[-1]) for _, groups in every for a, b in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, groups in every:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        ns = [(counts[a[-1], b[-1]], best[b[-1]]) for a, b in groups]
        out.append((d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(groups), sum(n == m for n, m in ns), sum(n for n, _ in ns), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


ODD = ["the", " ", " ", "  ", "\u00a0", "\u2003", "\u3000", "\x85", "\n", "▁", "é", "日本", "<s>", "<|endoftext|>", "<0x41>", "'s", "12", " ", "\U0001f600", "\x00", "a.b", "\t", "ing", "\x1c"]


def of_texts(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=14).map("".join), max_size=3))
def test_segments_have_the_tokens_of_the_whole_text(pair, texts):
    room, starts, first = alignment.segments(*of_texts(texts))
    parts = [room[i:j].tobytes().decode() for i, j in zip(starts[:-1], starts[1:], strict=True)]
    for k, text in enumerate(texts):
        own = parts[first[k] : first[k + 1]]
        assert "".join(own) == (" " + text if text else "")
        if text and "▁" not in text:
            whole, cut = pair.encoded([" " + text]), pair.encoded(own)
            assert [[i for x in lists for i in x] for lists in cut] == [lists[0] for lists in whole]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=10).map("".join), max_size=4), st.sampled_from([1, 20, 1 << 22]))
def test_groups_and_overlaps(pair, texts, encode):
    found, bad = {}, set()
    for docs, x, good in alignment._alignments(pair, *of_texts(texts), encode):
        text, first = alignment.group_text(x, pair.digits)
        for k, doc in enumerate(docs.tolist()):
            bad |= set() if good[k] else {doc}
            inside = (x.over_a >= x.a_first[k]) & (x.over_a < x.a_first[k + 1])
            overlaps = list(zip((x.over_a[inside] - x.a_first[k]).tolist(), (x.over_b[inside] - x.b_first[k]).tolist(), strict=True))
            found.setdefault(doc, []).append((text[first[k] : first[k + 1]].tobytes().decode(), overlaps, x.a_first[k + 1] - x.a_first[k], x.b_first[k + 1] - x.b_first[k]))
    for k, t in enumerate(texts):
        both = token_bytes(pair, t) if t else None
        assert (k in bad) == bool(t and both is None)
        if both:
            assert "".join(x[0] for x in found[k]) == "".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";" for a, b in groups_of(pair, t))
            owners = [[n for n, (_, b) in enumerate(side) for _ in b] for side in both]
            i = j = 0
            pairs = []
            for _, overlaps, n_a, n_b in found[k]:
                pairs += [(a + i, b + j) for a, b in overlaps]
                i, j = i + n_a, j + n_b
            assert pairs == list(dict.fromkeys(zip(*owners, strict=True)))


def docs_of(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(-1, None), (-2, ""), (-3, " "), (-4, "a▁b"), (-5, "".join(ODD) * 3), (-6, "x " * 70_000 + "y"), (-6, "x " * 70_000 + "y"), (None, "ab"), (-7, "ß" * 5000)]
    return rows + odd


@pytest.mark.parametrize("block_pairs", [alignment.BLOCK_PAIRS, 3000])
def test_same_as_brute_force(spark, pair, block_pairs):
    docs = docs_of(spark)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, row int")
    found = alignment.link_support(frame, block_pairs=block_pairs, encode=1000 if block_pairs == 3000 else alignment.ENCODE)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(pair, docs), key=str)


def test_alignments(spark, pair):
    docs = [(1, "The unbelievable  <s> word"), (2, None), (3, "a▁b")]
    rows = {r.doc_id: r for r in alignment.alignments(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert not rows[2].a and not rows[3].groups
    r, i, j, out = rows[1], 0, 0, []
    for g in r.groups:
        out.append((r.a[i : g.a], r.b[j : g.b]))
        i, j = g.a, g.b
    assert out == groups_of(pair, docs[0][1]) and len(r.overlaps) >= len(r.groups)


def test_empty(spark):
    assert alignment.link_support(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
