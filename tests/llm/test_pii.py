import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from psephos.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda digits=digits: 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": lambda digits=digits: 8 <= len(digits) <= 15,
            }
            if checks[kind]():
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab@.12 +-()é%", max_size=40))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "@a" * 100_000, "+1" + "(" * 200_000, "1 " * 100_000):
        pii.base_spans(text)


def test_luhn_and_cards():
    assert pii.luhn("4532015112830366") and not pii.luhn("4532015112830367")
    assert pii.base_spans("x 4532 0151 1283 0366 y") == [("card", 2, 21)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, row string")


def test_patterns_find_unseen_identifiers(spark):
    docs = [(i, f"word{i} please write to user{i}@mail.example.com today, or see chapter {i}") for i in range(30)]
    docs += [(100, "then write to someone@intranet today, if"), (101, "the ratio was some@thing of it"), (102, "call 5551234567 now")]
    rows = {r.doc_id: r for r in pii.personal_data(frame(spark, docs)).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[100].found] == [("email", 14, 30)]
    assert not rows[101].found and not rows[102].found
    assert all(not rows[i].found and len(rows[i].base) == 1 for i in range(30))
    text = pii.redacted(frame(spark, docs[:1]), pii.personal_data(frame(spark, docs[:1]))).first().text
    assert text == "word0 please write to <email> today, or see chapter 0"


def test_cases(spark):
    docs = [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (None, "1.2.3.4"), (4, "é 1.2.3.4 " * 20000)]
    rows = pii.personal_data(frame(spark, docs)).collect()
    assert sorted(len(r.base) for r in rows) == [0, 0, 1, 1, 1, 20000]
    assert pii.personal_data(frame(spark, [])).collect() == []


def brute_scores(docs, rounds, support):
    """The graph's scores, written as plain loops."""
    count = {}
    for _, text in docs:
        for p in pii.text_places(text or "")[1]:
            for pattern in p["patterns"]:
                key = (pattern, p["kind"], p["value"])
                count[key] = count.get(key, 0) + 1
    values = {}
    for pattern, _, value in count:
        values.setdefault(pattern, set()).add(value)
    edges = {e: math.log1p(n) for e, n in count.items() if len(values[e[0]]) >= support}
    total, good, seeds = {}, {}, {}
    for (pattern, kind, _), w in edges.items():
        total[pattern] = total.get(pattern, 0) + w
        if kind:
            good[pattern, kind] = good.get((pattern, kind), 0) + w
            seeds[pattern, kind] = seeds.get((pattern, kind), 0) + 1
    scores = {k: g / (total[k[0]] + pii.PRIOR) for k, g in good.items()}
    for _ in range(rounds - 1):
        up, down = {}, {}
        for (pattern, kind, value), w in edges.items():
            for (other, k), x in scores.items():
                if not kind and other == pattern:
                    up[value, k] = up.get((value, k), 0) + w * x
                    down[value, k] = down.get((value, k), 0) + w
        now = dict(good)
        for (pattern, kind, value), w in edges.items():
            for (v, k), x in up.items():
                if not kind and v == value:
                    now[pattern, k] = now.get((pattern, k), 0) + w * x / down[v, k]
        scores = {k: g / (total[k[0]] + pii.PRIOR) for k, g in now.items()}
    return {k: (round(x, 6), seeds.get(k, 0)) for k, x in scores.items()}


HEX = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(200)]


def secrets():
    docs = [(i, f"ab{i} cd token = \"{HEX[i]}\" ef{i}") for i in range(40)]
    docs += [(100 + i, f"some w{i}x password={HEX[i + 50][:18]} and {HEX[i + 50][:9]}") for i in range(30)]
    docs += [(200 + i, f"the key AKIA{'ABCDEFGH'[i] * 16} works") for i in range(8)]
    docs += [(300 + i, f"at page={i + 10000} or id: part{i}a of commit {HEX[i + 100]}") for i in range(30)]
    return docs


def test_scores_against_brute_force(spark):
    docs = secrets() + [(900 + i, f"write to user{i % 7}@mail.example.com today or to x{i}@intra today") for i in range(12)]
    places = pii.occurrences(frame(spark, docs)).select(F.explode("places").alias("p")).select("p.*")
    for rounds in (1, 2, 4):
        got = {(r.pattern, r.kind): (round(r.score, 6), r.seeds) for r in pii.pattern_scores(places, rounds).collect()}
        assert got == brute_scores(docs, rounds, pii.SUPPORT) and got


def test_secrets_of_another_name_are_found_by_their_shape(spark):
    """Seeds are tokens and keys only; passwords are reached through the pattern of sign and shape."""
    rows = {r.doc_id: r for r in pii.personal_data(frame(spark, secrets())).collect()}
    texts = dict(secrets())
    for i, r in rows.items():
        spans = [texts[i][s.start : s.end] for s in r.found if s.kind == "secret"]
        if i < 40:
            assert spans == [HEX[i]]
        elif i < 200:
            assert spans == [HEX[i - 100 + 50][:18]]
        elif i < 300:
            assert spans == [f"AKIA{'ABCDEFGH'[i - 200] * 16}"]
        else:
            assert spans == []


def test_long_words_and_values_take_linear_time():
    for text in ("x=1;" * 50_000, "a1b2" * 50_000, "token = \"" + "a1" * 100_000 + "\"", "1=" * 100_000, "a" * 100_000 + " =1a2b3c4d5e6f7a8b9c "):
        pii.text_places(text)


def test_found_on_the_table(spark):
    """Every planted credential of the table is found, and no other place is taken for one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    n = 0
    for r in docs.collect():
        wanted = [m.span(1) for m in re.finditer("token = \"([0-9a-f]{40})\"", r.text or "")]
        n += len(wanted)
        assert [(s.start, s.end) for s in rows[r.doc_id].found] == wanted
    assert n > 0
