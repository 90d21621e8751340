import math
import random

import numpy as np

from psephos.llm import langid

STEMS = {"aa": ["tala", "kalo", "mita"], "bb": ["stron", "gruft", "blind"], "cc": ["ézou", "çéla", "oué"]}


def rows(n, langs, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(langs)
        out.append((i, " ".join("".join(rng.choices(STEMS[lang], k=2)) for _ in range(rng.randrange(3, 40))), lang, "x"))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, score string")


def test_held_out_accuracy(spark):
    data = rows(400, list(STEMS))
    d = frame(spark, data)
    found = {r.doc_id: r for r in langid.identify(d).collect()}
    held = [r.doc_id for r in d.where(langid.held_out()).collect()]
    assert len(held) > 50
    assert np.mean([found[i].lang_pred == data[i][2] for i in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in found.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    data = rows(200, list(STEMS))
    d = frame(spark, data)
    held = {r.doc_id for r in d.where(langid.held_out()).collect()}
    other = frame(spark, [(i, t, "cc" if i in held else lang, s) for i, t, lang, s in data])
    answers = [sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in langid.identify(x).collect()) for x in (d, other)]
    assert answers[0] == answers[1]


def test_cases(spark):
    data = rows(60, ["aa", "bb"]) + [(100, None, "aa", ""), (101, "", "aa", ""), (102, "12 34 !", "bb", ""), (103, "tala", None, ""), (None, "tala", "bb", ""), (104, "tala " * 50000, "aa", ""), (104, "tala " * 50000, "aa", "")]
    found = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(frame(spark, data)).collect()]
    assert len(found) == len(data)
    got = dict((i, p) for i, p, _ in found)
    assert [got[i] for i in (100, 101, 102, 104)] == ["und", "und", "und", "aa"]
    assert langid.identify(frame(spark, [])).collect() == []
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "a", None, "")])).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "abc", "xx", ""), (3, "d", "xx", "")])).collect()} == {"xx"}


def test_codewords():
    for n in (2, 3, 4, 5, 8, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert (np.abs(code.sum(0)) < n).all()


def test_decoding_against_plain_loops():
    rng = np.random.default_rng(3)
    code = langid.codewords(5)
    bits = code.shape[1]
    margin, centre, scale = rng.normal(size=(7, bits)), rng.normal(size=bits), rng.uniform(0.5, 2, bits)
    right = rng.uniform(0.5, 1, (5, bits))
    found = langid.decode(margin, code.astype(float), centre, scale, right)
    for row, got in zip(margin, found, strict=True):
        losses = []
        for c, r in zip(code, right, strict=True):
            total = sum(r)
            losses.append(sum(math.log1p(math.exp(-2 * (x - m) / s * b)) * w / total * bits for x, m, s, b, w in zip(row, centre, scale, c, r, strict=True)))
        weights = [math.exp(min(losses) - x) for x in losses]
        assert np.allclose(got, [w / sum(weights) for w in weights])


def test_rare_languages_are_learned(spark):
    """A language of few rows is sampled whole beside one of many, at any sample size."""
    docs = [(i, f"the of and to in {i}", "en") for i in range(3000)] + [(5000 + i, "und der die das ist nicht", "de") for i in range(12)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    counts = langid.gram_counts(rows, 100)
    assert set(counts) == {"en", "de"} and all(c.sum() > 0 for c in counts.values())
    assert langid.gram_counts(rows, 100)["de"].sum() == langid.gram_counts(rows.where("lang = 'de'"), 10**6)["de"].sum()
