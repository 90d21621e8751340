import random

import pytest

from psephos.operators import identity

TIERS = ["full", "last"]


def brute(left, right, accepted, rejected, rounds):
    """Rounds over a graph whose edges are written out."""
    pairs = {(a, b) for a, b in accepted if sum(x == a for x, _ in accepted) == 1 and sum(y == b for _, y in accepted) == 1}
    clash = {a for a, _ in accepted} - {a for a, _ in pairs}
    found = {a: (b, "reviewed", 0) for a, b in pairs}
    used = {b for _, b in pairs}
    edges = {(a[0], b[0], t) for a in left for b in right for t, _ in enumerate(TIERS) if a[1] == b[1] and a[2 + t] and a[2 + t] == b[2 + t] and (a[0], b[0]) not in rejected}
    edges = {e for e in edges if e[0] not in found and e[0] not in clash and e[1] not in used}
    for k in range(1, rounds + 1):
        best = lambda side: {n: min(e[2] for e in edges if e[side] == n) for n in {e[side] for e in edges}}
        low = best(0), best(1)
        alone = [e for e in edges if all(e[2] == low[s][e[s]] and sum(x[s] == e[s] and x[2] == e[2] for x in edges) == 1 for s in (0, 1))]
        if not alone:
            break
        for a, b, t in alone:
            found[a] = (b, TIERS[t], k)
        edges = {e for e in edges if e[0] not in found and e[1] not in {v[0] for v in found.values()}}
    return found


@pytest.mark.parametrize("seed", [1, 3])
def test_rounds_are_those_of_the_written_graph(spark, seed):
    rng = random.Random(seed)
    node = lambda k: (k, rng.choice(["p", "q", None]), rng.choice(["a b", "a c", "d b", "e f", None]), rng.choice(["b", "c", "f", "", None]))
    left, right = [node(k) for k in range(14)], [node(100 + k) for k in range(14)]
    accepted = [(0, 100), (1, 101), (2, 101)]
    rejected = [(rng.randrange(14), 100 + rng.randrange(14)) for _ in range(25)]
    schema = "string", "string", "string"
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} bigint, pool {schema[0]}, full string, last string")
    pairs = lambda rows: spark.createDataFrame(rows, "l bigint, r bigint")
    for rounds in (1, 8):
        assigned, rest = identity.two_sided(frame(left, "l"), frame(right, "r"), "l", "r", ["pool"], TIERS, pairs(accepted), pairs(rejected), rounds)
        got = {x.l: (x.r, x.method, x["round"]) for x in assigned.collect()}
        assert got == brute(left, right, accepted, set(rejected), rounds)
        others = {x.l: x.reason for x in rest.collect()}
        assert set(others) == {n[0] for n in left} - set(got) and others[1] == others[2] == "conflicting_review"
        assert len({b for b, *_ in got.values()}) == len(got)


def test_a_fixed_pair_frees_the_next(spark):
    """The strict pair takes its entry out, so the looser one becomes unique in the second round."""
    names = spark.createDataFrame([(1, "ann lee", "lee"), (2, "bob lee", "lee"), (3, "x y", "y")], "l bigint, full string, last string")
    entries = spark.createDataFrame([(10, "ann lee", "lee"), (11, "robert lee", "lee"), (12, "u y", "y"), (13, "v y", "y")], "r bigint, full string, last string")
    assigned, rest = identity.two_sided(names, entries, "l", "r", [], TIERS)
    assert sorted(map(tuple, assigned.collect())) == [(1, 10, "full", 1), (2, 11, "last", 2)]
    assert [tuple(x) for x in rest.collect()] == [(3, "ambiguous", 2)]


def test_rejections_are_taken_off_the_count(spark):
    """A rejection costs a row where the pair shares a key, not its group's entries; the last one left is still found."""
    names = spark.range(200).selectExpr("id AS l", "IF(id = 0, 'only', 'all') AS full", "'' AS last")
    entries = spark.range(200).selectExpr("id + 1000 AS r", "IF(id < 3, 'only', 'all') AS full", "'' AS last")
    apart = spark.range(200).selectExpr("id AS l", "explode(array(1000L, 1002L, 1100L)) AS r")
    assigned, rest = identity.two_sided(names, entries, "l", "r", [], TIERS, None, apart)
    assert [tuple(x) for x in assigned.collect()] == [(0, 1001, "full", 1)]
    assert {(x.reason, x.n) for x in rest.collect()} == {("ambiguous", 196)}
    a, b = identity._nodes(names, "l", [], TIERS), identity._nodes(entries, "r", [], TIERS)
    shared = identity._shared(apart, a, b)
    assert shared.count() == 201
    found = identity._partners(a, b, shared.withColumnsRenamed({"l": "id", "r": "not_id"}))
    assert {(x.id == 0, x.n, x.sole) for x in found.collect()} == {(True, 1, 1001), (False, 196, None)}


CANDIDATE = "state string, office string, district int, candidate string, party string, partial boolean"
ROSTER = "state string, office string, district int, holder string, party string"
REVIEW = "state string, office string, candidate string, holder string, same_person string, retrieved_on string"
PARTIES = {"DEMOCRAT": "dem", "REPUBLICAN": "rep"}


def evidence(spark, candidates, roster, reviews=()):
    frame = spark.createDataFrame
    settled, open_ = identity.ballot_evidence(frame(candidates, CANDIDATE), frame(roster, ROSTER), frame(list(reviews), REVIEW), "2026-09-10", PARTIES)
    return {(r.state, r.district): r for r in settled.collect()}, {(r.state, r.district): r.reason for r in open_.collect()}


D, R = "DEMOCRAT", "REPUBLICAN"


def test_ballots(spark):
    roster = [("TX", "house", 1, "Ann Lee", D), ("TX", "house", 2, "Bob Ray", R), ("TX", "house", 3, "William Orr", R), ("TX", "house", 4, "Cy Dunn", R), ("TX", "house", 5, None, R), ("ME", "senate", None, "Susan Collins", R)]
    ballot = [
        ("TX", "house", 1, "LEE, ANN", D, False), ("TX", "house", 1, "New One", R, False),
        ("TX", "house", 2, "Some Other", D, False), ("TX", "house", 2, "Ann Marie Ray", R, False),
        ("TX", "house", 3, "Wm Orr", R, False),
        ("TX", "house", 4, "Who Else", D, True),
        ("TX", "house", 5, "Fay Gee", D, False),
        ("TX", "house", 9, "No Seat", D, False),
        ("ME", "senate", None, "Susan Collins", R, True),
    ]
    settled, open_ = evidence(spark, ballot, roster)
    assert set(settled) == {("TX", 1), ("TX", 5), ("ME", 0)}
    one = settled["TX", 1]
    assert (one.incumbent, one.incumbent_running, one.dem_nominee, one.rep_nominee, one.ballot_incumbent_dem, one.ballot_incumbent_rep, one.evidence) == ("Ann Lee", True, "LEE, ANN", "New One", 1, 0, "complete ballot")
    assert settled["TX", 5].incumbent == "VACANT" and settled["ME", 0].evidence == "ballot presence only"
    assert open_["TX", 2] == "same surname but unresolved first name" and "first names differ" in open_["TX", 3]
    assert open_["TX", 4].startswith("a partial list") and open_["TX", 9] == "no unique current seat"


def test_reviews_decide(spark):
    roster = [("TX", "house", 3, "William Orr", R), ("TX", "house", 2, "Bob Ray", R)]
    ballot = [("TX", "house", 3, "Bill Orr", R, False), ("TX", "house", 2, "Bo Ray", R, False)]
    reviews = [("TX", "house", "Bill Orr", "William Orr", "True", "2026-09-01"), ("TX", "house", "Bo Ray", "Bob Ray", "False", "2026-09-01")]
    settled, open_ = evidence(spark, ballot, roster, reviews)
    assert settled["TX", 3].incumbent_running and not settled["TX", 2].incumbent_running and not open_
    late = [(*r[:5], "2026-09-30") for r in reviews]
    assert set(evidence(spark, ballot, roster, late)[1]) == {("TX", 3), ("TX", 2)}
    for bad in ([reviews[0], reviews[0]], [(*reviews[0][:4], "maybe", "2026-09-01")]):
        with pytest.raises(Exception, match="identity"):
            evidence(spark, ballot, roster, bad)


def test_one_holder_is_not_used_twice(spark):
    roster = [("TX", "house", 1, "Ann Lee", D)]
    ballot = [("TX", "house", 1, "Ann Lee", D, False), ("TX", "house", 1, "LEE, ANN", R, False)]
    settled, open_ = evidence(spark, ballot, roster)
    assert not settled and "several" in open_["TX", 1]


def test_nothing_is_broadcast(spark, monkeypatch):
    """Keys and pairs grow with the input, and their stored files say little of their size in memory."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    kept = identity.stored
    monkeypatch.setattr(identity, "stored", lambda df, name: plan(df) or kept(df, name))
    left = spark.createDataFrame([(k, "p", f"a {k}", f"{k % 4}") for k in range(12)], "l bigint, pool string, full string, last string")
    right = spark.createDataFrame([(100 + k, "p", f"a {k}", f"{k % 4}") for k in range(12)], "r bigint, pool string, full string, last string")
    pairs = lambda rows: spark.createDataFrame(rows, "l bigint, r bigint")
    assigned, rest = identity.two_sided(left, right, "l", "r", ["pool"], TIERS, pairs([(0, 105)]), pairs([(1, 101), (2, 106)]))
    assert assigned.count() + rest.count() == 12
    for df in (assigned, rest):
        plan(df)
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]
