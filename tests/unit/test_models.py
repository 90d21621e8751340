import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.operators import allocation, bootstrap, evaluation, ledger, matching, panels, polls, regression, seats, simulation, windows


def test_least_squares_like_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2.0, -0.5] + 0.1 * rng.normal(size=80)
    data = [(int(i % 4), float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*data, (0, None, 1.0, 2.0)], "g int, a double, b double, y double")
    fit = regression.solve(regression.grams(df, ["a", "b"], "y")[None], ["a", "b"])
    design = np.column_stack([np.ones(80), x])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert np.allclose(fit.coefficients, beta) and math.isclose(fit.sigma, math.sqrt(rss[0] / 77), rel_tol=1e-6)
    for r in regression.leave_one_out(df.where("a is not null"), ["a", "b"], "y", "g").collect():
        keep = np.arange(80) % 4 != r.g
        own = np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]
        assert math.isclose(r.pred, own @ [1, r.a, r.b], rel_tol=1e-6)


def test_later_rows_do_not_change_earlier_predictions(spark):
    df = spark.createDataFrame([(c, float(i), float(c * i)) for c in range(1, 5) for i in range(6)], "c int, x double, y double")
    changed = df.withColumn("y", F.when(F.col("c") == 4, 99.0).otherwise(F.col("y")))
    early = [sorted((r.c, r.x, r.pred) for r in regression.expanding(d, ["x"], "y", "c").where("c < 4").collect()) for d in (df, changed)]
    assert early[0] == early[1] and {c for c, _, _ in early[0]} == {2, 3}


def test_slope_of_a_planted_effect(spark):
    rng = np.random.default_rng(0)
    data = [(c, float(l), float(0.16 * l + c)) for c in range(8) for l in rng.normal(size=40)]
    out = regression.group_slopes(spark.createDataFrame(data, "c int, lean double, e double"), "lean", [], "e", "c", draws=50).first()
    assert out.status == "estimated" and abs(out.slope - 0.16) < 1e-6 and abs(out.high - 0.16) < 1e-6
    one = spark.createDataFrame(data[:40], "c int, lean double, e double")
    assert regression.group_slopes(one, "lean", [], "e", "c").first().status == "insufficient_history"
    flat = spark.createDataFrame([(c, 1.0, float(k)) for c in range(3) for k in range(5)], "c int, lean double, e double")
    assert regression.group_slopes(flat, "lean", [], "e", "c").first().status == "unidentified"


def test_replicates_against_numpy(spark):
    """Every replicate's slope from its counts, by least squares over the rows it draws, with a control."""
    rng = np.random.default_rng(1)
    rows = [(c, *map(float, rng.normal(size=3))) for c in range(5) for _ in range(6 + c)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0)], "c int, x double, z double, y double")
    counts = {}
    for r in bootstrap.group_counts(spark, 5, 20, 3).collect():
        counts.setdefault(r.replicate, {})[r._g] = r.n
    assert all(sum(c.values()) == 5 for c in counts.values()) and len(counts) == 21
    found = {r.replicate: r.slope for r in bootstrap.slopes(df, "x", ["z"], "y", "c", draws=20, seed=3).collect()}
    blocks = []
    for c in range(5):
        m = np.array([r[1:] for r in rows if r[0] == c])
        m = m - m.mean(axis=0)
        blocks.append(m.T @ m / len(m))
    for k, drawn in counts.items():
        m = sum(n * blocks[g] for g, n in drawn.items())
        wanted = np.linalg.solve(m[:2, :2] + np.diag([0, 1e-5]), m[:2, 2])[0]
        assert abs(found[k] - wanted) < 1e-9
    centred = bootstrap.centred(bootstrap.slopes(df, "x", ["z"], "y", "c", draws=20, seed=3)).collect()
    assert abs(np.mean([r.slope for r in centred]) - found[-1]) < 1e-9 and sorted(r.number for r in centred) == list(range(20))


def test_votes_are_conserved(spark):
    blocks = spark.createDataFrame([("r", "p", "b1", 300), ("r", "p", "b2", 100), ("r", "q", "b3", 0), ("r", "q", "b4", 0), ("s", None, "b5", 5)], "region string, unit string, block string, pop int")
    votes = spark.createDataFrame([("r", "p", 300.0), ("r", "q", 10.0), ("r", "gone", 31.0), ("s", "x", 4.0), ("t", "x", 7.0)], "region string, unit string, votes double")
    out = {(r.region, r.block): r for r in allocation.apportion(votes, blocks, ["unit"], ["region"], "block", "pop", "votes").collect()}
    assert math.isclose(sum(r.votes + r.unplaced for r in out.values()), 352.0)
    assert math.isclose(out["r", "b1"].votes, 225 * 1.1) and math.isclose(out["r", "b3"].votes, 5 * 1.1)
    assert out["s", "b5"].votes == 4 and out["t", None].unplaced == 7


def test_two_pass_allocation_reports_what_has_no_weight(spark):
    votes = spark.createDataFrame([("a", 10.0), ("b", 6.0)], "county string, v double")
    weights = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 0.0)], "county string, d string, w double")
    placed, rest = allocation.allocate(votes, weights, ["county"], "d", "v", "w")
    assert sorted((r.d, r.v) for r in placed.collect()) == [("x", 2.5), ("y", 7.5)]
    assert [tuple(r) for r in rest.collect()] == [("b", 6.0)]


def test_units_with_silent_rows_are_not_ambiguous(spark):
    df = spark.createDataFrame([("p", "1", 5), ("p", "2", 0), ("q", "1", 1), ("q", "2", 1), ("z", "1", 0)], "unit string, area string, votes int")
    found = {r.unit: (r.area, r.status) for r in allocation.resolve_units(df, ["unit"], "area", "votes").collect()}
    assert found == {"p": ("1", "single"), "q": (None, "ambiguous"), "z": (None, "silent")}


def test_draws_of_units_are_not_correlated_by_the_generator(spark):
    units = spark.createDataFrame([(i, i % 2, 0.5, 0.1) for i in range(4)], "u int, r int, m double, s double")
    draws = simulation.simulate(units, "u", "r", "m", "s", 3000, (0, 0, 1)).groupBy("sim").pivot("u").agg(F.first("share")).toPandas().drop(columns="sim")
    corr = np.corrcoef(draws.to_numpy().T) - np.eye(4)
    assert np.abs(corr).max() < 0.08
    assert abs(draws.to_numpy().mean() - 0.5) < 0.005 and abs(draws.to_numpy().std() - 0.1) < 0.005


def test_calibration_bins_follow_the_float_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,)], "p double")
    assert [r[0] for r in df.select(evaluation.calibration_bin(F.col("p"))).collect()] == [2, 3, 9, 0]


def test_normal_cdf(spark):
    got = spark.createDataFrame([(z / 4,) for z in range(-16, 17)], "z double").select("z", evaluation.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.z / math.sqrt(2)))) < 2e-7 for r in got)


def test_pair_covariance_equals_pairs(spark):
    rng = np.random.default_rng(5)
    data = [(0, f"r{i % 3}", float(z)) for i, z in enumerate(rng.normal(size=12))]
    r = evaluation.pair_covariance(spark.createDataFrame(data, "c int, r string, z double"), "c", "r", "z").first()
    across = [a[2] * b[2] for i, a in enumerate(data) for j, b in enumerate(data) if a[1] != b[1]]
    within = [a[2] * b[2] for i, a in enumerate(data) for j, b in enumerate(data) if a[1] == b[1] and i != j]
    assert math.isclose(r.across, np.mean(across)) and math.isclose(r.within, np.mean(within))


def test_certification_starts_anew_after_a_revocation(spark):
    df = spark.createDataFrame([("s", None, d, ok) for d, ok in [("01", False), ("02", True), ("03", True), ("04", False), ("05", True), ("06", True)]], "state string, district int, day string, ok boolean")
    at = lambda day: ledger.certification(df, ["state", "district"], "day", "ok", day).first().certified_on
    assert [at(d) for d in ("01", "02", "03", "04", "05", "06", None)] == [None, "02", "02", None, "05", "05", "05"]
    assert ledger.repeated_observations(df, ["state", "district"], "day").isEmpty()


def test_possible_third_party_winner_is_refused(spark):
    df = spark.createDataFrame([(10, 20, 30, None, "01")], "a int, b int, o int, w string, certified_on string")
    with pytest.raises(Exception, match="third-party"):
        ledger.actuals(df, "a", "b", "o", "w", "DEMOCRAT").collect()
    named = df.withColumn("w", F.lit("Democrat"))
    assert ledger.actuals(named, "a", "b", "o", "w", "DEMOCRAT").first().actual_win


def test_matching_in_tiers_with_abstention(spark):
    roster = spark.createDataFrame([("A1", "SMITH, JOHN ALAN", "x"), ("A2", "SMITH, JANE", "x"), ("B1", "ARENHOLZ, ASHLEY HINSON", "x"), ("C1", "JONES, MARY", "y"), ("D1", "O'NEIL, PAT", "x")], "id string, rname string, seat string").withColumn("state", F.lit("s"))
    names = spark.createDataFrame([(1, "John Smith", "x"), (2, "J. Smith", "x"), (3, "Ashley Hinson", "x"), (4, "Mary Jones", "x"), (5, "WRITE-IN", "x"), (6, "Jane Smith Jr.", "x"), (7, "Pat ONeil", "x"), (8, "Nobody Here", "x")], "row int, name string, seat string").withColumn("state", F.lit("s"))
    found = {r.row: (r.id, r.method) for r in matching.seat_then_state(names, roster, "row", "name", "id", "rname", ["seat"], ["state"]).collect()}
    assert found[1] == ("A1", "last_first")
    assert found[2][0] is None and found[2][1].startswith("ambiguous")
    assert found[3] == ("B1", "tokens_within") or found[3] == ("B1", "last_first") or found[3][0] == "B1"
    assert found[4] == ("C1", "state_token_set")
    assert found[5] == (None, "not_a_person")
    assert found[6] == ("A2", "token_set") and found[7] == ("D1", "token_set") and found[8] == (None, "none")


def test_projection_by_boundary(spark):
    df = spark.createDataFrame([("unchanged", 0.6, None, None, 0.0), ("redrawn", 0.9, 0.55, 0.1, 0.0), ("redrawn", 0.9, None, None, 0.02), ("unchanged", None, None, None, 0.0)], "b string, o double, t double, ts double, l double")
    out = seats.project(df, "b", "o", "t", "ts", "l", 0.5, F.lit(0.5), 0.0, 1.0, 1.0, 0.05, 0.2).collect()
    assert [(r.source, round(r.mean_share, 6)) for r in out] == [("model", 0.6), ("model_transferred", 0.55), ("fallback_state_lean", 0.52)]
    with pytest.raises(Exception, match="not allowed"):
        seats.refused(df, "b", ["unchanged"]).collect()


def test_poll_average_against_numpy(spark):
    s, n, w = np.array([0.5, 0.55, 0.48]), np.array([400, 900, 600]), np.array([1.0, 2.0, 0.5])
    df = spark.createDataFrame([("g", float(a), int(b), float(c), f"p{i % 2}") for i, (a, b, c) in enumerate(zip(s, n, w, strict=True))], "g string, s double, n int, w double, p string")
    r = polls.average(df, ["g"], "s", F.col("w"), "n", "p").first()
    q = w / w.sum()
    mean = q @ s
    assert math.isclose(r.poll_mean, mean) and r.n_pollsters == 2 and math.isclose(r.effective_polls, 1 / (q @ q))
    assert math.isclose(r.poll_sigma, math.sqrt(q**2 @ (s * (1 - s) / n) + q @ (s - mean) ** 2 + 0.025**2))


def test_guarded_lag_and_labels(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2002, 2.0), ("a", 2006, 3.0)], "k string, y int, v double")
    assert [r.lag_v for r in windows.guarded_lag(df, ["k"], "y", ["v"], 2).orderBy("y").collect()] == [None, 1.0, None]
    labels = spark.createDataFrame([(0.055,), (-0.03,), (0.001,), (0.045,)], "x double").select(panels.lean_label(F.col("x"))).collect()
    assert [r[0] for r in labels][1:3] == ["R+3", "EVEN"]
