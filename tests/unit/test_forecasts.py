import json
import math

import pytest
from pyspark.sql import functions as F

from psephos.functions.text import whole_number
from psephos.operators import checks, forecasts, gates
from psephos.sources import returns


def test_national_history(spark):
    df = spark.createDataFrame([(2010, 0.48, -1), (2010, 0.48, -1), (2012, 0.51, 0), (2014, 0.47, -1), (2016, 0.50, 0), (2018, 0.54, 1), (2022, 0.49, -1)], "c int, n double, s int")
    got = {r.c: round(r.forecast, 6) for r in forecasts.national_history(df, "c", "n", "s").collect()}
    assert got == {2012: 0.48, 2014: 0.51, 2016: 0.47, 2018: 0.5, 2022: round(0.54 - 0.04, 6)}


def test_panel_needs_the_cycle_before(spark):
    df = spark.createDataFrame([("a", 2016, 0.6, 1.0), ("a", 2018, 0.5, 1.0), ("a", 2022, 0.4, 1.0), ("b", 2018, 0.7, 3.0)], "u string, c int, s double, w double")
    got = {(r.u, r.c): r for r in forecasts.contest_panel(df, ["u"], "c", "s", "w", 2).collect()}
    assert got["a", 2018].lag_s == 0.6 and got["a", 2022].lag_s is None and math.isclose(got["b", 2018].national_share, 0.65)
    assert got["a", 2018].lag_lean == 0.0


def test_specification_gate(spark):
    rows = [("v0", 2.0, 3.0, 0.9), ("v1", 1.0, 2.0, 0.89), ("v2", 1.0, None, 0.9), ("v3", 1.5, 2.5, 0.87)]
    found = {r.s: r for r in forecasts.specification_gate(spark.createDataFrame(rows, "s string, mae double, open double, cov double"), "s", "v0", ["mae", "open"], "cov", "s").collect()}
    assert [s for s, r in found.items() if r.selected] == ["v1"] and found["v2"].failed == ["open"] and found["v3"].failed == ["cov"] and not found["v0"].promoted


def test_bounds_and_overperformance(spark):
    pairs = spark.createDataFrame([(0.1, 0.05), (0.2, 0.16), (0.1, 0.02)], "s double, g double")
    r = forecasts.shrinkage_bounds(pairs, "s", "g").first()
    assert (r.status, round(r.low, 6), round(r.high, 6)) == ("bound", 0.2, 0.8)
    assert forecasts.shrinkage_bounds(pairs.limit(2), "s", "g").first().low is None
    o = forecasts.overperformance(spark.createDataFrame([(60, 40, 0.55, 200), (0, 0, 0.5, 0)], "d int, r int, b double, v int"), "d", "r", "b", "v").collect()
    assert math.isclose(o[0].overperformance, 0.2 - 0.1) and o[0].turnout_ratio == 0.5 and o[1].overperformance is None


def test_winner_by_electors(spark):
    states = spark.createDataFrame([(2000, "a", 0.6), (2000, "b", 0.4), (2004, "a", 0.6), (2004, "b", 0.7)], "c int, s string, x double")
    votes = spark.createDataFrame([("a", 3), ("b", 10)], "s string, ev int")
    assert {r.c: r.party for r in forecasts.executive_party(states, votes, "c", "s", "x", "ev").collect()} == {2000: "second", 2004: "first"}


def test_race_averages_do_not_count_questions_twice(spark):
    one = [("r", "p1", 0.5, 400, 25.0, 0.45, 0.08), ("r", "p2", 0.6, 900, 30.0, 0.45, 0.08)]
    schema = "race string, poll string, s double, n int, d double, p double, ps double"
    a, b = (forecasts.race_averages(spark.createDataFrame(x, schema), "race", "poll", "s", "n", "d", "p", "ps", 21, 30).first() for x in (one, [*one, one[0]]))
    assert math.isclose(a.poll_mean, b.poll_mean) and math.isclose(a.poll_sigma, b.poll_sigma) and (b.n_polls, b.n_questions) == (2, 3)
    assert 0.45 < a.blend_mean < a.poll_mean


def test_backtests(spark):
    units = spark.createDataFrame([("c", "x", 30.0, 1.0), ("c", "y", 70.0, 1.0)], "county string, d string, v double, w double")
    assert sorted((r.d, r.allocated, r.error_share) for r in forecasts.allocation_backtest(units, ["county"], "d", "v", "w").collect()) == [("x", 50.0, 0.2), ("y", 50.0, -0.2)]
    rows = spark.createDataFrame([(0.6, 0.58, 0.5), (0.4, 0.43, 0.5), (0.55, 0.56, 0.4)], "a double, t double, l double")
    r = forecasts.transfer_backtest(rows, "a", "t", "l", 0.05).first()
    assert r.usable and r.n == 3


def test_run_difference(spark):
    pred = spark.createDataFrame([("s1", 0.6), ("s2", 0.4), ("s3", 0.5)], "k string, share double")
    diff = {r.k: (r.status, r.difference) for r in forecasts.run_difference(pred, pred.where("k <> 's3'"), "k", "share").collect()}
    assert diff["s3"] == ("left_only", None) and diff["s1"] == ("both", 0.0)



def test_spine_rates_archive_and_status(spark):
    seen = spark.createDataFrame([("1", 2), ("1", None), ("06", 1)], "f string, d int")
    assert forecasts.geography_spine(seen, "f", "d").count() == 5
    r = forecasts.derived_rates(spark.createDataFrame([("1", "5", "10"), ("2", "5", "0")], "f string, a string, b string"), {"r": ("a", "b")}, "f").collect()
    assert [(x.geoid, x.r) for x in r] == [("01", 0.5), ("02", None)]
    kept, counts = forecasts.prepared_archive(spark.createDataFrame([(1, 0.5), (2, None), (3, 0.4), (3, 0.6)], "id int, s double"), [("share", F.col("s").between(0, 1))], ["id"])
    assert [x.id for x in kept.collect()] == [1] and {c.reason: c["count"] for c in counts.collect()} == {"share": 1, "repeated_key": 2}
    seats = spark.createDataFrame([(1, "Ann Lee", "x", "s"), (2, None, "x", "s"), (3, "Bo Ray", "x", "s")], "row int, name string, seat string, state string")
    roster = spark.createDataFrame([("A", "LEE, ANN", "x", "s")], "id string, rname string, seat string, state string")
    assert {x.row: x.incumbent_status for x in forecasts.filing_status(seats, roster, "row", "name", "id", "rname", ["seat"], ["state"]).collect()} == {1: "filed", 2: "unknown", 3: "not_found"}
    plan = forecasts.filing_status(seats.withColumn("label", F.lit("")), roster.withColumn("filed_label", F.lit("DEM")), "row", "name", "id", "rname", ["seat"], ["state"], "label", "filed_label")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan  # rosters must not pass the driver, however small Spark takes them to be


def test_poll_gate(spark):
    df = spark.sql(
        """SELECT 'p1' poll_id, 'x' pollster, 'us_house_generic' office, 'nation:us' geography_id, 'lv' population, 'web' mode, 'https://a.b' source_url, date'2026-01-01' field_start, date'2026-01-03' field_end,
        500 sample_size, 0.5 dem_pct, 0.4 rep_pct, 0.55 two_party_dem_share, 0.0 house_effect_dem, 'US' state_po, cast(null as int) district_num, date'2026-01-04' published_on"""
    )
    rules = gates.polls(["lv"], ["PA"])
    assert all(r.passed for r in checks.report(df, rules, ["poll_id"]).collect())
    assert [r.broken for r in checks.violations(df.withColumn("sample_size", F.lit(0)), rules).collect()] == [["sample_size_positive"]]


def test_result_files(spark, tmp_path):
    (tmp_path / "pa.xml").write_text('<R><Contest text="US House District 3"><Choice text="X" party="DEM" totalVotes="5"/><Choice text="Y" party="REP" totalVotes="6"/><Choice text="Z" party="LIB" totalVotes="1"/></Contest><Contest text="Mayor"><Choice text="M" party="DEM" totalVotes="9"/></Contest></R>')
    (tmp_path / "mn.txt").write_text("MN;U.S. Senator;DFL;10\nMN;U.S. Senator;R;7\n")
    (tmp_path / "k.json").write_text(json.dumps({"1": {"state": "VT", "title": "Representative in Congress", "choices": [{"party": "DEM", "votes": 3}]}}))
    got = [tuple(returns.parsers.extract(spark, n, f"{tmp_path}/{f}").first())[:-1] for n, f in (("election_xml", "pa.xml"), ("semicolon_lines", "mn.txt"), ("keyed_json", "k.json"))]
    assert got == [("PA", "us_house", 3, 5, 6, 1, "REPUBLICAN"), ("MN", "us_senate", None, 10, 7, 0, "DEMOCRAT"), ("VT", "us_house", None, 3, 0, 0, "DEMOCRAT")]
    lines = spark.createDataFrame([("f", 0, "United States Representative District 2"), ("f", 1, "Ann Lee (Democratic) 1,234"), ("f", 2, "Bo Ray (Republican) 999")], "file string, pos int, line string")
    assert tuple(returns.carried_lines(lines, ["file"], "pos", "line", F.lit("NE")).first()) == ("NE", "us_house", 2, 1234, 999, 0, "DEMOCRAT")
    table = spark.createDataFrame([("Town", "1,000", "5"), ("TOTALS", "1,000", "5")], "town string, a string, b string")
    assert sorted((r.candidate, r.votes) for r in returns.wide(table, ["town"], "TOTALS", "town").collect()) == [("a", 1000), ("b", 5)]
    assert whole_number is not None
