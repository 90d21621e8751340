import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.functions import calendar, places, text
from psephos.operators import allocation, checks, environment, evaluation, gates, matching, seats, windows
from psephos.sources import snapshots

STATES = [code for code, _, _ in places.ROWS]


def values(spark, f, *given):
    rows = spark.createDataFrame([(k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(given)], "k int, " + ", ".join(f"c{i} string" for i in range(len(given[0]) if isinstance(given[0], tuple) else 1)))
    n = len(rows.columns) - 1
    return [r.v for r in rows.select("k", f(*(F.col(f"c{i}") for i in range(n))).alias("v")).orderBy("k").collect()]


def test_names(spark):
    assert values(spark, text.surname, ", John", "J, Smith", "", None, "O'Neill, Pat", "Earl L. \"Buddy\" Carter", "CARTER, EARL L") == [None, None, None, None, "ONEILL", "CARTER", "CARTER"]
    assert values(spark, text.first_name, ", John", "Rep. Ann Lee Jr.", "Lee, The Hon. Ann") == ["JOHN", "ANN", "ANN"]
    assert values(spark, text.surname_variants, ", John", "Mary Smith-Jones") == [[], ["JONES", "SMITHJONES"]]
    assert values(spark, text.name_tokens, "JESÚS G “CHUY” GARCÍA", "Constant 'Connor' Vlakancic", "D’Amato, Al") == [["JESUS", "GARCIA"], ["CONSTANT", "VLAKANCIC"], ["DAMATO", "AL"]]
    assert values(spark, text.is_person, "BLANK VOTE/SCATTERING", "Blankenship", "", None, "Ann/Write-in", "total") == [False, True, False, False, True, False]


def test_parties_and_states(spark):
    labels = ("REPUBLICAN PARTY", "libertarian", "", None, "Democratic Socialist", "dfl", "NPA", "Whig", "Democrat/Republican")
    assert values(spark, text.party, *labels) == ["REPUBLICAN", "LIBERTARIAN", "UNKNOWN", "UNKNOWN", "OTHER", "DEMOCRAT", "INDEPENDENT", "OTHER", "OTHER"]
    assert values(spark, text.major_party, *labels) == ["REPUBLICAN", None, None, None, None, None, None, None, None]
    assert values(spark, text.bucket, "gop", "D", "green", None) == ["R", "D", "OTHER", "OTHER"]
    found = values(spark, text.ballot_party, ("DEMOCRATIC", "OTHER", None), ("", "REPUBLICAN", "DEM"), ("", "", "IND"), ("GREEN", "OTHER", "OTH"), ("", "LIB", None), ("x", "OTHER", ""), ("", "", ""))
    assert [tuple(r) for r in found] == [("DEMOCRAT", "raw"), ("REPUBLICAN", "simplified"), ("INDEPENDENT", "filed"), ("GREEN", "raw"), ("LIBERTARIAN", "simplified"), ("OTHER", "simplified"), ("UNKNOWN", "unresolved")]
    assert values(spark, places.postal, " ny", "36", "1", "new york", "Puerto Rico", "99", "", None) == ["NY", "NY", "AL", "NY", "PR", None, None, None]
    assert values(spark, places.fips, "wy", "Alabama") == ["56", "01"] and len(places.ROWS) == 52
    first = spark.createDataFrame([(None, "b"), (None, None), ("a", "b")], "x string, y string").select(text.first_known([("x", F.col("x")), ("y", F.col("y"))]).alias("f")).collect()
    assert [tuple(r.f) for r in first] == [("b", "y"), (None, None), ("a", "x")]
    assert values(spark, text.id_suffix, "2024_us_house_PA_special") == ["special"]
    assert [r.c for r in spark.createDataFrame([(2024,), (2026,), (2028,), (2025,)], "y int").select(calendar.senate_class(F.col("y")).alias("c")).collect()] == [1, 2, 3, None]


def test_matching_of_odd_names(spark):
    roster = spark.createDataFrame([(k, n, "p") for k, n in enumerate([", John", "Smith, Ann", "Smith, Ann Lee", "Ray Bo Lu", None, ""])], "id int, rname string, pool string")
    names = spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate([("Ann Smith", "p"), ("Ann Smith", None), ("J, Smith", "p"), (", John", "p"), ("Lu Ray Xo", "p"), ("Bo Ray", "p"), (None, "p"), ("", "p")])], "row int, name string, pool string")
    found = {r.row: (r.id, r.method) for r in matching.tiered(names, roster, "row", "name", "id", "rname", ["pool"]).collect()}
    assert found == {0: (1, "token_set"), 1: (None, "none"), 2: (None, "none"), 3: (0, "token_set"), 4: (None, "none"), 5: (3, "tokens_within"), 6: (None, "none"), 7: (None, "none")}


def test_matching_decides_equal_names_once(spark):
    """Copies of names and entries: an entry's copies make it ambiguous, names are keyed once, and no join is broadcast."""
    roster = spark.range(500).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") < 499, "Smith, Ann").otherwise("Ray Bo Lu").alias("rname"), F.lit("p").alias("pool"))
    names = spark.range(600).select(F.col("id").cast("int").alias("row"), F.when(F.col("id") % 3 == 0, "Ann Smith").when(F.col("id") % 3 == 1, "Bo Ray").alias("name"), F.lit("p").alias("pool"))
    out = matching.tiered(names, roster, "row", "name", "id", "rname", ["pool"])
    assert {(r.id, r.method, r["count"]) for r in out.groupBy("id", "method").count().collect()} == {(None, "ambiguous_token_set", 200), (499, "tokens_within", 200), (None, "none", 200)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [p" in plan and "BroadcastHashJoin" not in plan


def test_crosswalk(spark):
    roster = spark.createDataFrame([("A", "SMITH, ANN", 2020, "PA", "1"), ("B", "JONES, BO", 2020, "PA", "2")], "id string, rname string, c int, st string, seat string")
    names = spark.createDataFrame([(1, "Ann Smith", 2020, "PA", "1"), (2, "Bo Jones", 2020, "PA", "1"), (3, "Write-in", 2020, "PA", "1"), (4, "Ann Smith", 2018, "PA", "1"), (5, "No One", 2020, "PA", "2"), (6, "Odd Name", 2020, "PA", "2")], "row int, name string, c int, st string, seat string")
    overrides = spark.createDataFrame([(6, "B")], "row int, id string")
    found = {r.row: (r.id, r.method) for r in matching.crosswalk(names, roster, roster, overrides, "row", "name", "id", "rname", ["c"], ["c", "st", "seat"], ["c", "st"]).collect()}
    assert found == {1: ("A", "token_set"), 2: ("B", "state_token_set"), 3: (None, "not_a_person"), 4: (None, "no_roster"), 5: (None, "none"), 6: ("B", "reviewed")}


def test_mirrors_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    snapshots.write_mirrored(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "t" / "csv")).collect())) == [("1", "a,b"), ("2", None)]
    assert spark.read.parquet(str(tmp_path / "t" / "parquet")).count() == 2
    snapshots.write_report(rows, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"k":1,"v":"a,b"}', '{"k":2,"v":null}']
    with pytest.raises(Exception, match="already exists"):
        snapshots.write_report(rows, str(tmp_path / "r"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.csv").write_text("h\n1\n2\n")
    (tmp_path / "src" / "b.csv").write_text("h\n")
    manifest = snapshots.checksums(spark, str(tmp_path / "src"), "x", "2026-01-01", 1, "CC0-1.0")
    assert {r.path[-5:]: r.n_rows for r in snapshots.with_rows(manifest, str(tmp_path / "src")).collect()} == {"a.csv": 3, "b.csv": 1}


def test_whole_chamber_against_numpy(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(2002, 2022, 2):
        national = 0.5 + 0.03 * math.sin(c)
        for u in range(6):
            lag = None if (u == 3 and c > 2008) else float(0.4 + 0.04 * u + 0.01 * rng.standard_normal())
            share = 1.0 if (u, c) == (5, 2016) else float(0.3 + 0.5 * national + 0.3 * (lag or 0.5) - 0.1 + 0.02 * rng.standard_normal())
            rows.append((u, f"s{u % 2}", c, share, float(national), lag, (c // 2) % 2 * 2 - 1))
    rows = [r for r in rows if r[:3] != (0, "s0", 2012)]
    panel = spark.createDataFrame(rows, "u int, st string, c int, y double, n double, lag double, s int")
    history = spark.createDataFrame([(f"s{k}", c, 0.5 + 0.01 * k, 0.49) for k in range(2) for c in range(2000, 2020, 4)], "st string, c int, share double, national double")
    got = {(r.u, r.c): r for r in environment.chamber_predictions(panel, history, ["n", "lag"], "n", "c", "u", "st", "y", "s", 6).collect()}
    assert {c for _, c in got} == {2010, 2014, 2016, 2018, 2020}  # four cycles to learn from, and 2012 is not whole

    national = {c: n for _, _, c, _, n, _, _ in rows}
    sign = {c: s for *_, c, _, _, _, s in rows}
    cycles, errors = sorted(national), []
    for c in cycles[1:]:
        k = cycles.index(c)
        swings = [national[b] - national[a] for a, b in zip(cycles[: k - 1], cycles[1:k], strict=True) if sign[b] == sign[c]]
        forecast = min(1, max(0, national[cycles[k - 1]] + (np.mean(swings) if swings else 0)))
        if c not in {x for _, x in got}:
            continue
        train = [(1, r[4], r[5], r[3]) for r in rows if r[2] < c and r[5] is not None and 0 < r[3] < 1]
        x, y = np.array([t[:3] for t in train]), np.array([t[3] for t in train])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        sd = math.sqrt(((y - x @ b) ** 2).sum() / (len(y) - 3))
        nat = np.std(errors, ddof=1) if len(errors) >= 3 else 0.03
        for u, st, cc, share, _, lag, _ in rows:
            if cc != c:
                continue
            r, sigma = got[u, c], math.hypot(sd, abs(b[1]) * nat)
            if share == 1:
                assert (r.pred, r.sigma, r.source) == (1.0, 0.0, "one_sided")
            elif lag is None:
                assert r.source == "state_fallback" and math.isclose(r.pred, forecast + 0.01 + 0.01 * int(st[1]), rel_tol=1e-9) and math.isclose(r.sigma, 2 * sigma, rel_tol=1e-8)
            else:
                assert r.source == "unit_model" and math.isclose(r.pred, b @ [1, forecast, lag], rel_tol=1e-8) and math.isclose(r.sigma, sigma, rel_tol=1e-8)
            assert r.train_through == cycles[k - 1]
        errors.append(forecast - national[c])


def test_basis_map_refuses_few_rows(spark):
    own = spark.createDataFrame([(k, 2020, 0.4 + 0.01 * k, 0.5, k == 3) for k in range(9)], "u int, c int, y double, n double, alone boolean")
    base = spark.createDataFrame([(k, 2020, 0.3 + 0.02 * k, "ok" if k else "off") for k in range(9)], "u int, c int, b double, q string")
    panel = environment.basis_panel(own, base, ["u"], "c", "y", "n", "alone", "b", "q")
    assert panel.count() == 7
    few = environment.basis_map(panel, "c").first()
    assert (few.status, few.n) == ("unfitted", 7)
    r = environment.basis_map(panel, "c", 5).first()
    assert math.isclose(r.slope, 0.5, rel_tol=1e-9) and r.loco_sd is None
    moved = spark.range(1).select(environment.on_own_basis(F.lit(0.6), 0.4, 0.5, r.intercept, r.slope).alias("v")).first().v
    assert math.isclose(moved, 0.5 + r.intercept + 0.1, rel_tol=1e-9)


def test_empty_environment(spark):
    none = spark.createDataFrame([], "s double, n int, p string, e date, o date")
    assert tuple(environment.generic_ballot(none, "2026-10-20", None, "s", "n", "p", "e", "o", F.lit(1.0)).first()) == ("unavailable", None, None, 0)
    assert environment.specials_band(none.select(F.col("s").alias("a"), F.col("s").alias("b")), "a", "b", 0.5).collect() == []
    flat = spark.createDataFrame([("x", "low", 0.6), ("x", "high", 0.7), ("y", "low", 0.4), ("y", "high", 0.6), ("z", "low", 0.1)], "chamber string, assumption string, p double")
    assert {r.chamber: (r.conclusion, r.favoured_at) for r in environment.control_conclusion(flat, "chamber", "p").collect()} == {"x": ("first", None), "y": ("depends", "high"), "z": ("second", None)}


def passed(df, rules, keys=None):
    return {r.check_name for r in checks.report(df, rules, keys).collect() if not r.passed}


def test_gate_of_specials(spark):
    good = dict(special_id="a", state_po="PA", office="us_house", district="1", include_in_metric=True, source_url="https://x", retrieved_on="2026-01-02", baseline_source="s", election_date="2026-01-01", results_updated_on="2026-01-02", dem_votes=600, rep_votes=500, other_votes=0, contest_format="partisan", exclusion_reason=None, baseline_dem_share=0.5)
    schema = "special_id string, state_po string, office string, district string, include_in_metric boolean, source_url string, retrieved_on string, baseline_source string, election_date string, results_updated_on string, dem_votes int, rep_votes int, other_votes int, contest_format string, exclusion_reason string, baseline_dem_share double"
    frame = lambda **change: spark.createDataFrame([tuple({**good, **change}.values())], schema)
    rules = gates.specials(["us_house"], ["partisan", "unknown"], 1000, "2026-06-01")
    assert passed(frame(), rules, ["special_id"]) == set()
    assert passed(frame(include_in_metric=False, exclusion_reason="placeholder", source_url=None, dem_votes=0, baseline_dem_share=None), rules) == set()
    assert passed(frame(source_url=" ", rep_votes=0, election_date="2027-01-01", contest_format="x"), rules) == {"source_url_present", "both_parties", "total_plausible", "date_valid", "update_after_election", "format_known"}
    twice = frame().unionByName(frame(special_id="b"))
    assert passed(twice.where("include_in_metric"), {}, gates.SEAT) == {"unique_key"}


def test_gate_of_snapshots_and_catalog(spark):
    good = dict(state_po="pa", office="us_house", district_num=1.0, dem_votes=1.0, rep_votes=2.0, other_votes=0.0, source_url="https://x.gov/a", retrieved_on="2026-11-04", certified=True, election_round=None, outcome_resolved=None, winner_party=None)
    schema = "state_po string, office string, district_num double, dem_votes double, rep_votes double, other_votes double, source_url string, retrieved_on string, certified boolean, election_round string, outcome_resolved boolean, winner_party string"
    frame = lambda **change: spark.createDataFrame([tuple({**good, **change}.values())], schema)
    rules = gates.snapshot(STATES)
    assert passed(frame(), rules, ["state_po", "office", "district_num"]) == set()
    assert passed(frame(state_po="DC", retrieved_on="04.11.2026", dem_votes=1.5, district_num=None, certified=None), rules) == {"state_known", "retrieved_on_iso_date", "votes_are_counts", "district_for_house", "certified_stated"}
    assert passed(frame(state_po="LA"), rules) == {"louisiana_round", "louisiana_resolved_stated"}
    assert passed(frame(state_po="LA", election_round="runoff", outcome_resolved=False), rules) == set()
    source = spark.createDataFrame([(s, "https://a.gov/x", "https://b.gov/y", "untested", "law", "", "") for s in STATES[:3]], "state_po string, primary_url string, fallback_url string, extraction_status string, certification_evidence string, download_access string, extraction_evidence string")
    sources = gates.catalog(["untested", "tested"], ["untested", "ok"], ["tested"])
    assert passed(source, sources, ["state_po"]) == set()
    assert passed(source.withColumns({"fallback_url": F.lit("http://b"), "extraction_status": F.lit("tested")}), sources) == {"fallback_is_https", "tested_has_evidence"}
    assert tuple(gates.covers(source, "state_po", STATES[:4]).first()) == (False, 1, 0) and gates.covers(source, "state_po", STATES[:3]).first().passed
    links = spark.createDataFrame([("a", "token_set"), (None, "ambiguous_last_first"), ("b", "ambiguous_last_first"), (None, "guess")], "candidate_id string, match_method string")
    assert {r.check_name: r.n_bad for r in checks.report(links, gates.crosswalk(["token_set", "none"])).collect()} == {"method_known": 1, "ambiguous_unmatched": 1, "not_empty": 0}


def test_small_operators(spark):
    bands = spark.createDataFrame([(0.1, 0.3), (0.2, 0.5)], "lo double, hi double")
    assert tuple(evaluation.realised_against(bands, 0.4, "lo", "hi").first()) == (1, 2, False)
    assert evaluation.realised_against(bands, 0.9, "lo", "hi").first().failed
    flags = spark.createDataFrame([("a", "ok"), ("a", "bad"), ("b", "ok")], "k string, f string")
    assert {r.k: r.f for r in allocation.worst_of(flags, ["k"], "f", ["bad", "ok"]).collect()} == {"a": "bad", "b": "ok"}
    areas = spark.createDataFrame([("x",)], "k string")
    assert tuple(allocation.usable(0.95, areas, areas.unionByName(spark.createDataFrame([("y",)], "k string")), "k").first()) == (False, 0.95, 1)
    assert allocation.usable(0.95, areas, areas, "k").first().usable and not allocation.usable(0.5, areas, areas, "k").first().usable
    filled = windows.spread_known(spark.createDataFrame([("a", None), ("a", "q"), ("b", None)], "k string, v string"), ["k"], "v").collect()
    assert sorted((r.k, r.v or "") for r in filled) == [("a", "q"), ("a", "q"), ("b", "")]
    share = seats.regional_scenario(spark.createDataFrame([("n", 0.5), ("s", 0.9), (None, 0.2)], "r string, y double"), spark.createDataFrame([("n", -0.1), ("s", 0.4)], "r string, x double"), "r", "y", "x", 0.5).collect()
    assert {r.r: round(r.scenario_share, 6) for r in share} == {"n": 0.45, "s": 1.0, None: 0.2}
    roster = spark.createDataFrame([("D", 1), ("D", 2), ("R", 2), ("R", 3)], "party string, c int")
    assert {r.party: (r.up, r.held_over, r.complete) for r in seats.scheduled(roster, "c", 2026, 4).collect()} == {"D": (1, 1, True), "R": (1, 1, True)}


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_streams_end_in_a_table(spark, tmp_path, mode):
    from psephos.streaming import sink

    schema = spark.createDataFrame([(1, 2)], "k int, v int").schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    stream = stream if mode == "append" else stream.groupBy("k").agg(F.sum("v").alias("v"))
    assert sink.finished(stream, mode).collect() == []
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text(f"1,{k}\n2,{k}\n")
    found = sorted(tuple(r) for r in sink.finished(stream, mode).collect())
    assert found == ([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)] if mode == "append" else [(1, 3), (2, 3)])


def test_panel_is_computed_once(spark):
    from psephos.plans import timing

    assert all("/panel-" in f for f in timing.panel(spark, "/root/testdata/sf0.001").inputFiles())
