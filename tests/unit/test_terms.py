import datetime
import random

from pyspark.sql import functions as F

from psephos.operators import terms

CONTEST = "seat string, held_on date, source string, holder string, party string, takes_office date"


def d(text):
    return datetime.date.fromisoformat(text)


def frame(spark, rows):
    return spark.createDataFrame([(s, d(h), k, w, "D", d(t) if t else None) for s, h, k, w, t in rows], CONTEST)


def gone(spark, *rows):
    return spark.createDataFrame([(s, d(x)) for s, x in rows], "seat string, left_on date")


def days(spark, contests, departures, start="2015-01-01", end="2027-01-01", seats=None):
    out = terms.effective(terms.contest_terms(frame(spark, contests), 6), departures, start, end, seats)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.seat, r.valid_from)):
        found.setdefault(r.seat, []).append((str(r.valid_from), str(r.valid_until), r.holder, r.source, r.status, r.n_terms))
    return found


def test_specials_and_unexpired_terms(spark):
    """A senator resigns, one is appointed, a special election fills the rest of the term, the winner is elected anew."""
    contests = [
        ("GA", "2016-11-08", "regular", "Isakson", None),
        ("GA", "2019-12-04", "appointed", "Loeffler", "2020-01-06"),
        ("GA", "2021-01-05", "special", "Warnock", "2021-01-20"),
        ("GA", "2022-11-08", "regular", "Warnock", None),
    ]
    assert days(spark, contests, gone(spark, ("GA", "2019-12-31")))["GA"] == [
        ("2015-01-01", "2017-01-03", None, None, "unknown", 0),
        ("2017-01-03", "2019-12-31", "Isakson", "regular", "held", 1),
        ("2019-12-31", "2020-01-06", None, None, "vacant", 0),
        ("2020-01-06", "2021-01-20", "Loeffler", "appointed", "held", 1),
        ("2021-01-20", "2027-01-01", "Warnock", "special", "held", 2),
    ]


def test_a_runoff_decides_the_even_year_and_gaps_have_names(spark):
    contests = [("X", "2021-01-05", "regular", "Ossoff", None), ("Y", "2010-11-02", "regular", "Old", None), ("Z", "2018-05-01", "special", "Stray", None)]
    found = days(spark, contests, gone(spark), seats=spark.createDataFrame([("W",)], "seat string"))
    assert found["X"][1] == ("2021-01-03", "2027-01-01", "Ossoff", "regular", "held", 1)
    assert found["Y"] == [("2015-01-01", "2017-01-03", "Old", "regular", "held", 1), ("2017-01-03", "2027-01-01", None, None, "unknown", 0)]
    assert found["Z"][-1][:3] == ("2018-05-01", "2027-01-01", "Stray")
    assert found["W"] == [("2015-01-01", "2027-01-01", None, None, "unknown", 0)]


def test_every_day_once_as_day_by_day(spark):
    """Random contests against a walk over the days."""
    rng = random.Random(5)
    contests, left = [], []
    for seat in "ABCDEF":
        for year in range(2008, 2026, 2):
            if rng.random() < 0.5:
                contests.append((seat, f"{year}-11-05", "regular", rng.choice("pqr"), None))
        for _ in range(4):
            day = f"{rng.randrange(2010, 2026)}-0{rng.randrange(1, 9)}-15"
            contests.append((seat, day, rng.choice(["special", "appointed"]), rng.choice("pqr"), None))
            left.append((seat, f"{rng.randrange(2010, 2026)}-0{rng.randrange(1, 9)}-1{rng.randrange(4, 7)}"))
    found = days(spark, contests, gone(spark, *left), "2009-01-01", "2026-01-01")
    known = {}
    for r in terms.contest_terms(frame(spark, contests), 6).collect():
        known.setdefault(r.seat, []).append(r)
    for seat, spells in found.items():
        assert spells[0][0] == "2009-01-01" and spells[-1][1] == "2026-01-01"
        assert all(a[1] == b[0] for a, b in zip(spells, spells[1:], strict=False))
        exits = {d(x) for s, x in left if s == seat}
        starts = {}
        for r in sorted(known[seat], key=lambda r: (terms.SOURCES.index(r.source), r.holder)):
            starts.setdefault(r.valid_from, r)
        now, day, at = None, min([d("2009-01-01"), *starts]), {}
        while day < d("2026-01-01"):
            if day in exits:
                now = None
            if now is not None and now.valid_until is not None and day >= now.valid_until:
                now = None
            now = starts.get(day, now)
            at[day] = now.holder if now is not None else None
            day += datetime.timedelta(days=1)
        for a, b, holder, *_ in spells:
            day = d(a)
            while day < d(b):
                assert at[day] == holder, (seat, day, holder, at[day])
                day += datetime.timedelta(days=1)


def test_universe_and_cycles(spark):
    seats = spark.createDataFrame([("TX1", "us_house", "TX", 1), ("TX2", "us_house", "TX", 2), ("TXs", "us_senate", "TX", None), ("MEs", "us_senate", "ME", None), ("OHs", "us_senate", "OH", None)], "seat string, office string, state string, district int")
    results = spark.createDataFrame(
        [("TX1", "us_house", 2024, False, "Ann", "D", 0.6), ("TX2", "us_house", 2022, False, "Bob", "R", None), ("TX2", "us_house", 2020, False, "Cy", "R", 0.4), ("TXs", "us_senate", 2020, False, "Dee", "R", 0.45), ("MEs", "us_senate", 2024, False, "Eli", "D", 0.5), ("OHs", "us_senate", 2022, False, "Vic", "R", 0.47)],
        "seat string, office string, cycle int, special boolean, winner string, winner_party string, share double",
    )
    contests = frame(spark, [("TX1", "2024-11-05", "regular", "Ann", None), ("TXs", "2020-11-03", "regular", "Dee", None), ("OHs", "2022-11-08", "regular", "Vic", None), ("OHs", "2025-01-18", "appointed", "Jon", "2025-01-21")])
    held = terms.effective(terms.contest_terms(contests, F.when(F.col("seat").endswith("s"), 6).otherwise(2)), gone(spark, ("OHs", "2025-01-10")), "2015-01-01", "2030-01-01", seats)
    bounds = spark.createDataFrame([("TX", "redrawn", "active")], "state string, boundary_confidence string, litigation_risk string")
    universe = terms.race_universe(seats, held, results, 2026, {"us_house": 2, "us_senate": 6}, spark.createDataFrame([("OHs",)], "seat string"), bounds)
    rows = {r.race_key: r for r in universe.collect()}
    assert set(rows) == {"2026_us_house_tx_01", "2026_us_house_tx_02", "2026_us_senate_tx", "2026_us_senate_oh"}
    one, two, oh = rows["2026_us_house_tx_01"], rows["2026_us_house_tx_02"], rows["2026_us_senate_oh"]
    assert (one.incumbent_name, one.incumbent_source, one.prior_source, one.boundary_confidence, str(one.election_date)) == ("Ann", "regular_term", "last_result_2024", "redrawn", "2026-11-03")
    assert (two.incumbent_name, two.incumbent_source, two.prior_dem_share, two.prior_source) == ("Bob", "earlier_regular_winner_unknown", 0.4, "last_result_2020")
    assert (oh.election_type, oh.incumbent_name, oh.incumbent_source, oh.boundary_confidence) == ("special", "Jon", "appointed_term", "n/a")
    counts = {(r.measure, r.value): r.n for r in terms.coverage(universe).collect()}
    assert counts["seats_total", "yes"] == 4 and counts["office", "us_house"] == 2 and counts["prior_known", "yes"] == 4
    returns = results.select("office", "cycle", F.substring("seat", 1, 2).alias("state"), "special")
    table = {(r.cycle, r.office): r for r in terms.cycle_table(returns, spark.createDataFrame([(2026,), (2028,)], "cycle int"), 435).collect()}
    assert len(table) == 8 and table[2026, "us_senate"].seats == 1 and table[2026, "president"].election_type == "not_held" and table[2028, "president"].seats == 1
    assert table[2028, "us_senate"].seats == 1 and table[2026, "governor"].seats is None and table[2026, "us_house"].seats == 435
    assert [r.state for r in terms.up_states(returns.where("office = 'us_senate'"), 2026, 6).collect()] == ["TX"]
