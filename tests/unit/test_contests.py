import pytest

from psephos.operators import collapse, reconcile


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_total_row_beside_breakdowns_and_breakdowns_only(spark):
    df = spark.createDataFrame([("r", "x", "TOTAL", 10), ("r", "x", "mail", 4), ("r", "y", "mail", 3), ("r", "y", "day", None), ("r", "z", None, 7)], "race string, cand string, mode string, votes int")
    assert rows(collapse.collapse_modes(df, ["race", "cand"], "mode", "votes").drop("n_rows")) == [("r", "x", 10), ("r", "y", 3), ("r", "z", 7)]


def test_party_lines_merge_under_the_major_label(spark):
    df = spark.createDataFrame([("r", "x", "OTHER", 50), ("r", "x", "DEMOCRAT", 40), ("r", "y", "REPUBLICAN", 80), ("r", "", "OTHER", 1), ("r", "", "OTHER", 2)], "race string, cand string, party string, votes int")
    found = rows(collapse.collapse_party_lines(df, "race", "cand", "party", "votes", ["DEMOCRAT", "REPUBLICAN"]))
    assert ("r", "x", "DEMOCRAT", 90, True) in found and ("r", "y", "REPUBLICAN", 80, False) in found
    assert len(found) == 4


def test_unreported_counts_are_null_and_the_winner_stays(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("r", "x", "D", 1, -1)], "race string, cand string, party string, votes int, total int")
    df = df.withColumns({"total": collapse.unreported_to_null(F.col("total"))})
    masked = collapse.mask_unreported(df, "race", "total", "votes")
    race = collapse.roll_up_races(masked, "race", "cand", "party", "votes", "D", "R").first()
    assert race.winner == "x" and race.total_votes is None and race.two_party_share is None and race.n_candidates == 0


def test_roll_up_with_ties_and_one_candidate(spark):
    df = spark.createDataFrame([("a", 2, "D", 5), ("a", 1, "R", 5), ("b", 1, "D", 3)], "race string, cand int, party string, votes int")
    a, b = collapse.roll_up_races(df, "race", "cand", "party", "votes", "D", "R").orderBy("race").collect()
    assert (a.winner, a.runner_up, a.margin_votes, a.two_party_share) == (1, 2, 0, 0.5)
    assert (b.winner, b.runner_up, b.runner_up_votes, b.margin_share) == (1, None, 0, 1.0)
    assert collapse.roll_up_races(df.limit(0), "race", "cand", "party", "votes", "D", "R").collect() == []


def test_reconciles_under_either_convention(spark):
    votes = spark.createDataFrame([("ok", 90, True), ("ok", 10, False), ("both", 90, True), ("both", 10, False), ("bad", 300, True), ("none", 5, True)], "race string, v int, p boolean")
    totals = spark.createDataFrame([("ok", 90), ("both", 100), ("bad", 150), ("none", 0)], "race string, t int")
    found = reconcile.unreconciled(votes, totals, "race", "v", "p", "t").collect()
    assert [(r.race, r.difference, r.reason) for r in found] == [("bad", 150, "multiple_rounds")]


def test_general_stage(spark, tmp_path):
    rows = spark.createDataFrame([("GEN",), ("pri",), (None,)], "stage string")
    assert collapse.write_general_stage(rows, f"{tmp_path}/kept", "stage", ["gen"]) == {"kept": 2, "dropped_non_general": 1}
    assert sorted(r.stage or "" for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == ["", "GEN"]



def test_null_keys_match_in_set_operations(spark):
    a = spark.createDataFrame([("x", None), ("y", 1)], "s string, d int")
    b = spark.createDataFrame([("x", None), ("z", 2)], "s string, d int")
    assert rows(reconcile.set_differences(a, b, ["s", "d"])) == [("y", 1, "missing"), ("z", 2, "extra")]
    assert {r.status for r in reconcile.outer_status(a, b, ["s", "d"]).collect()} == {"both", "left_only", "right_only"}
    assert rows(reconcile.refuse_repeated(a.unionByName(a.limit(1)), ["s", "d"])) in ([("y", 1)], [("x", None)])
    checked = reconcile.benchmark_check(a, b, ["s"], "d").orderBy("s").collect()
    assert [r.passed for r in checked] == [False, False]


def test_validated_join_refuses_repeats(spark):
    from psephos.operators import joins

    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="repeat"):
        joins.validated(a, a.unionByName(a).withColumnRenamed("k", "k"), ["k"]).collect()
    assert joins.validated(a, a, ["k"], expect="one_to_one").count() == 2
