import math

import pytest
from pyspark.sql import functions as F

from psephos.operators import builds, observed, sealed

PREDICTION = "k string, share double, sigma double, p double, office string"


@pytest.fixture(scope="module")
def case(spark):
    rows = [("s1", 0.6, 0.05, 0.9, "house"), ("s2", 0.4, 0.05, 0.2, "senate"), ("s3", 0.5, 0.05, 0.5, "house"), ("s4", 0.7, 0.02, 1.0, "house")]
    pred = spark.createDataFrame(rows, PREDICTION)
    actual = spark.createDataFrame([("s1", 0.55, True, "2026-11-10"), ("s2", 0.52, True, "2026-12-20"), ("s4", 0.6, False, "2026-11-12"), ("s9", 0.6, True, "2026-11-12")], "k string, actual_share double, actual_win boolean, certified_on string")
    return pred, actual, sealed.registration(pred, "k", "first", "2026-10-20")


def test_scores(spark, case):
    pred, actual, seal = case
    got = {(r.split, r.level): r for r in sealed.scores(pred, seal, actual, "k", ["office"], "2026-12-01", pred).collect()}
    assert {k: r.n for k, r in got.items()} == {("overall", "all"): 2, ("office", "house"): 2}
    one = got["overall", "all"]
    assert abs(one.mae - 0.075) < 1e-12 and abs(one.brier - (0.01 + 1) / 2) < 1e-12 and abs(one.log_score - (-math.log(0.9) - math.log(1e-6)) / 2) < 1e-6
    assert one.called == 0.5 and one.coverage_90 == 0.5
    counts = {r.status: r.n for r in sealed.coverage(pred, actual, "k", "2026-12-01").collect()}
    assert counts == {"scored": 2, "not_certified": 1, "no_result": 1, "not_sealed": 1}
    early = sealed.registration(pred, "k", "late", "2026-11-11")
    assert sealed.scores(pred, early, actual, "k", [], "2026-12-01").first().n == 1


@pytest.mark.parametrize("change", ["value", "missing", "added", "last bit"])
def test_any_change_is_refused(spark, case, change):
    pred, actual, seal = case
    changed = {
        "value": lambda: pred.withColumn("p", F.when(F.col("k") == "s3", 0.1).otherwise(F.col("p"))),
        "missing": lambda: pred.where("k <> 's2'"),
        "added": lambda: pred.unionByName(pred.where("k = 's2'").withColumn("k", F.lit("s7"))),
        "last bit": lambda: pred.withColumn("share", F.when(F.col("k") == "s1", math.nextafter(0.6, 1)).otherwise(F.col("share"))),
    }[change]()
    with pytest.raises(Exception, match="differ from the sealed"):
        sealed.scores(changed, seal, actual, "k", [], "2026-12-01").collect()


def test_order_and_other_columns_do_not_matter(spark, case):
    pred, actual, seal = case
    again = pred.orderBy(F.desc("k")).repartition(3).select("office", "p", "sigma", "share", "k")
    assert sealed.verified(again, seal, "k").count() == 4
    with pytest.raises(Exception, match="sealed twice"):
        sealed.registration(pred.unionByName(pred), "k", "x", "2026-01-01").collect()


def test_written_counts_in_one_job(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.read.parquet(f"{tmp_path}/in")
    spark.sparkContext.setJobGroup("observed", "observed")
    counts = observed.written(source, f"{tmp_path}/out", {"n": F.count(F.lit(1)), "sevens": F.count_if(F.col("v") == 0)}, F.col("v") > 0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed")) == 1
    assert counts == {"n": 1000, "sevens": 143} and spark.read.parquet(f"{tmp_path}/out").count() == 857


def test_a_failed_gate_publishes_nothing(spark, tmp_path):
    rules = {"small": F.col("id") < 5, "known": F.col("id").isNotNull()}
    assert observed.gated(spark.range(5), f"{tmp_path}/good", rules) == [("small", True, 0), ("known", True, 0), ("not_empty", True, 0)]
    assert observed.gated(spark.range(7), f"{tmp_path}/bad", rules)[0] == ("small", False, 2)
    assert observed.gated(spark.range(0), f"{tmp_path}/none", rules)[2] == ("not_empty", False, 1)
    assert [p.name for p in tmp_path.iterdir() if "unchecked" not in p.name] == ["good"]
    with pytest.raises(FileExistsError):
        observed.gated(spark.range(5), f"{tmp_path}/good", rules)


def test_builds_run_what_has_changed(spark, tmp_path):
    runs = []

    def step(name, inputs, make, **more):
        def counted(*tables):
            runs.append(name)
            return make(*tables)

        return builds.Step(name, inputs, counted, **more)

    steps = [
        step("joined", ["doubled", "other"], lambda a, b: a.join(b, "id")),
        step("doubled", ["base"], lambda t: t.withColumn("v", F.col("id") * 2), rules={"even": F.col("v") % 2 == 0}),
        step("apart", ["other"], lambda t: t.select((F.col("id") + 1).alias("x"))),
    ]
    tables = {"base": spark.range(6), "other": spark.range(4)}
    first = builds.build(spark, str(tmp_path), steps, tables)
    assert {o.status for o in first.values()} == {"published"} and sorted(runs) == ["apart", "doubled", "joined"]
    assert spark.read.parquet(first["joined"].path).count() == 4
    files = sorted(p for p in tmp_path.rglob("*") if p.is_file())
    runs.clear()
    again = builds.build(spark, str(tmp_path), steps, {"base": spark.range(6).orderBy(F.desc("id")).repartition(3), "other": spark.range(4)})
    assert {o.status for o in again.values()} == {"reused"} and not runs and sorted(p for p in tmp_path.rglob("*") if p.is_file()) == files
    third = builds.build(spark, str(tmp_path), steps, tables | {"base": spark.range(7)})
    assert {n: o.status for n, o in third.items()} == {"doubled": "published", "joined": "published", "apart": "reused"} and sorted(runs) == ["doubled", "joined"]
    bad = [step("doubled", ["base"], lambda t: t.withColumn("v", F.col("id")), rules={"even": F.col("v") % 2 == 0}, version="2"), steps[0], steps[2]]
    fourth = builds.build(spark, str(tmp_path), bad, tables)
    assert {n: o.status for n, o in fourth.items()} == {"doubled": "refused", "joined": "blocked", "apart": "reused"} and fourth["doubled"].checks[0] == ("even", False, 3)
    for wrong in ([steps[0]], [builds.Step("a", ["b"], None), builds.Step("b", ["a"], None)]):
        with pytest.raises(ValueError):
            builds.build(spark, str(tmp_path), wrong, tables)
