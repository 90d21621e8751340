"""Queries of sealed forecasts and composed builds. Orders play contests: a forecast from the price, a result from the customer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builds, sealed, windows
from ..sources import staging
from .catalog import register, table
from .timing import MONTHS_SQL

_REGISTERED, _AS_OF = "1996-06-30", "1999-12-31"
_SEALED_SQL = """p AS (SELECT o_orderkey AS k, least(1, o_totalprice / 500000) AS share, 0.05 + (o_orderkey % 5) / 20.0 AS sigma, (o_orderkey % 97) / 97.0 AS pr, o_orderpriority AS priority, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0),
    a AS (SELECT o_orderkey AS k, (o_custkey % 100) / 100.0 AS actual, (o_custkey % 100) / 100.0 > 0.5 AS win, CAST(o_orderdate AS DATE) AS certified FROM orders WHERE o_orderkey % 4 <> 1)"""


def _forecast(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pred = o.where(k % 3 != 0).select(k.alias("k"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("share"), (0.05 + (k % 5) / 20.0).alias("sigma"), ((k % 97) / 97.0).alias("p"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    actual = o.where(k % 4 != 1).select(k.alias("k"), (F.col("o_custkey") % 100 / 100.0).alias("actual_share"), (F.col("o_custkey") % 100 > 50).alias("actual_win"), F.col("o_orderdate").cast("date").alias("certified_on"))
    return pred, actual


@register(
    "sealed_scores",
    f"""WITH {_SEALED_SQL}, s AS (SELECT p.*, a.actual, a.win::INT AS y, share - actual AS e, least(greatest(pr, 1e-6), 1 - 1e-6) AS c FROM p JOIN a ON a.k = p.k WHERE certified <= DATE '{_AS_OF}' AND certified > DATE '{_REGISTERED}'),
    g AS (SELECT 'overall' AS split, 'all' AS level, * FROM s UNION ALL SELECT 'priority', priority, * FROM s UNION ALL SELECT 'status', status, * FROM s)
    SELECT split, level, count(*) AS n, round(avg(abs(e)), 7) AS mae, round(sqrt(avg(e * e)), 7) AS rmse, round(avg((pr - y) * (pr - y)), 7) AS brier, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_score,
        round(avg(CASE WHEN (pr > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 7) AS called, round(avg(CASE WHEN abs(e) <= {sealed.Z90} * sigma THEN 1.0 ELSE 0.0 END), 7) AS coverage_90 FROM g GROUP BY split, level""",
)
def sealed_scores(spark, sf_dir):
    """A forecast is registered, stored, and scored by its splits after its digest has been computed anew from the scored rows."""
    pred, actual = _forecast(spark, sf_dir)
    kept = staging.stored(pred, "forecast")
    seal = staging.stored(sealed.registration(pred, "k", "orders", _REGISTERED), "registration")
    out = sealed.scores(kept, seal, actual, "k", ["priority", "status"], _AS_OF, kept)
    return out.select("split", "level", "n", *(F.round(c, 7).alias(c) for c in ("mae", "rmse", "brier")), F.round("log_score", 6).alias("log_score"), *(F.round(c, 7).alias(c) for c in ("called", "coverage_90")))


@register(
    "sealed_coverage",
    f"WITH {_SEALED_SQL} SELECT CASE WHEN p.k IS NULL THEN 'not_sealed' WHEN a.k IS NULL THEN 'no_result' WHEN certified <= DATE '{_AS_OF}' THEN 'scored' ELSE 'not_certified' END AS status, count(*) AS n FROM p FULL JOIN a ON a.k = p.k GROUP BY 1",
)
def sealed_coverage(spark, sf_dir):
    pred, actual = _forecast(spark, sf_dir)
    return sealed.coverage(pred, actual, "k", _AS_OF)


def _steps() -> list[builds.Step]:
    """Monthly totals, their yearly growth, nations' totals, and nations beside the growth of the last month."""

    def monthly(orders):
        return orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("value"))

    def growth(months):
        return windows.growth(months.withColumn("_k", F.lit(1)), ["_k"], "month", "value").drop("_k")

    def nations(orders, customers):
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("o_totalprice").alias("total"))

    def report(totals, grown):
        last = grown.agg(F.max_by("growth", "month").alias("growth"), F.count("growth").alias("n_months"))  # one row
        return totals.crossJoin(F.broadcast(last))

    return [
        builds.Step("report", ["nations", "growth"], report, {"total_known": F.col("total").isNotNull()}),
        builds.Step("growth", ["monthly"], growth),
        builds.Step("monthly", ["orders"], monthly, {"positive": F.col("value") > 0}),
        builds.Step("nations", ["orders", "customer"], nations, {"positive": F.col("total") > 0}),
    ]


@register(
    "composed_build",
    f"""WITH m AS ({MONTHS_SQL}), g AS (SELECT a.month, ln(a.value / b.value) AS growth FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 12 MONTH),
    l AS (SELECT (SELECT growth FROM g ORDER BY month DESC LIMIT 1) AS growth, (SELECT count(growth) FROM g) AS n_months)
    SELECT c_nationkey AS nation, round(sum(o_totalprice), 2) AS total, round(any_value(growth), 9) AS growth, any_value(n_months) AS n_months, 'published' AS first_run, 'reused' AS second_run FROM orders JOIN customer ON o_custkey = c_custkey, l GROUP BY 1""",
)
def composed_build(spark, sf_dir):
    """The report of a build of four staged tables, with what became of it in the first and in a second run."""
    root = f"{staging.shared_dir(spark)}/build-{uuid.uuid4().hex}"
    tables = {"orders": table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice"), "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")}
    first, second = (builds.build(spark, root, _steps(), tables) for _ in range(2))
    said = lambda outcomes: F.lit(",".join(sorted({o.status for o in outcomes.values()})))
    rows = spark.read.parquet(second["report"].path)
    return rows.select("nation", F.round("total", 2).alias("total"), F.round("growth", 9).alias("growth"), "n_months", said(first).alias("first_run"), said(second).alias("second_run"))
