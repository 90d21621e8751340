"""Queries of allocation, regression, evaluation and simulation. Nations play counties, market segments districts, suppliers blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation, bootstrap, evaluation, regression, simulation
from ..sources import staging
from .catalog import register, table

LINES_SQL = """SELECT c_nationkey AS county, c_mktsegment AS district, c_custkey AS precinct, l_returnflag AS flag, l_quantity AS votes, l_partkey, l_suppkey
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"""


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("county"), F.col("c_mktsegment").alias("district"), F.col("c_custkey").alias("precinct"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("votes"), "l_partkey", "l_suppkey"
    )


@register(
    "precinct_resolution",
    "WITH g AS (SELECT l_suppkey, count(DISTINCT CASE WHEN l_quantity > 49 THEN l_returnflag END) AS n_areas, min(CASE WHEN l_quantity > 49 THEN l_returnflag END) AS a FROM lineitem GROUP BY 1) SELECT l_suppkey, n_areas, CASE WHEN n_areas = 1 THEN a END AS l_returnflag, CASE WHEN n_areas = 1 THEN 'single' WHEN n_areas > 1 THEN 'ambiguous' ELSE 'silent' END AS status FROM g",
)
def precinct_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity") - 49)
    return allocation.resolve_units(rows, ["l_suppkey"], "l_returnflag", "v")


WEIGHTS_SQL = f"""SELECT county, district, sum(votes) AS w, 'preferred' AS weight_source FROM ({LINES_SQL}) WHERE flag = 'A' AND county % 5 <> 0 GROUP BY 1, 2
    UNION ALL SELECT county, district, sum(votes), 'fallback' FROM ({LINES_SQL}) WHERE flag = 'R' AND county % 5 = 0 AND county <> 10 GROUP BY 1, 2"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ballots(spark, sf_dir).groupBy("county", "district", "flag").agg(F.sum("votes").alias("w"))
    preferred = b.where("flag = 'A' and county % 5 <> 0").drop("flag")
    return allocation.gap_filled(preferred, b.where("flag = 'R' and county <> 10").drop("flag"), ["county"])


@register("weight_gap_fill", f"SELECT county, district, w, weight_source FROM ({WEIGHTS_SQL})")
def weight_gap_fill(spark, sf_dir):
    return weights(spark, sf_dir)


COUNTY_SQL = f"SELECT county, sum(votes) AS votes FROM ({LINES_SQL}) WHERE flag = 'N' GROUP BY 1"


@register("county_allocation", f"WITH w AS ({WEIGHTS_SQL}) SELECT county, w.district, round(v.votes * w.w / sum(w.w) OVER (PARTITION BY county), 6) AS votes FROM w JOIN ({COUNTY_SQL}) v USING (county)")
def county_allocation(spark, sf_dir):
    votes = ballots(spark, sf_dir).where("flag = 'N'").groupBy("county").agg(F.sum("votes").alias("votes"))
    placed, _ = allocation.allocate(votes, weights(spark, sf_dir).select("county", "district", "w"), ["county"], "district", "votes", "w")
    return placed.select("county", "district", F.round("votes", 6).alias("votes"))


@register("unallocatable", f"SELECT county, votes FROM ({COUNTY_SQL}) WHERE county NOT IN (SELECT county FROM ({WEIGHTS_SQL}))")
def unallocatable(spark, sf_dir):
    votes = ballots(spark, sf_dir).where("flag = 'N'").groupBy("county").agg(F.sum("votes").alias("votes"))
    return allocation.allocate(votes, weights(spark, sf_dir).select("county", "district", "w"), ["county"], "district", "votes", "w")[1]


@register(
    "district_baseline",
    f"""WITH d AS (SELECT district, flag, sum(votes) AS v FROM ({LINES_SQL}) GROUP BY 1, 2), g AS (SELECT district, sum(v) FILTER (WHERE flag = 'A') AS a, sum(v) FILTER (WHERE flag = 'R') AS b, sum(v) FILTER (WHERE flag = 'N') AS n FROM d GROUP BY 1),
    s AS (SELECT district, a + n / 2 AS a, b + n / 2 AS b, n / (a + b + n) AS allocated_share, a + b + n AS t FROM g)
    SELECT district, a, b, round(allocated_share, 9) AS allocated_share, round(t / median(t) OVER (), 9) AS size_ratio, CASE WHEN t / median(t) OVER () < 0.5 THEN 'low_total' WHEN allocated_share > 0.5 THEN 'mostly_allocated' ELSE 'ok' END AS quality FROM s""",
)
def district_baseline(spark, sf_dir):
    v = ballots(spark, sf_dir).groupBy("district", "flag").agg(F.sum("votes").alias("v"))
    direct = v.groupBy("district").agg(F.sum(F.when(F.col("flag") == "A", F.col("v"))).alias("a"), F.sum(F.when(F.col("flag") == "R", F.col("v"))).alias("b"))
    other = v.where("flag = 'N'").select("district", (F.col("v") / 2).alias("a"), (F.col("v") / 2).alias("b"))
    out = allocation.baseline(direct, other, ["district"], ["a", "b"])
    return out.select("district", "a", "b", F.round("allocated_share", 9).alias("allocated_share"), F.round("size_ratio", 9).alias("size_ratio"), "quality")


@register(
    "block_apportion",
    """WITH b AS (SELECT s_nationkey % 5 AS region, s_nationkey AS unit, s_suppkey AS block, CASE WHEN s_nationkey % 7 = 0 THEN 0 ELSE s_suppkey % 10 END AS pop FROM supplier WHERE s_nationkey % 3 <> 0),
    v AS (SELECT c_nationkey % 5 AS region, c_nationkey AS unit, CAST(count(*) AS DOUBLE) AS votes FROM customer GROUP BY 1, 2),
    u AS (SELECT *, sum(pop) OVER (PARTITION BY region, unit) AS tp, count(*) OVER (PARTITION BY region, unit) AS n FROM b),
    f AS (SELECT u.region, u.block, sum(v.votes * CASE WHEN tp > 0 THEN pop / tp ELSE 1.0 / n END) AS x FROM u JOIN v ON v.region = u.region AND v.unit = u.unit GROUP BY 1, 2),
    r AS (SELECT region, sum(votes) AS rest FROM v WHERE (region, unit) NOT IN (SELECT region, unit FROM b) GROUP BY 1),
    e AS (SELECT b.region, b.block, coalesce(f.x, 0) AS x, sum(coalesce(f.x, 0)) OVER w AS t, CASE WHEN sum(b.pop) OVER w > 0 THEN b.pop / sum(b.pop) OVER w ELSE 1.0 / count(*) OVER w END AS s
        FROM b LEFT JOIN f ON f.region = b.region AND f.block = b.block WINDOW w AS (PARTITION BY b.region))
    SELECT coalesce(e.region, r.region) AS region, e.block, round(coalesce(e.x + coalesce(r.rest, 0) * CASE WHEN e.t > 0 THEN e.x / e.t ELSE e.s END, 0), 6) AS votes, CASE WHEN e.block IS NULL THEN r.rest ELSE 0.0 END AS unplaced
    FROM e FULL JOIN r ON r.region = e.region""",
)
def block_apportion(spark, sf_dir):
    blocks = table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").select(
        (F.col("s_nationkey") % 5).alias("region"), F.col("s_nationkey").alias("unit"), F.col("s_suppkey").alias("block"), F.when(F.col("s_nationkey") % 7 == 0, 0).otherwise(F.col("s_suppkey") % 10).alias("pop")
    )
    votes = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("region"), F.col("c_nationkey").alias("unit")).agg(F.count("*").cast("double").alias("votes"))
    out = allocation.apportion(votes, blocks, ["unit"], ["region"], "block", "pop", "votes")
    return out.select("region", "block", F.round("votes", 6).alias("votes"), "unplaced")


@register(
    "transfer_components",
    f"""WITH p AS (SELECT district, county, sum(CASE WHEN flag = 'A' THEN votes ELSE 0 END) AS a, sum(CASE WHEN flag = 'R' THEN votes ELSE 0 END) AS b, sum(CASE WHEN county % 2 = 0 AND flag IN ('A', 'R') THEN votes END) AS g, sum(CASE WHEN flag IN ('A', 'R') THEN votes ELSE 0 END) AS t FROM ({LINES_SQL}) GROUP BY 1, 2)
    SELECT district, sum(a) AS first_votes, sum(b) AS second_votes, round(sum(a) / sum(t), 9) AS share, round(max(t) / sum(t), 9) AS largest_source_share, round(sum(g) / sum(t), 9) AS located_share, count(county) AS n_sources FROM p GROUP BY 1""",
)
def transfer_components(spark, sf_dir):
    vote = lambda p: F.when(F.col("flag") == p, F.col("votes")).otherwise(0.0)
    rows = ballots(spark, sf_dir).select("district", "county", vote("A").alias("a"), vote("R").alias("b"), (F.col("county") % 2 == 0).alias("located"))
    out = allocation.transfer(rows, "district", "county", "a", "b", "located")
    return out.select("district", "first_votes", "second_votes", *(F.round(c, 9).alias(c) for c in ("share", "largest_source_share", "located_share")), "n_sources")


@register("allocation_error_bands", "SELECT CAST((l_discount >= 0) AS INTEGER) + CAST((l_discount >= 0.035) AS INTEGER) + CAST((l_discount >= 0.075) AS INTEGER) AS band, count(*) AS n, round(avg(abs(l_quantity - 25)), 6) AS mae, round(quantile_cont(abs(l_quantity - 25), 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def allocation_error_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("e", F.col("l_quantity") - 25)
    out = allocation.error_bands(rows, "l_discount", "e", [0.0, 0.035, 0.075])
    return out.select("band", "n", F.round("mae", 6).alias("mae"), F.round("p90", 6).alias("p90"))


PRICES_SQL = "SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount, l_tax, l_extendedprice / 1000 AS y, CAST(year(o_orderdate) AS INTEGER) AS cycle FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"), F.year("o_orderdate").alias("cycle"))


@register("ols_fit", f"SELECT round(regr_intercept(y, q), 5) AS intercept, round(regr_slope(y, q), 6) AS slope, round(sqrt((regr_syy(y, q) - regr_sxy(y, q) * regr_sxy(y, q) / regr_sxx(y, q)) / (count(*) - 2)), 5) AS sigma, count(*) AS n FROM ({PRICES_SQL})")
def ols_fit(spark, sf_dir):
    fit = regression.solve(regression.grams(prices(spark, sf_dir), ["q"], "y")[None], ["q"])
    row = (round(float(fit.coefficients[0]), 5), round(float(fit.coefficients[1]), 6), round(fit.sigma, 5), fit.n)
    return spark.createDataFrame([row], "intercept double, slope double, sigma double, n bigint")


BACKTEST_SQL = f"""WITH p AS ({PRICES_SQL}), c AS (SELECT DISTINCT cycle FROM p),
f AS (SELECT c.cycle, regr_intercept(p.y, p.q) AS a, regr_slope(p.y, p.q) AS b, count(*) AS n FROM c JOIN p ON {{}} GROUP BY 1)
SELECT p.cycle, count(*) AS n, round(avg(abs(f.a + f.b * p.q - p.y)), 6) AS mae, round(sqrt(avg((f.a + f.b * p.q - p.y) * (f.a + f.b * p.q - p.y))), 6) AS rmse, max(f.n) AS n_train FROM p JOIN f ON f.cycle = p.cycle GROUP BY 1"""


def _scored(rows: DataFrame) -> DataFrame:
    e = F.col("pred") - F.col("y")
    return rows.groupBy("cycle").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.max("n_train").alias("n_train"))


@register("loco_backtest", BACKTEST_SQL.format("p.cycle <> c.cycle"))
def loco_backtest(spark, sf_dir):
    return _scored(regression.leave_one_out(prices(spark, sf_dir), ["q"], "y", "cycle"))


@register("expanding_backtest", BACKTEST_SQL.format("p.cycle < c.cycle"))
def expanding_backtest(spark, sf_dir):
    return _scored(regression.expanding(prices(spark, sf_dir), ["q"], "y", "cycle"))


_FEATURES = ("q", "l_discount", "l_tax")
_MOMENTS = ", ".join([f"covar_pop(p.{x}, p.{y}) AS s{i}{j}" for i, x in enumerate(_FEATURES, 1) for j, y in enumerate(_FEATURES, 1)] + [f"covar_pop(p.{x}, p.y) AS t{i}, avg(p.{x}) AS m{i}" for i, x in enumerate(_FEATURES, 1)])


@register(
    "multiple_regression",
    f"""WITH p AS ({PRICES_SQL}), c AS (SELECT DISTINCT cycle FROM p), s AS (SELECT c.cycle, {_MOMENTS}, avg(p.y) AS my, count(*) AS n FROM c JOIN p ON p.cycle <> c.cycle GROUP BY 1),
    d AS (SELECT *, s22 * s33 - s23 * s23 AS k1, s12 * s33 - s23 * s13 AS k2, s12 * s23 - s22 * s13 AS k3 FROM s),
    e AS (SELECT *, s11 * k1 - s12 * k2 + s13 * k3 AS det FROM d),
    f AS (SELECT cycle, n, my, m1, m2, m3, (t1 * k1 - s12 * (t2 * s33 - s23 * t3) + s13 * (t2 * s23 - s22 * t3)) / det AS b1, (s11 * (t2 * s33 - s23 * t3) - t1 * k2 + s13 * (s12 * t3 - t2 * s13)) / det AS b2, (s11 * (s22 * t3 - t2 * s23) - s12 * (s12 * t3 - t2 * s13) + t1 * k3) / det AS b3 FROM e),
    g AS (SELECT p.cycle, f.n, my + b1 * (q - m1) + b2 * (l_discount - m2) + b3 * (l_tax - m3) - y AS e FROM p JOIN f ON f.cycle = p.cycle)
    SELECT cycle, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, max(n) AS n_train FROM g GROUP BY 1""",
)
def multiple_regression(spark, sf_dir):
    """Three features by leave-one-cycle-out; the unit tests compare the fits with NumPy."""
    return _scored(regression.leave_one_out(prices(spark, sf_dir), ["q", "l_discount", "l_tax"], "y", "cycle"))


#: Replicates of the bootstrap, and their sums drawn in SQL from the same hashes.
_DRAWS = 500
_SLOPES_SQL = f"""WITH p AS ({PRICES_SQL}),
    b AS (SELECT row_number() OVER (ORDER BY cycle) - 1 AS g, var_pop(q) AS qq, covar_pop(q, l_discount) AS qd, var_pop(l_discount) AS dd, covar_pop(q, y) AS qy, covar_pop(l_discount, y) AS dy FROM p GROUP BY cycle),
    k AS (SELECT count(*) AS c FROM b), i AS (SELECT unnest(generate_series(0, {_DRAWS} * (SELECT c FROM k) - 1)) AS id),
    d AS (SELECT id // c AS replicate, CAST(floor(((('0x' || substr(md5(concat_ws('|', '23', 'group', id // c, id % c)), 1, 8))::BIGINT + 0.5) / 4294967296.0) * c) AS BIGINT) AS g FROM i, k
        UNION ALL SELECT -1, g FROM b),
    s AS (SELECT replicate, sum(qq) AS qq, sum(qd) AS qd, sum(dd) + 1e-5 AS dd, sum(qy) AS qy, sum(dy) AS dy FROM d JOIN b USING (g) GROUP BY replicate),
    f AS (SELECT replicate, CASE WHEN qq - qd * qd / dd >= 1e-7 THEN (qy * dd - dy * qd) / (qq * dd - qd * qd) END AS slope FROM s)"""


@register(
    "bootstrap_slope",
    f"""{_SLOPES_SQL}
    SELECT 'estimated' AS status, (SELECT c FROM k) AS n_groups, round(e, 7) AS slope, round(a - m + e, 7) AS low, round(z - m + e, 7) AS high
    FROM (SELECT max(slope) FILTER (WHERE replicate < 0) AS e, avg(slope) FILTER (WHERE replicate >= 0) AS m, quantile_cont(slope, 0.05) FILTER (WHERE replicate >= 0) AS a, quantile_cont(slope, 0.95) FILTER (WHERE replicate >= 0) AS z FROM f)""",
)
def bootstrap_slope(spark, sf_dir):
    out = regression.group_slopes(prices(spark, sf_dir), "q", ["l_discount"], "y", "cycle", _DRAWS)
    return out.select("status", "n_groups", *(F.round(c, 7).alias(c) for c in ("slope", "low", "high")))


@register("bootstrap_draws", f"{_SLOPES_SQL} SELECT replicate, round(slope, 7) AS slope FROM f")
def bootstrap_draws(spark, sf_dir):
    """The slope of every replicate; -1 is the estimate."""
    return bootstrap.slopes(prices(spark, sf_dir), "q", ["l_discount"], "y", "cycle", _DRAWS).select("replicate", F.round("slope", 7).alias("slope"))


SCORES_SQL = "SELECT o_orderstatus, o_orderkey, least(1, greatest(0, o_totalprice / 400000)) AS p, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS y FROM orders"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("o_totalprice") / 400000))
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", p.alias("p"), F.when(F.col("o_orderkey") % 3 == 0, 1.0).otherwise(0.0).alias("y"))


@register("eval_metrics", f"SELECT o_orderstatus, count(*) AS n, round(avg(abs(p - y)), 7) AS mae, round(sqrt(avg((p - y) * (p - y))), 7) AS rmse, round(avg(CASE WHEN (p > 0.5) = (y > 0.5) THEN 1.0 ELSE 0.0 END), 7) AS accuracy FROM ({SCORES_SQL}) GROUP BY 1")
def eval_metrics(spark, sf_dir):
    out = evaluation.metrics(scores(spark, sf_dir), ["o_orderstatus"], "p", "y")
    return out.select("o_orderstatus", "n", *(F.round(c, 7).alias(c) for c in ("mae", "rmse", "accuracy")))


@register("brier_log", f"WITH s AS (SELECT p, y, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM ({SCORES_SQL})) SELECT round(avg((p - y) * (p - y)), 7) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 7) AS log_score FROM s")
def brier_log(spark, sf_dir):
    return scores(spark, sf_dir).agg(F.round(evaluation.brier(F.col("p"), F.col("y")), 7).alias("brier"), F.round(evaluation.log_score(F.col("p"), F.col("y")), 7).alias("log_score"))


CURVE_SQL = f"""WITH e AS (SELECT unnest([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]::DOUBLE[]) AS e)
SELECT CAST((SELECT count(*) FROM e WHERE e.e <= s.p) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM ({SCORES_SQL}) s GROUP BY 1"""


@register("calibration_curve", f"SELECT bin, n, round(mean_p, 7) AS mean_p, round(mean_y, 7) AS mean_y FROM ({CURVE_SQL})")
def calibration_curve(spark, sf_dir):
    out = evaluation.calibration(scores(spark, sf_dir), "p", "y")
    return out.select("bin", "n", F.round("mean_p", 7).alias("mean_p"), F.round("mean_y", 7).alias("mean_y"))


@register("ece", f"SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 7) AS ece FROM ({CURVE_SQL})")
def ece(spark, sf_dir):
    return evaluation.expected_calibration_error(evaluation.calibration(scores(spark, sf_dir), "p", "y")).select(F.round("ece", 7).alias("ece"))


@register("interval_coverage", "SELECT round(avg(CASE WHEN abs(value - 50) <= 1.2815515655446004 * 20 THEN 1.0 ELSE 0.0 END), 7) AS coverage_80, round(avg(CASE WHEN abs(value - 50) <= 1.6448536269514722 * 20 THEN 1.0 ELSE 0.0 END), 7) AS coverage_90, round(avg(CASE WHEN abs(value - 50) <= 1.959963984540054 * 20 THEN 1.0 ELSE 0.0 END), 7) AS coverage_95 FROM events")
def interval_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("value", F.lit(50.0).alias("m"), F.lit(20.0).alias("s"))
    out = evaluation.coverage(rows, "m", "s", "value")
    return out.select(*(F.round(c, 7).alias(c) for c in out.columns))


@register("interval_score", "SELECT p_partkey, round(p_size + 20 * greatest(1000 - p_retailprice, 0) + 20 * greatest(p_retailprice - 1000 - p_size, 0), 6) AS score FROM part")
def interval_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(evaluation.interval_score(F.lit(1000.0), F.col("p_size") + 1000.0, F.col("p_retailprice")), 6).alias("score"))


PAIRS_SQL = """WITH z AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS cycle, o_orderpriority AS region, (o_totalprice - 150000) / 80000 AS z FROM orders),
g AS (SELECT cycle, region, CAST(count(z) AS DOUBLE) AS n, sum(z) AS s, sum(z * z) AS q FROM z GROUP BY 1, 2)
SELECT cycle, (sum(s) * sum(s) - sum(s * s)) / (sum(n) * sum(n) - sum(n * n)) AS across, (sum(s * s) - sum(q)) / sum(n * (n - 1)) AS within, sum(q) / sum(n) AS variance FROM g GROUP BY 1"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("cycle"), F.col("o_orderpriority").alias("region"), ((F.col("o_totalprice") - 150000) / 80000).alias("z"))
    return evaluation.pair_covariance(rows, "cycle", "region", "z")


@register("pair_covariance", f"SELECT cycle, round(across, 8) AS across, round(within, 8) AS within, round(variance, 8) AS variance FROM ({PAIRS_SQL})")
def pair_covariance(spark, sf_dir):
    out = pairs(spark, sf_dir)
    return out.select("cycle", *(F.round(c, 8).alias(c) for c in ("across", "within", "variance")))


@register("error_components", f"WITH m AS (SELECT greatest(avg(across), 0) AS a, greatest(avg(within) - greatest(avg(across), 0), 0) AS w, avg(variance) AS v, count(*) AS n FROM ({PAIRS_SQL})), c AS (SELECT n, a, w, greatest(v - a - w, 0) AS o FROM m) SELECT n AS n_periods, round(a / (a + w + o), 7) AS national, round(w / (a + w + o), 7) AS regional, round(o / (a + w + o), 7) AS own FROM c")
def error_components(spark, sf_dir):
    out = evaluation.error_components(pairs(spark, sf_dir))
    return out.select("n_periods", *(F.round(c, 7).alias(c) for c in ("national", "regional", "own")))


@register("quality_report", "SELECT 'o_orderstatus' AS \"column\", count(*) AS n_rows, count(*) - count(o_orderstatus) AS n_missing, count(DISTINCT o_orderstatus) AS n_distinct FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders")
def quality_report(spark, sf_dir):
    return evaluation.quality_report(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"])


@register("macro_average", "WITH m AS (SELECT o_orderstatus, year(o_orderdate) AS y, avg(abs(o_totalprice - 150000)) AS m, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, round(avg(m), 3) AS mae, count(*) AS n_periods, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1")
def macro_average(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y"), (F.col("o_totalprice") - 150000).alias("e"))
    return evaluation.macro_average(rows, "y", ["o_orderstatus"], "e").withColumn("mae", F.round("mae", 3))


def _uniform_sql(stream: str, names: str, at: int) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '7', '{stream}', {names})), {at}, 8))::BIGINT + 0.5) / 4294967296.0)"


def _normal_sql(stream: str, names: str) -> str:
    return f"(sqrt(-2 * ln({_uniform_sql(stream, names, 1)})) * cos(2 * 3.141592653589793 * {_uniform_sql(stream, names, 9)}))"


DRAWS_SQL = f"""SELECT sim, unit, region, least(greatest(mean + sigma * (sqrt(0.5) * {_normal_sql('national', 'sim')} + sqrt(0.2) * {_normal_sql('region', 'sim, region')} + sqrt(0.3) * {_normal_sql('unit', 'sim, unit')}), 0), 1) AS share
FROM (SELECT n_nationkey AS unit, n_regionkey AS region, 0.4 + n_nationkey / 120.0 AS mean, 0.05 + n_regionkey / 100.0 AS sigma, unnest(generate_series(1, 2000)) AS sim FROM nation)"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"), (0.4 + F.col("n_nationkey") / 120.0).alias("mean"), (0.05 + F.col("n_regionkey") / 100.0).alias("sigma"))
    return simulation.simulate(units, "unit", "region", "mean", "sigma", 2000, (0.5, 0.2, 0.3))


@register("sim_units", f"SELECT unit, round(avg(share), 6) AS mean_share, round(quantile_cont(share, 0.5), 6) AS median_share, round(quantile_cont(share, 0.05), 6) AS share_5th, round(quantile_cont(share, 0.95), 6) AS share_95th, round(avg(CASE WHEN share > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS win_probability, CASE WHEN avg(share) > 0.5 THEN 'first' WHEN avg(share) < 0.5 THEN 'second' ELSE 'even' END AS leader FROM ({DRAWS_SQL}) GROUP BY 1")
def sim_units(spark, sf_dir):
    out = simulation.unit_distribution(draws(spark, sf_dir), "unit")
    return out.select("unit", *(F.round(c, 6).alias(c) for c in ("mean_share", "median_share", "share_5th", "share_95th", "win_probability")), "leader")


@register("sim_seats", f"WITH s AS (SELECT sim, CAST(count(*) FILTER (WHERE share > 0.5) + 3 AS DOUBLE) AS s FROM ({DRAWS_SQL}) GROUP BY 1) SELECT round(avg(s), 6) AS mean_seats, quantile_cont(s, 0.5) AS median_seats, round(quantile_cont(s, 0.05), 6) AS seats_5th, round(quantile_cont(s, 0.95), 6) AS seats_95th, round(avg(CASE WHEN s > 14 THEN 1.0 ELSE 0.0 END), 6) AS p_control FROM s")
def sim_seats(spark, sf_dir):
    out = simulation.seat_distribution(draws(spark, sf_dir), held=3, majority=14)
    return out.select(F.round("mean_seats", 6).alias("mean_seats"), "median_seats", *(F.round(c, 6).alias(c) for c in ("seats_5th", "seats_95th", "p_control")))


@register("sim_electoral_weights", f"WITH s AS (SELECT sim, CAST(sum(CASE WHEN share > 0.5 THEN unit + 3 ELSE 0 END) AS DOUBLE) AS s FROM ({DRAWS_SQL}) GROUP BY 1) SELECT round(avg(s), 6) AS mean_seats, quantile_cont(s, 0.5) AS median_seats, round(quantile_cont(s, 0.05), 6) AS seats_5th, round(quantile_cont(s, 0.95), 6) AS seats_95th, round(avg(CASE WHEN s > 187 THEN 1.0 ELSE 0.0 END), 6) AS p_control FROM s")
def sim_electoral_weights(spark, sf_dir):
    out = simulation.seat_distribution(draws(spark, sf_dir), F.col("unit") + 3, majority=187)
    return out.select(F.round("mean_seats", 6).alias("mean_seats"), "median_seats", *(F.round(c, 6).alias(c) for c in ("seats_5th", "seats_95th", "p_control")))


SLOPES = (-0.05, 0.0, 0.02, 0.07)


@register("sim_shared_slope", f"SELECT unit, round(avg(least(greatest(share + ([{', '.join(map(str, SLOPES))}])[CAST(floor({_uniform_sql('slope', 'sim', 1).replace(chr(39) + '7' + chr(39), chr(39) + '8' + chr(39))} * 4) AS INTEGER) + 1] * (unit - 12) / 12.0, 0), 1)), 6) AS mean_share FROM ({DRAWS_SQL}) GROUP BY 1")
def sim_shared_slope(spark, sf_dir):
    leans = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), ((F.col("n_nationkey") - 12) / 12.0).alias("lean"))
    out = simulation.with_shared_slope(draws(spark, sf_dir), leans, "unit", "lean", SLOPES)
    return out.groupBy("unit").agg(F.round(F.avg("share"), 6).alias("mean_share"))


@register(
    "sim_bootstrap_slope",
    f"""{_SLOPES_SQL}, w AS ({DRAWS_SQL}),
    n AS (SELECT row_number() OVER (ORDER BY replicate) - 1 AS number, slope - avg(slope) OVER () + (SELECT max(slope) FROM f WHERE replicate < 0) AS slope FROM f WHERE replicate >= 0 AND slope IS NOT NULL),
    x AS (SELECT sim, CAST(floor({_uniform_sql('slope', 'sim', 1).replace("'7'", "'8'")} * (SELECT count(*) FROM n)) AS BIGINT) AS number FROM (SELECT DISTINCT sim FROM w))
    SELECT unit, round(avg(least(greatest(share + slope * (unit - 12) / 100.0, 0), 1)), 6) AS mean_share FROM w JOIN x USING (sim) JOIN n USING (number) GROUP BY unit""",
)
def sim_bootstrap_slope(spark, sf_dir):
    """Simulated shares of the nations, each draw moved by lean times a slope of the bootstrap."""
    found = bootstrap.slopes(prices(spark, sf_dir), "q", ["l_discount"], "y", "cycle", _DRAWS)
    leans = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), ((F.col("n_nationkey") - 12) / 100.0).alias("lean"))
    out = bootstrap.with_drawn_slope(draws(spark, sf_dir), leans, "unit", "lean", staging.stored(bootstrap.centred(staging.stored(found, "slopes")), "slope-draws"))
    return out.groupBy("unit").agg(F.round(F.avg("share"), 6).alias("mean_share"))
