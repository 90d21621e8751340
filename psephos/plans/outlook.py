"""Queries of the national environment, whole chambers and gates over the panel of nations and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import environment, panels
from ..sources import staging
from .averages import weighted
from .catalog import register, table
from .timing import PANEL_SQL

#: Nations stand for districts, their regions for states; the baseline is another measure of the same nation and year.
UNITS_SQL = f"""SELECT p.nationkey, n_regionkey AS region, year, share, w, m, 0.2 + 0.5 * share + nationkey * 0.004 AS base, CASE WHEN (nationkey + year) % 7 = 0 THEN 'suspect' ELSE 'ok' END AS quality, (nationkey + year) % 11 = 0 AS uncontested
    FROM (SELECT nationkey, year, share, first_votes + second_votes AS w, sum(share * (first_votes + second_votes)) OVER (PARTITION BY year) / sum(CASE WHEN share IS NOT NULL THEN first_votes + second_votes END) OVER (PARTITION BY year) AS m FROM ({PANEL_SQL})) p JOIN nation ON n_nationkey = p.nationkey WHERE share IS NOT NULL"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighted(spark, sf_dir).where("share is not null")
    national = rows.groupBy("year").agg(panels.weighted_mean(F.col("share"), F.col("w")).alias("m"))
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("region"))
    odd = F.col("nationkey") + F.col("year")
    return rows.join(national, "year").join(regions, "nationkey").select(
        "nationkey", "region", "year", "share", "w", "m", (0.2 + 0.5 * F.col("share") + F.col("nationkey") * 0.004).alias("base"), F.when(odd % 7 == 0, "suspect").otherwise("ok").alias("quality"), (odd % 11 == 0).alias("uncontested")
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


BASIS_SQL = f"SELECT year, nationkey, base - avg(base) OVER (PARTITION BY year) AS x, share - m AS y FROM ({UNITS_SQL}) WHERE quality = 'ok' AND NOT uncontested"


@register(
    "basis_map",
    f"""WITH p AS ({BASIS_SQL}), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p),
    h AS (SELECT t.year, regr_slope(p.y, p.x) AS b, regr_intercept(p.y, p.x) AS a FROM (SELECT DISTINCT year FROM p) t JOIN p ON p.year <> t.year GROUP BY t.year HAVING count(*) >= 20),
    l AS (SELECT stddev_samp(y - a - b * x) AS s FROM p JOIN h ON p.year = h.year)
    SELECT 'fitted' AS status, count(*) AS n, round(max(a), 6) AS intercept, round(max(b), 6) AS slope, round(sqrt(sum((y - a - b * x) * (y - a - b * x)) / (count(*) - 2)), 6) AS residual_sd, round(avg(abs(y - a - b * x)), 6) AS mae, round(avg(abs(y - x)), 6) AS raw_mae, round(max(s), 6) AS loco_sd FROM p, f, l""",
)
def basis_map(spark, sf_dir):
    rows = units(spark, sf_dir)
    panel = environment.basis_panel(rows.drop("base", "quality"), rows.select("nationkey", "year", "base", "quality"), ["nationkey"], "year", "share", "m", "uncontested", "base", "quality")
    return rounded(environment.basis_map(panel, "year", 20))


TOPLINES_SQL = "SELECT CAST(o_orderdate AS DATE) AS day, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice / 2 END) AS a, avg(o_totalprice) AS b FROM orders GROUP BY 1"


@register(
    "topline_check",
    f"""WITH t AS ({TOPLINES_SQL}), c AS (SELECT DISTINCT year, m FROM ({UNITS_SQL})), j AS (SELECT c.year, c.m, t.day, t.a / (t.a + t.b) AS p FROM c JOIN t ON t.day BETWEEN make_date(c.year, 10, 20) - 7 AND make_date(c.year, 10, 20))
    SELECT year, max(day) AS average_date, round(arg_max(p, day), 6) AS prediction, round(arg_max(p, day) - max(m), 6) AS error FROM j GROUP BY year""",
)
def topline_check(spark, sf_dir):
    price, day = F.col("o_totalprice"), F.col("o_orderdate").cast("date").alias("day")
    toplines = table(spark, sf_dir, "orders").groupBy(day).agg(F.avg(F.when(F.col("o_orderstatus") == "F", price).otherwise(price / 2)).alias("a"), F.avg(price).alias("b"))
    targets = units(spark, sf_dir).select("year", "m").groupBy("year").agg(F.max("m").alias("m"))
    return rounded(environment.topline_check(toplines, targets, "day", "a", "b", "year", "m"))


@register(
    "generic_ballot",
    """WITH p AS (SELECT o_totalprice / 600000 AS s, o_orderkey % 900 + 300 AS n, exp(-ln(2.0) * date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-10-20') / 21.0) * sqrt(o_orderkey % 900 + 300) * CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.9 END AS w
        FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-10-20' - 60 AND DATE '1996-10-20' AND CAST(o_orderdate AS DATE) + 2 <= DATE '1996-10-20')
    SELECT CASE WHEN count(*) = 0 THEN 'unavailable' ELSE 'point' END AS status, round(sum(w * s) / sum(w), 6) AS national_share, round(sqrt(sum(w * w * s * (1 - s) / n) / (sum(w) * sum(w)) + greatest(sum(w * s * s) / sum(w) - (sum(w * s) / sum(w)) * (sum(w * s) / sum(w)), 0) + 0.031 * 0.031), 6) AS sigma, count(*) AS n_polls FROM p""",
)
def generic_ballot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 600000).alias("s"), (F.col("o_orderkey") % 900 + 300).alias("n"), "o_custkey", F.col("o_orderdate").cast("date").alias("ended"), F.date_add(F.col("o_orderdate").cast("date"), 2).alias("published"), "o_orderstatus")
    return rounded(environment.generic_ballot(rows, "1996-10-20", 0.031, "s", "n", "o_custkey", "ended", "published", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.9)))


@register(
    "specials_band",
    f"WITH e AS (SELECT avg(share - m) AS a, stddev_samp(share - m) / sqrt(count(*)) AS s FROM ({UNITS_SQL})) SELECT 'shrinkage=' || CAST(f AS VARCHAR) AS assumption, f AS shrinkage, round(a * f, 6) AS swing, round(0.48 + a * f / 2, 6) AS national_share, round(f * s / 2, 6) AS sigma FROM e, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) AS f)",
)
def specials_band(spark, sf_dir):
    margin = F.col("share") - F.col("m")
    estimate = units(spark, sf_dir).agg(F.avg(margin).alias("a"), (F.stddev_samp(margin) / F.sqrt(F.count("*").cast("double"))).alias("s"))
    return rounded(environment.specials_band(estimate, "a", "s", 0.48))


@register(
    "environment_contract",
    """WITH e AS (SELECT c_custkey, ['specials_band', 'generic_ballot', 'fundamentals', 'scenario', 'guess'][c_custkey % 5 + 1] AS estimator, ['point', 'band', 'unavailable', 'open'][c_nationkey % 4 + 1] AS status, CASE WHEN c_custkey % 3 = 0 THEN 0.5 END AS national_share, CAST(c_custkey % 2 AS INTEGER) * 4 AS n_band, c_custkey % 7 = 0 AS identified, CASE WHEN c_custkey % 4 < 2 THEN 'said' ELSE ' ' END AS assumption FROM customer),
    r AS (SELECT *, CASE WHEN estimator = 'guess' THEN 'unknown_estimator' WHEN status = 'open' THEN 'unknown_status' WHEN estimator IN ('specials_band', 'scenario') AND identified THEN 'cannot_be_identified'
        WHEN status = 'band' AND national_share IS NOT NULL THEN 'band_with_single_share' WHEN status = 'band' AND n_band = 0 THEN 'empty_band' WHEN status = 'band' AND trim(assumption) = '' THEN 'band_without_assumption' WHEN status = 'band' AND identified THEN 'identified_band'
        WHEN status = 'point' AND national_share IS NULL THEN 'point_without_share' WHEN status = 'point' AND n_band > 0 THEN 'point_with_band' WHEN status = 'point' AND NOT identified AND trim(assumption) = '' THEN 'point_without_assumption' WHEN status = 'unavailable' AND (national_share IS NOT NULL OR n_band > 0) THEN 'unavailable_with_value' END AS error FROM e)
    SELECT c_custkey, error, error IS NULL AND (status = 'band' OR (status = 'point' AND (identified OR estimator = 'scenario'))) AS projectable FROM r""",
)
def environment_contract(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        key,
        pick((*environment.ESTIMATORS[:3], "scenario", "guess"), key % 5).alias("estimator"),
        pick(("point", "band", "unavailable", "open"), F.col("c_nationkey") % 4).alias("status"),
        F.when(key % 3 == 0, 0.5).alias("national_share"),
        (key % 2 * 4).cast("int").alias("n_band"),
        (key % 7 == 0).alias("identified"),
        F.when(key % 4 < 2, "said").otherwise(" ").alias("assumption"),
    )
    return rows.select("c_custkey", environment.contract_error().alias("error"), environment.projectable().alias("projectable"))


@register(
    "control_conclusion",
    f"""WITH b AS (SELECT nationkey, year, CASE WHEN share > m THEN 0.5 + (share - m) ELSE 0.5 - (m - share) * (nationkey % 3) END AS p FROM ({UNITS_SQL})), g AS (SELECT nationkey, min(p) AS lo, max(p) AS hi, string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (WHERE p >= 0.5) AS c FROM b GROUP BY 1)
    SELECT nationkey, round(lo, 6) AS low, round(hi, 6) AS high, CASE WHEN lo > 0.5 THEN 'first' WHEN hi < 0.5 THEN 'second' ELSE 'depends' END AS conclusion, CASE WHEN NOT lo > 0.5 AND NOT hi < 0.5 THEN c END AS favoured_at FROM g""",
)
def control_conclusion(spark, sf_dir):
    away = F.col("share") - F.col("m")
    rows = units(spark, sf_dir).select("nationkey", F.col("year").cast("string").alias("assumption"), F.when(away > 0, 0.5 + away).otherwise(0.5 + away * (F.col("nationkey") % 3)).alias("p"))
    return rounded(environment.control_conclusion(rows, "nationkey", "p"))


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).groupBy("year").agg(F.when(F.max("m") > 0.4985, "A").otherwise("B").alias("party"))


@register(
    "political_features",
    f"""WITH w AS (SELECT DISTINCT year, CASE WHEN m > 0.4985 THEN 'A' ELSE 'B' END AS party FROM ({UNITS_SQL})), n AS (SELECT *, sum(fresh) OVER (ORDER BY year) AS run FROM (SELECT *, CASE WHEN lag(party) OVER (ORDER BY year) = party THEN 0 ELSE 1 END AS fresh FROM w)),
    t AS (SELECT year, party, row_number() OVER (PARTITION BY run ORDER BY year) AS terms FROM n), c AS (SELECT year FROM w UNION ALL SELECT max(year) + 1 FROM w)
    SELECT c.year AS cycle, t.party, t.terms, c.year % 4 = 2 AS midterm FROM c JOIN t ON t.year = (SELECT max(year) FROM w WHERE w.year < c.year)""",
)
def political_features(spark, sf_dir):
    won = winners(spark, sf_dir)
    cycles = won.select(F.col("year").alias("cycle")).unionByName(won.agg((F.max("year") + 1).alias("cycle")))
    return environment.political_features(won, cycles, "year", "party", "cycle")


FUNDAMENTALS_SQL = f"SELECT o.year, o.a / (o.a + o.b) AS y, o.x, CASE WHEN u.m > 0.4985 THEN 'A' ELSE 'B' END AS party, CASE WHEN o.month % 3 = 0 THEN 1.0 ELSE 0.0 END AS z FROM (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS year, year(o_orderdate) AS cycle, month(o_orderdate) AS month, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice / 2 END) AS a, sum(o_totalprice) AS b, avg(o_orderkey % 100) / 100 AS x FROM orders GROUP BY ALL) o JOIN (SELECT DISTINCT year, m FROM ({UNITS_SQL})) u ON u.year = o.cycle"


def _fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    months = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("cycle"), F.month("o_orderdate").alias("month")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(price / 2)).alias("a"), F.sum(price).alias("b"), (F.avg(F.col("o_orderkey") % 100) / 100).alias("x")
    )
    party = winners(spark, sf_dir).select(F.col("year").alias("cycle"), "party")
    rows = staging.stored(months, "months").join(party, "cycle").select((F.col("cycle") * 12 + F.col("month")).alias("year"), (F.col("a") / (F.col("a") + F.col("b"))).alias("y"), "x", "party", F.when(F.col("month") % 3 == 0, 1.0).otherwise(0.0).alias("z"))
    return environment.fundamentals_backtest(rows, ["x"], "year", "y", "party", "A", "z")


_BACKTEST_SQL = f"""p AS ({FUNDAMENTALS_SQL}),
    f AS (SELECT t.year, count(*) AS n, regr_slope(p.y, p.x) AS b, regr_intercept(p.y, p.x) AS a, regr_sxx(p.y, p.x) AS sxx, regr_syy(p.y, p.x) AS syy, regr_sxy(p.y, p.x) AS sxy, regr_slope(p.y, p.z) AS d, regr_intercept(p.y, p.z) AS c FROM p t JOIN p ON p.year < t.year GROUP BY t.year HAVING count(*) >= 6),
    l AS (SELECT year, lag(CASE WHEN party = 'A' THEN y ELSE 1 - y END) OVER (ORDER BY year) AS last FROM p),
    r AS (SELECT p.year, y AS actual, a + b * x AS prediction, sqrt(greatest(0, syy - b * sxy) / (n - 2)) AS sigma, CASE WHEN party = 'A' THEN last ELSE 1 - last END AS persistence, c + d * z AS control FROM p JOIN f ON f.year = p.year JOIN l ON l.year = p.year)"""


@register("fundamentals_backtest", f"WITH {_BACKTEST_SQL} SELECT CAST(year AS INTEGER) AS year, round(actual, 6) AS actual, round(prediction, 6) AS prediction, round(sigma, 6) AS sigma, round(persistence, 6) AS persistence, round(control, 6) AS control FROM r")
def fundamentals_backtest(spark, sf_dir):
    return rounded(_fundamentals(spark, sf_dir))


@register(
    "fundamentals_gate",
    f"""WITH {_BACKTEST_SQL}, g AS (SELECT count(*) AS n, avg(abs(prediction - actual)) AS a, avg(abs(persistence - actual)) AS b, avg(abs(control - actual)) AS c, avg(CASE WHEN abs(prediction - actual) <= {environment.Z90} * sigma THEN 1.0 ELSE 0.0 END) AS v, sqrt(avg((prediction - actual) * (prediction - actual))) AS e FROM r)
    SELECT n, round(a, 6) AS prediction_mae, round(b, 6) AS persistence_mae, round(c, 6) AS control_mae, round(v, 6) AS coverage_90, round(e, 6) AS rmse, n >= 8 AND v >= 0.85 AND a < least(b, c) AS eligible FROM g""",
)
def fundamentals_gate(spark, sf_dir):
    return rounded(environment.fundamentals_gate(_fundamentals(spark, sf_dir)))


def _chamber(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    odd = (F.col("nationkey") * 3 + F.col("year")) % 17 == 0
    panel = units(spark, sf_dir).withColumn("s", (F.col("year") % 3 - 1).cast("int")).withColumn("share", F.when(odd, 1.0).otherwise(F.col("share")))
    history = units(spark, sf_dir).where("year % 2 = 0").groupBy("region", "year").agg(F.avg("share").alias("share"), F.max("m").alias("national"))
    panel = panel.withColumn("w", F.when((F.col("year") == 2000) & (F.col("nationkey") == 5), "I").otherwise("D"))
    return environment.chamber(panel, history, ["m"], "m", "year", "nationkey", "region", "share", "s", 25, 3, "w", ["D", "R"])


_CHAMBER_SQL = f"""u AS (SELECT nationkey, region, year, m, CAST(year % 3 AS INTEGER) - 1 AS s, CASE WHEN (nationkey * 3 + year) % 17 = 0 THEN 1.0 ELSE share END AS share FROM ({UNITS_SQL})),
    k AS (SELECT year FROM u WHERE year <> 2000 GROUP BY year HAVING count(*) = 25), q AS (SELECT DISTINCT year FROM u WHERE share > 0 AND share < 1),
    f AS (SELECT t.year, max(p.year) AS through, count(*) AS n, regr_slope(p.share, p.m) AS b, regr_intercept(p.share, p.m) AS a, regr_sxy(p.share, p.m) AS sxy, regr_syy(p.share, p.m) AS syy FROM q t JOIN u p ON p.year < t.year AND p.share > 0 AND p.share < 1 GROUP BY t.year HAVING count(DISTINCT p.year) >= 3),
    h AS (SELECT year, min(m) AS n, min(s) AS s FROM u GROUP BY year), g AS (SELECT year, s, lag(n) OVER (ORDER BY year) AS l, n - lag(n) OVER (ORDER BY year) AS d FROM h),
    c AS (SELECT x.year, least(greatest(x.l + coalesce(avg(y.d), 0), 0), 1) AS forecast FROM g x LEFT JOIN g y ON y.year < x.year AND y.s = x.s AND x.s <> 0 WHERE x.l IS NOT NULL GROUP BY x.year, x.l),
    e AS (SELECT k.year, forecast, a, b, through, sqrt(greatest(0, syy - b * sxy) / (f.n - 2)) AS sd, forecast - h.n AS e FROM k JOIN f ON f.year = k.year JOIN c ON c.year = k.year JOIN h ON h.year = k.year),
    v AS (SELECT *, CASE WHEN count(e) OVER w >= 3 THEN stddev_samp(e) OVER w ELSE 0.03 END AS nat FROM e WINDOW w AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register(
    "chamber_predictions",
    f"""WITH {_CHAMBER_SQL} SELECT u.nationkey, u.region, u.year, round(share, 6) AS actual, round(CASE WHEN share IN (0, 1) THEN share ELSE least(greatest(a + b * forecast, 0), 1) END, 6) AS pred, round(CASE WHEN share IN (0, 1) THEN 0 ELSE sqrt(sd * sd + b * b * nat * nat) END, 6) AS sigma,
    CASE WHEN share IN (0, 1) THEN 'one_sided' ELSE 'unit_model' END AS source, through AS train_through FROM u JOIN v ON v.year = u.year""",
)
def chamber_predictions(spark, sf_dir):
    return rounded(_chamber(spark, sf_dir)[0])


@register(
    "chamber_omitted",
    f"""WITH {_CHAMBER_SQL}, n AS (SELECT year, count(*) AS n_rows, count(DISTINCT nationkey) AS n_units FROM u GROUP BY year)
    SELECT year, CASE WHEN n_rows <> 25 THEN 'incomplete' WHEN year = 2000 THEN 'other_winner' ELSE 'short_history' END AS reason, n_rows, n_units FROM n WHERE year NOT IN (SELECT year FROM v)""",
)
def chamber_omitted(spark, sf_dir):
    """The cycles that are not predicted, with their reasons."""
    return _chamber(spark, sf_dir)[1]


@register(
    "interval_gate",
    f"""WITH r AS (SELECT nationkey % 3 AS model, year, share, m, base FROM ({UNITS_SQL})), i AS (SELECT model, year, avg(share) AS lo, max(share) AS hi, avg(base) + 0.05 AS x, count(*) AS n FROM r GROUP BY 1, 2),
    s AS (SELECT *, x BETWEEN lo AND hi AS covered, hi - lo + 20 * greatest(lo - x, 0) + 20 * greatest(x - hi, 0) AS score FROM i), p AS (SELECT model, count(DISTINCT year) AS n, avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END) AS c, avg(score) AS s, bool_and(n = 8) AS whole FROM s GROUP BY 1)
    SELECT CAST(a.model AS INTEGER) AS model, a.n AS n_cycles, round(a.c, 6) AS coverage, round(a.s, 6) AS score, round(b.s, 6) AS rival_score, a.n >= 4 AND a.c >= 0.5 AND a.s < b.s AS subset_passed, a.n >= 4 AND a.c >= 0.5 AND a.s < b.s AND a.whole AS promoted FROM p a, p b WHERE a.model <> 0 AND b.model = 0""",
)
def interval_gate(spark, sf_dir):
    from ..operators.evaluation import interval_score

    rows = units(spark, sf_dir).groupBy((F.col("nationkey") % 3).cast("int").alias("model"), "year").agg(F.avg("share").alias("lo"), F.max("share").alias("hi"), (F.avg("base") + 0.05).alias("x"), F.count("*").alias("n"))
    folds = rows.select("model", "year", "n", F.col("x").between(F.col("lo"), F.col("hi")).alias("covered"), interval_score(F.col("lo"), F.col("hi"), F.col("x")).alias("score"))
    gate = environment.interval_gate(folds.withColumn("model", F.col("model").cast("string")), "model", "year", "covered", "score", "n", 8, "0", 4, 0.5)
    return rounded(gate.withColumn("model", F.col("model").cast("int")))


@register(
    "metrics_gate",
    f"""WITH r AS (SELECT nationkey % 4 AS office, nationkey % 2 AS segment, year, abs(share - m) AS e1, abs(base - m) AS e0 FROM ({UNITS_SQL})), s AS (SELECT office, year % 2 AS segment, count(DISTINCT year) AS n, avg(e1) AS a, avg(e0) AS b, avg(e1 * e1) AS a2, avg(e0 * e0) AS b2, avg(CASE WHEN e1 < 0.2 THEN 1.0 ELSE 0.0 END) AS c FROM r GROUP BY 1, 2),
    g AS (SELECT *, n >= 3 AND c >= 0.5 AND a < b AND a2 < b2 AS good FROM s) SELECT CAST(office AS INTEGER) AS office, bool_and(good) AS metrics_passed, coalesce(string_agg(CAST(segment AS VARCHAR), ',' ORDER BY segment) FILTER (WHERE NOT good), '') AS failed, office = 1 AS vintage_passed, bool_and(good) AND office = 1 AS review_candidate FROM g GROUP BY office""",
)
def metrics_gate(spark, sf_dir):
    keyed = units(spark, sf_dir).select((F.col("nationkey") % 4).cast("int").alias("office"), (F.col("year") % 2).cast("string").alias("segment"), "year", F.abs(F.col("share") - F.col("m")).alias("corrected"), F.abs(F.col("base") - F.col("m")).alias("base"))
    both = keyed.unpivot(["office", "segment", "year"], ["corrected", "base"], "pipeline", "e")
    scores = both.groupBy("office", "pipeline", "segment").agg(F.countDistinct("year").alias("n_cycles"), F.avg("e").alias("mae"), F.avg(F.col("e") * F.col("e")).alias("brier"), F.avg((F.col("e") < 0.2).cast("double")).alias("coverage_90"))
    return environment.metrics_gate(scores, "office", "pipeline", "segment", ["mae", "brier"], "corrected", "base", {1: True}, 3, 0.5)


@register(
    "attach_targets",
    """WITH c AS (SELECT o_custkey % 90 AS k, min(o_orderkey) AS race_id, min(o_totalprice) / 400000 AS share, min(o_orderkey) % 5 <> 0 AS certified, min(o_orderkey) % 7 = 0 AS uncontested, CASE WHEN min(o_orderkey) % 11 = 0 THEN 'OTHER' ELSE 'A' END AS winner FROM orders WHERE o_custkey % 90 < 80 AND o_orderkey % 40 = 0 GROUP BY 1 HAVING count(*) = 1),
    r AS (SELECT c_custkey, c_custkey % 90 AS k FROM customer), j AS (SELECT c_custkey, race_id, share, certified, uncontested, winner, CASE WHEN c_custkey % 2 = 0 THEN share ELSE share + 0.01 END AS archived FROM r LEFT JOIN c USING (k))
    SELECT c_custkey, race_id, round(share, 6) AS share, CASE WHEN race_id IS NULL THEN 'missing_or_ambiguous_race' WHEN NOT certified THEN 'not_certified' WHEN uncontested THEN 'uncontested_or_unknown' WHEN winner = 'OTHER' THEN 'other_party_winner' WHEN abs(archived - share) > 0.0005 THEN 'share_mismatch' ELSE '' END AS exclusion FROM j""",
)
def attach_targets(spark, sf_dir):
    key = F.col("o_orderkey")
    canonical = table(spark, sf_dir, "orders").where("o_custkey % 90 < 80 and o_orderkey % 40 = 0").select((F.col("o_custkey") % 90).alias("k"), key.alias("race_id"), (F.col("o_totalprice") / 400000).alias("share"), (key % 5 != 0).alias("certified"), (key % 7 == 0).alias("uncontested"), F.when(key % 11 == 0, "OTHER").otherwise("A").alias("winner"))
    once = canonical.groupBy("k").agg(F.min("share").alias("archived"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 90).alias("k")).join(once, "k", "left")
    rows = rows.withColumn("archived", F.when(F.col("c_custkey") % 2 == 0, F.col("archived")).otherwise(F.col("archived") + 0.01))
    return rounded(environment.attach_targets(rows, canonical, ["k"], "archived", "share").select("c_custkey", "race_id", "share", "exclusion"))


@register(
    "quarantine_sensitivity",
    f"""WITH u AS (SELECT year, base, share, quality = 'ok' AS kept FROM ({UNITS_SQL})), a AS (SELECT t.year, regr_slope(p.share, p.base) AS b, regr_intercept(p.share, p.base) AS a FROM (SELECT DISTINCT year FROM u) t JOIN u p ON p.year <> t.year AND p.kept GROUP BY 1),
    c AS (SELECT t.year, regr_slope(p.share, p.base) AS b, regr_intercept(p.share, p.base) AS a FROM (SELECT DISTINCT year FROM u) t JOIN u p ON p.year <> t.year GROUP BY 1),
    x AS (SELECT count(*) AS n, avg(abs(a + b * base - share)) AS e FROM u JOIN a ON a.year = u.year WHERE kept), y AS (SELECT count(*) AS n, avg(abs(a + b * base - share)) AS e FROM u JOIN c ON c.year = u.year)
    SELECT x.n AS n_excluding, round(x.e, 6) AS mae_excluding, y.n AS n_including, round(y.e, 6) AS mae_including, round(y.e - x.e, 6) AS mae_delta FROM x, y""",
)
def quarantine_sensitivity(spark, sf_dir):
    rows = units(spark, sf_dir)
    return rounded(environment.quarantine_sensitivity(rows.where("quality = 'ok'"), rows.where("quality <> 'ok'"), ["base"], "share", "year"))


@register(
    "interim_scores",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice / 600000 AS y, o_totalprice > 250000 AS win FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1995-06-30'), r AS (SELECT o_orderkey AS k, run, 'q' || (o_orderkey % 4) AS part, o_custkey % 100 / 100.0 + run * 0.01 AS share, 0.2 AS sigma, (o_custkey % 97) / 100.0 AS p FROM orders, (SELECT unnest([1, 2]) AS run)),
    s AS (SELECT run, part, share - y AS e, p, CASE WHEN win THEN 1.0 ELSE 0.0 END AS w, sigma FROM r JOIN a USING (k)), x AS (SELECT *, 'overall' AS split, 'all' AS level FROM s UNION ALL SELECT *, 'part', part FROM s)
    SELECT run, split, level, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg((p - w) * (p - w)), 6) AS brier, round(avg(-(w * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - w) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) AS log_score, round(avg(CASE WHEN abs(e) <= 1.6448536269514722 * sigma THEN 1.0 ELSE 0.0 END), 6) AS coverage_90, round(avg(CASE WHEN (p > 0.5) = (w > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM x GROUP BY ALL""",
)
def interim_scores(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    actuals = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 600000).alias("actual_share"), (F.col("o_totalprice") > 250000).alias("actual_win"), F.col("o_orderdate").cast("date").alias("certified_on"))
    run = F.explode(F.array(F.lit(1), F.lit(2))).alias("run")
    runs = orders.select(F.col("o_orderkey").alias("k"), "o_custkey", F.concat(F.lit("q"), (F.col("o_orderkey") % 4).cast("string")).alias("part"), run)
    runs = runs.select("k", "run", "part", (F.col("o_custkey") % 100 / 100.0 + F.col("run") * 0.01).alias("share"), F.lit(0.2).alias("sigma"), (F.col("o_custkey") % 97 / 100.0).alias("p"))
    return rounded(environment.interim_scores(runs, actuals, "run", "k", "1995-06-30", ["part"]))
