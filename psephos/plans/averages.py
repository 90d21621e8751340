"""Queries of panels, polls and grouping sets. Purchases and other events play polls: users are pollsters, props.k sample sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panels, polls
from .catalog import register, table
from .timing import PANEL_SQL, events, panel

NATIONAL_SQL = f"SELECT year, sum(share * (first_votes + second_votes)) / sum(first_votes + second_votes) AS m FROM ({PANEL_SQL}) WHERE share IS NOT NULL GROUP BY year"

def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).withColumn("w", F.col("first_votes") + F.col("second_votes"))


@register("national_weighted_mean", f"SELECT year, round(m, 9) AS mean_share FROM ({NATIONAL_SQL})")
def national_weighted_mean(spark, sf_dir):
    return weighted(spark, sf_dir).groupBy("year").agg(F.round(panels.weighted_mean(F.col("share"), F.col("w")), 9).alias("mean_share"))


PARTISAN_SQL = f"SELECT nationkey, avg(share - m) AS score, count(share - m) AS n_periods FROM ({PANEL_SQL}) p JOIN ({NATIONAL_SQL}) n USING (year) GROUP BY nationkey"


@register("partisanship_score", f"SELECT nationkey, round(score, 9) AS score, n_periods FROM ({PARTISAN_SQL})")
def partisanship_score(spark, sf_dir):
    return panels.partisanship(weighted(spark, sf_dir), ["nationkey"], "year", "share", "w").select("nationkey", F.round("score", 9).alias("score"), "n_periods")


@register("lean_label", f"SELECT nationkey, CASE WHEN r > 0 THEN 'D+' || r WHEN r < 0 THEN 'R+' || -r ELSE 'EVEN' END AS label FROM (SELECT nationkey, CAST(round_even(score * 100, 0) AS INTEGER) AS r FROM ({PARTISAN_SQL}))")
def lean_label(spark, sf_dir):
    return panels.partisanship(weighted(spark, sf_dir), ["nationkey"], "year", "share", "w").select("nationkey", "label")


@register("national_swing", f"SELECT year, round(m, 9) AS mean_share, round(m - lag(m) OVER (ORDER BY year), 9) AS swing FROM ({NATIONAL_SQL})")
def national_swing(spark, sf_dir):
    return panels.national_swing(weighted(spark, sf_dir), "year", "share", "w").select("year", F.round("mean_share", 9).alias("mean_share"), F.round("swing", 9).alias("swing"))


SWING_SQL = f"""WITH p AS ({PANEL_SQL}), n AS (SELECT year, m - lag(m) OVER (ORDER BY year) AS s FROM ({NATIONAL_SQL}))
SELECT b.nationkey, b.year, b.share - a.share AS own_swing, n.s AS national_swing FROM p b JOIN p a ON a.nationkey = b.nationkey AND a.year = b.year - 1 JOIN n ON n.year = b.year WHERE n.s IS NOT NULL"""


@register("swing_panel", f"SELECT nationkey, year, round(own_swing, 9) AS own_swing, round(national_swing, 9) AS national_swing FROM ({SWING_SQL})")
def swing_panel(spark, sf_dir):
    out = panels.swing_panel(weighted(spark, sf_dir), ["nationkey"], "year", "share", "w")
    return out.select("nationkey", "year", F.round("own_swing", 9).alias("own_swing"), F.round("national_swing", 9).alias("national_swing"))


@register(
    "swing_ratio_by_era",
    f"SELECT CAST(CASE WHEN year < 1999 THEN 1 ELSE 2 END AS INTEGER) AS era, CAST(regr_count(own_swing, national_swing) AS BIGINT) AS n, round(regr_slope(own_swing, national_swing), 6) AS slope, round(regr_intercept(own_swing, national_swing), 6) AS intercept, round(regr_r2(own_swing, national_swing), 6) AS r2, true AS identified FROM ({SWING_SQL}) GROUP BY 1",
)
def swing_ratio_by_era(spark, sf_dir):
    rows = panels.swing_panel(weighted(spark, sf_dir), ["nationkey"], "year", "share", "w").withColumn("era", F.when(F.col("year") < 1999, 1).otherwise(2))
    out = panels.slope_by(rows, ["era"], "own_swing", "national_swing")
    return out.select("era", "n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")), "identified")


@register(
    "fundraising_rollup",
    """WITH t AS (SELECT c_nationkey, c_mktsegment AS p, c_acctbal AS a, c_custkey AS w FROM customer), f AS (
    SELECT c_nationkey, max({'a': a, 'w': -w}) FILTER (WHERE p = 'BUILDING') AS x, max({'a': a, 'w': -w}) FILTER (WHERE p = 'MACHINERY') AS y FROM t GROUP BY 1)
    SELECT c_nationkey, -x.w AS "BUILDING_top", x.a AS "BUILDING_amount", -y.w AS "MACHINERY_top", y.a AS "MACHINERY_amount", round(ln((coalesce(x.a, 0) + 1e4) / (coalesce(y.a, 0) + 1e4)), 9) AS log_ratio FROM f""",
)
def fundraising_rollup(spark, sf_dir):
    out = panels.top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], ["BUILDING", "MACHINERY"], "c_mktsegment", "c_acctbal", "c_custkey")
    return out.withColumn("log_ratio", F.round("log_ratio", 9))


@register("region_rollup_total", "SELECT coalesce(CAST(n_regionkey AS VARCHAR), 'all') AS n_regionkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY GROUPING SETS ((n_regionkey), ())")
def region_rollup_total(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return panels.with_totals(rows, ["n_regionkey"], [F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")])


@register(
    "split_scores",
    """WITH e AS (SELECT o_orderstatus, o_orderpriority, abs(o_totalprice - 150000) AS e FROM orders)
    SELECT 'overall' AS split, 'all' AS level, count(*) AS n, round(avg(e), 4) AS mae FROM e UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*), round(avg(e), 4) FROM e GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(avg(e), 4) FROM e GROUP BY 2""",
)
def split_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.abs(F.col("o_totalprice") - 150000).alias("e"))
    return panels.split_scores(rows, ["o_orderstatus", "o_orderpriority"], [F.count("*").alias("n"), F.round(F.avg("e"), 4).alias("mae")])


@register("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return panels.value_counts(table(spark, sf_dir, "events"), "event_type")


@register("lean_dispersion", "SELECT p_brand, round(stddev_pop(p_retailprice), 6) AS dispersion, count(p_retailprice) AS n FROM part GROUP BY p_brand")
def lean_dispersion(spark, sf_dir):
    return panels.dispersion(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice").withColumn("dispersion", F.round("dispersion", 6))


REGION_SQL = """SELECT n_regionkey, sum(CASE WHEN year(l_shipdate) = 1996 AND l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a0, sum(CASE WHEN year(l_shipdate) = 1996 AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS b0,
    sum(CASE WHEN year(l_shipdate) = 2000 AND l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a1, sum(CASE WHEN year(l_shipdate) = 2000 AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS b1
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"""


@register(
    "region_swing",
    f"WITH r AS ({REGION_SQL}), t AS (SELECT sum(a1) / (sum(a1) + sum(b1)) - sum(a0) / (sum(a0) + sum(b0)) AS s FROM r) SELECT n_regionkey, round(a0 / (a0 + b0), 9) AS share_before, round(a1 / (a1 + b1), 9) AS share_after, round(a1 / (a1 + b1) - a0 / (a0 + b0), 9) AS swing, round(a1 / (a1 + b1) - a0 / (a0 + b0) - t.s, 9) AS excess_swing FROM r, t",
)
def region_swing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    vote = lambda y, p: F.when((F.year("l_shipdate") == y) & (F.col("l_returnflag") == p), F.col("l_quantity")).otherwise(0.0)
    rows = li.select("n_regionkey", vote(1996, "A").alias("a0"), vote(1996, "R").alias("b0"), vote(2000, "A").alias("a1"), vote(2000, "R").alias("b1"))
    out = panels.region_swing(rows, ["n_regionkey"], ["a0", "b0"], ["a1", "b1"])
    return out.select("n_regionkey", *(F.round(c, 9).alias(c) for c in ("share_before", "share_after", "swing", "excess_swing")))


@register("specials_summary", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY event_type")
def specials_summary(spark, sf_dir):
    out = panels.specials_summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "se")))


POLL_SQL = """SELECT event_type, user_id, value / (value + 50) AS s, exp(-ln(2) * greatest(date_diff('second', ts, TIMESTAMP '2024-02-01') / 86400.0, 0) / 21) * sqrt(k + 1) AS w, k + 1 AS n
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE value >= 0"""


def poll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "ts"))) / 86400.0
    return events(spark, sf_dir).where("value >= 0").select(
        "event_type", "user_id", (F.col("value") / (F.col("value") + 50)).alias("s"), (polls.decay(age, 21.0) * F.sqrt(F.col("k") + 1.0)).alias("w"), (F.col("k") + 1).alias("n")
    )


AVERAGE_SQL = f"""WITH p AS ({POLL_SQL}), g AS (SELECT event_type, sum(w * s) / sum(w) AS m, sum(w * w * s * (1 - s) / n) / (sum(w) * sum(w)) AS v, sum(w * s * s) / sum(w) AS q, count(*) AS n_polls, count(DISTINCT user_id) AS n_pollsters, sum(w) * sum(w) / sum(w * w) AS e FROM p GROUP BY 1)
SELECT event_type, m AS poll_mean, sqrt(v + greatest(q - m * m, 0) + 0.025 * 0.025) AS poll_sigma, n_polls, n_pollsters, e AS effective_polls FROM g"""


@register("poll_average", f"SELECT event_type, round(poll_mean, 7) AS poll_mean, round(poll_sigma, 7) AS poll_sigma, n_polls, n_pollsters, round(effective_polls, 4) AS effective_polls FROM ({AVERAGE_SQL})")
def poll_average(spark, sf_dir):
    out = polls.average(poll_rows(spark, sf_dir), ["event_type"], "s", F.col("w"), "n", "user_id")
    return out.select("event_type", F.round("poll_mean", 7).alias("poll_mean"), F.round("poll_sigma", 7).alias("poll_sigma"), "n_polls", "n_pollsters", F.round("effective_polls", 4).alias("effective_polls"))


@register(
    "poll_blend",
    f"WITH a AS ({AVERAGE_SQL}), b AS (SELECT event_type, 0.5 AS m, 0.08 AS s, CASE WHEN event_type <> 'click' THEN poll_mean END AS pm, CASE WHEN event_type <> 'click' THEN poll_sigma END AS ps FROM a) SELECT event_type, round(CASE WHEN pm IS NULL THEN m ELSE (m / (s * s) + pm / (ps * ps)) / (1 / (s * s) + 1 / (ps * ps)) END, 7) AS blend_mean, round(CASE WHEN pm IS NULL THEN s ELSE greatest(sqrt(1 / (1 / (s * s) + 1 / (ps * ps))), 0.02) END, 7) AS blend_sigma, round(CASE WHEN pm IS NULL THEN 0 ELSE 1 / (ps * ps) / (1 / (s * s) + 1 / (ps * ps)) END, 7) AS poll_weight, CASE WHEN pm IS NULL THEN 'fundamentals_only' ELSE 'fundamentals+polls' END AS signal FROM b",
)
def poll_blend(spark, sf_dir):
    rows = polls.average(poll_rows(spark, sf_dir), ["event_type"], "s", F.col("w"), "n", "user_id")
    known = F.col("event_type") != "click"
    out = rows.select("event_type", *(c.alias(n) for n, c in polls.blend(F.lit(0.5), F.lit(0.08), F.when(known, F.col("poll_mean")), F.when(known, F.col("poll_sigma"))).items()))
    return out.select("event_type", *(F.round(c, 7).alias(c) for c in ("blend_mean", "blend_sigma", "poll_weight")), "signal")


@register(
    "house_effects",
    "WITH c AS (SELECT user_id, event_type, value - avg(value) OVER (PARTITION BY event_type) AS c FROM events), g AS (SELECT user_id, count(*) AS n_polls, count(DISTINCT event_type) AS n_periods, sum(c) AS s FROM c GROUP BY 1) SELECT user_id, n_polls, n_periods, n_polls >= 5 AND n_periods >= 2 AS identified, round(CASE WHEN n_polls >= 5 AND n_periods >= 2 THEN s / (n_polls + 5) ELSE 0 END, 7) AS house_effect FROM g",
)
def house_effects(spark, sf_dir):
    return polls.house_effects(table(spark, sf_dir, "events"), "user_id", "event_type", "value").withColumn("house_effect", F.round("house_effect", 7))


@register("question_weights", "SELECT event_id, round(1.0 / count(*) OVER (PARTITION BY event_type, user_id), 9) AS question_weight FROM events")
def question_weights(spark, sf_dir):
    return polls.question_weights(table(spark, sf_dir, "events"), "event_type", "user_id").select("event_id", F.round("question_weight", 9).alias("question_weight"))


@register(
    "answer_pairs",
    """WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS first_value, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS second_value FROM lineitem GROUP BY 1)
    SELECT l_orderkey, first_value, second_value, CASE WHEN a = 0 THEN 'no_first' WHEN b = 0 THEN 'no_second' WHEN a > 1 THEN 'several_first' WHEN b > 1 THEN 'several_second' ELSE 'accepted' END AS reason FROM g""",
)
def answer_pairs(spark, sf_dir):
    return polls.unique_pair(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", "A", "R")


@register("first_reason", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderstatus <> 'F' THEN 'open' WHEN year(o_orderdate) < 1997 THEN 'old' END AS reason FROM orders")
def first_reason(spark, sf_dir):
    reason = polls.first_reason([("small", F.col("o_totalprice") >= 50000), ("open", F.col("o_orderstatus") == "F"), ("old", F.year("o_orderdate") >= 1997)])
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))
