"""Queries of forecast composites and of smaller relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasts, panels, polls
from .averages import weighted
from .catalog import register, table
from .timing import PANEL_SQL


@register("label_precedence", "SELECT l_suppkey, CASE WHEN bool_or(l_returnflag = 'A' AND l_quantity > 49) THEN 'A' WHEN bool_or(l_returnflag = 'R') THEN 'R' ELSE 'OTHER' END AS label FROM lineitem GROUP BY 1")
def label_precedence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when((F.col("l_returnflag") != "A") | (F.col("l_quantity") > 49), F.col("l_returnflag")).alias("p"))
    return panels.label_precedence(rows, ["l_suppkey"], "p", ["A", "R"])


@register(
    "state_rollup_suspect",
    "WITH s AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS b, sum(l_quantity) AS t FROM lineitem GROUP BY 1) SELECT l_suppkey, a AS first_votes, b AS second_votes, t AS total_votes, (a + b) / t < 0.5 AS two_party_suspect FROM s",
)
def state_rollup_suspect(spark, sf_dir):
    vote = lambda p: F.when(F.col("l_returnflag") == p, F.col("l_quantity")).otherwise(0.0)
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", vote("A").alias("a"), vote("R").alias("b"), "l_quantity")
    return panels.suspect_states(rows, ["l_suppkey"], "a", "b", "l_quantity")


@register("worst_errors", "SELECT o_orderkey, o_totalprice - 150000 AS error FROM orders ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey LIMIT 8")
def worst_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 150000).alias("error"))
    return panels.worst(rows, "error", 8, ["o_orderkey"])


@register("reviewed_override", "SELECT c_custkey, CASE WHEN c_nationkey = 3 AND c_mktsegment = 'BUILDING' THEN 'REVIEWED' ELSE c_mktsegment END AS party, c_nationkey = 3 AND c_mktsegment = 'BUILDING' AS overridden FROM customer")
def reviewed_override(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"), F.col("c_mktsegment").alias("party"))
    reviewed = spark.createDataFrame([(3, "BUILDING", "REVIEWED")], "c_nationkey int, segment string, party string")
    return panels.with_override(rows, reviewed, ["c_nationkey", "segment"], "party").select("c_custkey", "party", "overridden")


HISTORY_SQL = f"SELECT year, sum(share * (first_votes + second_votes)) / sum(first_votes + second_votes) AS n, CAST(year % 3 AS INTEGER) - 1 AS s FROM ({PANEL_SQL}) WHERE share IS NOT NULL GROUP BY year"


@register(
    "national_history",
    f"WITH h AS ({HISTORY_SQL}), w AS (SELECT year, s, lag(n) OVER (ORDER BY year) AS l, n - lag(n) OVER (ORDER BY year) AS d FROM h) SELECT a.year, round(least(greatest(a.l + coalesce(avg(b.d), 0), 0), 1), 8) AS forecast FROM w a LEFT JOIN w b ON b.year < a.year AND b.s = a.s AND a.s <> 0 WHERE a.l IS NOT NULL GROUP BY a.year, a.l",
)
def national_history(spark, sf_dir):
    rows = weighted(spark, sf_dir).groupBy("year").agg(panels.weighted_mean(F.col("share"), F.col("w")).alias("n"))
    rows = rows.withColumn("s", (F.col("year") % 3 - 1).cast("int"))
    return forecasts.national_history(rows, "year", "n", "s").select("year", F.round("forecast", 8).alias("forecast"))


@register(
    "contest_panel",
    f"WITH p AS ({PANEL_SQL}), n AS (SELECT year, sum(share * (first_votes + second_votes)) / sum(CASE WHEN share IS NOT NULL THEN first_votes + second_votes END) AS m FROM p GROUP BY 1) SELECT b.nationkey, b.year, round(a.share, 8) AS lag_share, round(n.m, 8) AS national_share, round(a.share - l.m, 8) AS lag_lean FROM p b LEFT JOIN p a ON a.nationkey = b.nationkey AND a.year + 1 = b.year LEFT JOIN n ON n.year = b.year LEFT JOIN n l ON l.year + 1 = b.year",
)
def contest_panel(spark, sf_dir):
    out = forecasts.contest_panel(weighted(spark, sf_dir), ["nationkey"], "year", "share", "w", 1)
    return out.select("nationkey", "year", *(F.round(c, 8).alias(c) for c in ("lag_share", "national_share", "lag_lean")))


@register("overperformance", "SELECT o_orderkey, round(a / nullif(a + b, 0), 8) AS special_share, round((a - b) / nullif(a + b, 0) - (2 * 0.52 - 1), 8) AS overperformance, round((a + b) / 300, 8) AS turnout_ratio FROM (SELECT l_orderkey AS o_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS b FROM lineitem GROUP BY 1)")
def overperformance(spark, sf_dir):
    vote = lambda p: F.sum(F.when(F.col("l_returnflag") == p, F.col("l_quantity")).otherwise(0.0))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(vote("A").alias("a"), vote("R").alias("b")).withColumns({"s": F.lit(0.52), "v": F.lit(300)})
    out = forecasts.overperformance(rows, "a", "b", "s", "v")
    return out.select("o_orderkey", *(F.round(c, 8).alias(c) for c in ("special_share", "overperformance", "turnout_ratio")))


@register("shrinkage_bounds", "SELECT count(r) AS n_pairs, 'bound' AS status, round(min(r), 8) AS low, round(max(r), 8) AS high FROM (SELECT p_retailprice / p_size AS r FROM part)")
def shrinkage_bounds(spark, sf_dir):
    out = forecasts.shrinkage_bounds(table(spark, sf_dir, "part"), "p_size", "p_retailprice")
    return out.select("n_pairs", "status", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@register("executive_party", f"WITH p AS (SELECT * FROM ({PANEL_SQL}) WHERE share IS NOT NULL) SELECT year, CASE WHEN sum(CASE WHEN share > 0.5 THEN nationkey + 3 ELSE 0 END) * 2 > sum(nationkey + 3) THEN 'first' ELSE 'second' END AS party FROM p GROUP BY 1")
def executive_party(spark, sf_dir):
    electors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), (F.col("n_nationkey") + 3).alias("ev"))
    return forecasts.executive_party(weighted(spark, sf_dir), electors, "year", "nationkey", "share", "ev")


@register(
    "race_averages",
    """WITH i AS (SELECT event_type AS race, user_id AS poll, value / (value + 50) AS x, k + 1 AS n, user_id % 40 + 15.0 AS d FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE value >= 0 AND user_id % 40 + 15 BETWEEN 21 AND 45),
    q AS (SELECT *, exp(-ln(2) * greatest(d - 21, 0) / 21) * sqrt(n) / count(*) OVER (PARTITION BY race, poll) AS w FROM i),
    p AS (SELECT race, poll, sum(w) AS w, sum(w * x) AS ws, sum(w * x * x) AS wss, max(n) AS n, count(*) AS q FROM q GROUP BY 1, 2),
    r AS (SELECT race, sum(ws) / sum(w) AS m, sum(wss) / sum(w) AS m2, sum(w * w / n) / (sum(w) * sum(w)) AS v, count(*) AS n_polls, CAST(sum(q) AS BIGINT) AS n_questions FROM p GROUP BY 1)
    SELECT race, round(m, 7) AS poll_mean, round(sqrt(greatest(m2 - m * m, 0) + v * m * (1 - m) + 0.025 * 0.025), 7) AS poll_sigma, n_polls, n_questions FROM r""",
)
def race_averages(spark, sf_dir):
    from .timing import events

    rows = events(spark, sf_dir).where("value >= 0").select(
        F.col("event_type").alias("race"), F.col("user_id").alias("poll"), (F.col("value") / (F.col("value") + 50)).alias("x"), (F.col("k") + 1).alias("n"), (F.col("user_id") % 40 + 15.0).alias("d"), F.lit(0.5).alias("p"), F.lit(0.1).alias("ps")
    )
    out = forecasts.race_averages(rows, "race", "poll", "x", "n", "d", "p", "ps", 21, 24)
    return out.select("race", F.round("poll_mean", 7).alias("poll_mean"), F.round("poll_sigma", 7).alias("poll_sigma"), "n_polls", "n_questions")


@register(
    "allocation_backtest",
    """WITH k AS (SELECT c_nationkey AS county, c_mktsegment AS district, sum(c_acctbal) AS actual, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY 1, 2)
    SELECT county, district, round(actual, 4) AS actual, round(sum(actual) OVER c * w / sum(w) OVER c, 4) AS allocated FROM k WINDOW c AS (PARTITION BY county)""",
)
def allocation_backtest(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("county"), F.col("c_mktsegment").alias("district"), "c_acctbal", F.lit(1.0).alias("w"))
    out = forecasts.allocation_backtest(rows, ["county"], "district", "c_acctbal", "w")
    return out.select("county", "district", F.round("actual", 4).alias("actual"), F.round("allocated", 4).alias("allocated"))


@register("geography_spine", """SELECT 'nation:us' AS geography_id, 'nation' AS level, NULL AS parent UNION ALL SELECT DISTINCT 'state:' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), 'state', 'nation:us' FROM customer
    UNION ALL SELECT DISTINCT 'state:' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '|district:cong_' || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0'), 'district', 'state:' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') FROM customer""")
def geography_spine(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("f"), (F.col("c_custkey") % 12).alias("d"))
    return forecasts.geography_spine(rows, "f", "d")


@register("prepared_archive", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 20000 AND o_orderstatus <> 'P' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 20000 AND o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) = 1)")
def prepared_archive(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    kept, _ = forecasts.prepared_archive(rows, [("price", F.col("o_totalprice") >= 20000), ("status", F.col("o_orderstatus") != "P")], ["o_custkey"])
    return kept.select("o_orderkey", "o_custkey")


@register("fractions", "SELECT event_id, CASE WHEN abs(value) <= 1 THEN value ELSE value / 100 END AS share FROM events")
def fractions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", polls.fraction(F.col("value")).alias("share"))


@register("semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi_join(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(large, "o_orderkey", "left_semi")


@register("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")
