"""Queries of smaller operators: text details, flags, gates, transfers, rosters and scenarios."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import calendar, text
from ..operators import allocation, checks, collapse, evaluation, forecasts, gates, observed, panels, reconcile, seats, windows
from ..sources import staging
from .catalog import register, table
from .outlook import UNITS_SQL, rounded, units


@register(
    "text_details",
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'Garcia' ELSE 'Zoe' END || ' x' AS folded, 'JOSÉ' AS mended, CASE c_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 7 WHEN 3 THEN NULL ELSE 0 END AS district,
    CASE c_nationkey % 4 WHEN 0 THEN 1234567 WHEN 1 THEN NULL ELSE -12 END AS number, CASE c_nationkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 9 END AS roman, c_nationkey % 2 = 0 AS flag, c_name LIKE '%' AND c_nationkey % 6 <> 1 AS person, 'special' AS suffix FROM customer""",
)
def text_details(spark, sf_dir):
    """Accents, charsets, district labels, numbers, numerals, flags, persons and suffixes as ballots write them."""
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_nationkey") % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.folded(pick(3, "García x", "Zoë x", "Zoé x")).alias("folded"),
        text.unmangled(pick(2, "JOSÉ", "JOSÃ\x89")).alias("mended"),
        text.district_number(pick(5, "At-Large", "District 02", "Seventh Congressional", "unknown", "STATEWIDE")).alias("district"),
        text.whole_number(pick(4, "1,234,567", "n/a", " -12 ", "-12")).alias("number"),
        text.roman(pick(3, "iv", " IX", "C")).alias("roman"),
        text.flag(pick(2, " yes", "no")).alias("flag"),
        text.is_person(F.when(F.col("c_nationkey") % 6 == 1, "Blank Vote/Scattering").otherwise(F.col("c_name"))).alias("person"),
        text.id_suffix(F.concat_ws("_", F.lit("2024_us_house"), F.col("c_custkey").cast("string"), F.lit("special"))).alias("suffix"),
    )


@register("senate_class", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CASE CAST(year(o_orderdate) AS INTEGER) % 6 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 0 THEN 3 END AS INTEGER) AS class FROM orders")
def senate_class(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct().select("year", calendar.senate_class(F.col("year")).alias("class"))


@register("mask_unreported", "SELECT l_orderkey, l_linenumber, CASE WHEN bool_or(l_quantity > 40) OVER (PARTITION BY l_orderkey) THEN l_quantity END AS votes FROM lineitem")
def mask_unreported(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("votes"), F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("total"))
    return collapse.mask_unreported(rows, "l_orderkey", "total", "votes").select("l_orderkey", "l_linenumber", "votes")


@register("general_stage", "SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n_dropped FROM lineitem WHERE l_returnflag <> 'R'")
def general_stage(spark, sf_dir):
    """Rows of two stages, one of which is unnamed, and how many others were dropped."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("stage"))
    path = f"{staging.shared_dir(spark)}/general-{uuid.uuid4().hex}"
    counts = collapse.write_general_stage(rows, path, "stage", ["gen", "A"])
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", F.lit(counts["dropped_non_general"]).cast("bigint").alias("n_dropped"))


@register(
    "gated_write",
    """SELECT 'price_positive' AS check_name, count(*) FILTER (WHERE o_totalprice <= 0) = 0 AS passed, count(*) FILTER (WHERE o_totalprice <= 0) AS n_bad, (SELECT count(*) FROM orders) AS n_published FROM orders
    UNION ALL SELECT 'status_known', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) = 0, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')), (SELECT count(*) FROM orders) FROM orders
    UNION ALL SELECT 'not_empty', count(*) > 0, CAST(count(*) = 0 AS BIGINT), (SELECT count(*) FROM orders) FROM orders""",
)
def gated_write(spark, sf_dir):
    """A table that is published only as its gate passes, with the gate's counts from the pass that writes it."""
    path = f"{staging.shared_dir(spark)}/gated-{uuid.uuid4().hex}"
    found = observed.gated(table(spark, sf_dir, "orders"), path, {"price_positive": F.col("o_totalprice") > 0, "status_known": F.col("o_orderstatus").isin("F", "O", "P")})
    n = spark.read.parquet(path).count() if all(passed for _, passed, _ in found) else 0
    return spark.createDataFrame([(*row, n) for row in found], "check_name string, passed boolean, n_bad bigint, n_published bigint")


@register("spread_known", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END) OVER (PARTITION BY o_custkey)) AS label FROM orders")
def spread_known(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("label"))
    return windows.spread_known(rows, ["o_custkey"], "label").select("o_orderkey", "label")


@register("worst_flags", "SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' ELSE 'N' END AS l_returnflag FROM lineitem GROUP BY 1")
def worst_flags(spark, sf_dir):
    return allocation.worst_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["R", "A", "N"])


@register(
    "usable_areas",
    """WITH c AS (SELECT c_nationkey AS k, c_acctbal > -500 AS placed FROM customer), s AS (SELECT avg(CASE WHEN placed THEN 1.0 ELSE 0.0 END) AS share FROM c), m AS (SELECT count(*) AS missing FROM nation WHERE n_nationkey NOT IN (SELECT k FROM c WHERE placed))
    SELECT missing = 0 AND share >= 0.9 AS usable, CAST(share AS DOUBLE) AS placed_share, missing FROM s, m""",
)
def usable_areas(spark, sf_dir):
    """Whether enough customers are placed, those without a large debt, and every nation has one of them."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_acctbal") > -500).alias("placed"))
    share = rows.agg(F.avg(F.col("placed").cast("double"))).first()[0]
    return allocation.usable(share, rows.where("placed").select("k"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), "k")


@register(
    "transfer_backtest",
    f"""WITH u AS (SELECT share AS y, CASE WHEN quality = 'ok' THEN base END AS t, m FROM ({UNITS_SQL})), k AS (SELECT * FROM u WHERE t IS NOT NULL),
    s AS (SELECT count(*) AS n, avg(abs(t - y)) AS a, stddev_samp(t - y) AS b, avg(abs(0.5 - y)) AS c, avg(abs(m - y)) AS d, stddev_samp(m - y) AS e FROM k)
    SELECT n, round(a, 6) AS mae, round(b, 6) AS sigma, round(c, 6) AS mae_no_prior, round(d, 6) AS mae_state_lean, round(e, 6) AS sigma_state_lean, b <= 0.5 AND a < d AS usable FROM s""",
)
def transfer_backtest(spark, sf_dir):
    rows = units(spark, sf_dir).select(F.col("share").alias("y"), F.when(F.col("quality") == "ok", F.col("base")).alias("t"), "m")
    return rounded(forecasts.transfer_backtest(rows, "y", "t", "m", 0.5))


@register("realised_against", f"SELECT count(*) FILTER (WHERE lo <= 0.5 AND hi >= 0.5) AS n_inside, count(*) AS n, NOT bool_or(lo <= 0.5 AND hi >= 0.5) AS failed FROM (SELECT year, min(share) AS lo, max(share) AS hi FROM ({UNITS_SQL}) GROUP BY 1)")
def realised_against(spark, sf_dir):
    return evaluation.realised_against(units(spark, sf_dir).groupBy("year").agg(F.min("share").alias("lo"), F.max("share").alias("hi")), 0.5, "lo", "hi")


@register("regional_scenario", f"SELECT nationkey, year, round(least(greatest(share + 0.5 * coalesce(x, 0), 0), 1), 6) AS scenario_share FROM ({UNITS_SQL}) u LEFT JOIN (SELECT region AS r, avg(share - m) * 4 AS x FROM ({UNITS_SQL}) WHERE region <> 2 GROUP BY 1) s ON s.r = u.region")
def regional_scenario(spark, sf_dir):
    swings = units(spark, sf_dir).where("region <> 2").groupBy("region").agg((F.avg(F.col("share") - F.col("m")) * 4).alias("x"))
    return rounded(seats.regional_scenario(units(spark, sf_dir), swings, "region", "share", "x", 0.5).select("nationkey", "year", "scenario_share"))


@register("scheduled_seats", "SELECT c_mktsegment AS party, count(*) FILTER (WHERE c_nationkey % 3 + 1 = 1) AS up, count(*) FILTER (WHERE c_nationkey % 3 + 1 <> 1) AS held_over, (SELECT count(*) FROM customer) = 150 AS complete FROM customer GROUP BY 1")
def scheduled_seats(spark, sf_dir):
    roster = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("party"), (F.col("c_nationkey") % 3 + 1).alias("class"))
    return seats.scheduled(roster, "class", 2024, 150)


@register("derived_rates", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey / c_acctbal END AS rate, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS geoid FROM customer")
def derived_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("fips"), F.col("c_nationkey").cast("string").alias("a"), F.col("c_acctbal").alias("b"))
    return forecasts.derived_rates(rows, {"rate": ("a", "b")}, "fips").select("c_custkey", "rate", "geoid")


@register(
    "run_difference",
    """SELECT coalesce(a.k, b.k) AS k, a.v AS run, b.v AS sealed, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS status, a.v - b.v AS difference
    FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_totalprice / 2 AS v FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k""",
)
def run_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return forecasts.run_difference(orders.where("k % 3 <> 0"), orders.where("k % 5 <> 0").withColumn("v", F.col("v") / 2), "k", "v")


@register(
    "benchmark_check",
    "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1), e AS (SELECT c_custkey AS k, CAST(c_acctbal AS DOUBLE) AS x FROM customer WHERE c_custkey % 4 = 0) SELECT e.k, round(x, 2) AS expected, round(v, 2) AS actual, coalesce(abs(v - x) <= 100000, false) AS passed FROM e LEFT JOIN a ON a.k = e.k",
)
def benchmark_check(spark, sf_dir):
    actual = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    expected = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("v"))
    out = reconcile.benchmark_check(actual, expected, ["k"], "v", 100000.0)
    return rounded(out.select("k", *(F.col(c) for c in out.columns if c != "k")), 2)


@register("without_personal", "SELECT c_custkey, c_nationkey FROM customer")
def without_personal(spark, sf_dir):
    return checks.persistable(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"), 1, ["c_name"])


@register(
    "crosswalk_gate",
    """WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a' END AS id, ['token_set', 'ambiguous_last_first', 'state_token_set', 'guess'][c_nationkey % 4 + 1] AS method FROM customer)
    SELECT 'method_known' AS check_name, count(*) FILTER (WHERE method = 'guess') = 0 AS passed, count(*) FILTER (WHERE method = 'guess') AS n_bad FROM m UNION ALL SELECT 'ambiguous_unmatched', count(*) FILTER (WHERE id IS NOT NULL AND method = 'ambiguous_last_first') = 0, count(*) FILTER (WHERE id IS NOT NULL AND method = 'ambiguous_last_first') FROM m
    UNION ALL SELECT 'not_empty', count(*) > 0, CAST(count(*) = 0 AS BIGINT) FROM m UNION ALL SELECT 'unique_key', true, 0 FROM (SELECT 1)""",
)
def crosswalk_gate(spark, sf_dir):
    methods = F.array(*map(F.lit, ("token_set", "ambiguous_last_first", "state_token_set", "guess")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "a").alias("candidate_id"), F.element_at(methods, (F.col("c_nationkey") % 4 + 1).cast("int")).alias("match_method"))
    return checks.report(rows, gates.crosswalk(["token_set", "none"]), ["c_custkey"])


@register("closest_to_threshold", "SELECT o_orderkey, o_totalprice - 150000 AS away FROM orders ORDER BY abs(o_totalprice - 150000), o_orderkey LIMIT 12")
def closest_to_threshold(spark, sf_dir):
    """The twelve contests that are closest to the threshold."""
    return panels.closest(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 150000).alias("away")), "away", 12, ["o_orderkey"])


@register("shared_keys", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def shared_keys(spark, sf_dir):
    """Keys that all of several tables have."""
    orders = table(spark, sf_dir, "orders")
    of = lambda status: orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return reconcile.shared_keys([of("F"), table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("k")), of("O")], ["k"])


@register("precinct_counts", "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS first_votes, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS second_votes, count(DISTINCT l_orderkey % 50) AS n_precincts FROM lineitem GROUP BY 1")
def precinct_counts(spark, sf_dir):
    """District tallies of two parties with how many precincts have votes there."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", (F.col("l_orderkey") % 50).alias("precinct"))
    return collapse.district_tally(rows, ["l_suppkey"], "precinct", "l_returnflag", "l_quantity", "A", "R")
