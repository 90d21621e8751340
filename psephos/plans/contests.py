"""Queries of ballot lines and races. Orders play races, line numbers candidates, return flags parties (A and R the two
large ones), line status vote modes (O the published total), quantities votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collapse, reconcile
from .catalog import register, table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("race"),
        F.col("l_linenumber").alias("candidate"),
        F.col("l_returnflag").alias("party"),
        F.col("l_linestatus").alias("mode"),
        F.col("l_quantity").alias("votes"),
    )


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballot lines after mode and party-line collapse."""
    modes = collapse.collapse_modes(lines(spark, sf_dir), ["race", "candidate", "party"], "mode", "votes", "o")
    return collapse.collapse_party_lines(modes.drop("n_rows"), "race", "candidate", "party", "votes", ["A", "R"])


MODES_SQL = """
SELECT race, candidate, party, CASE WHEN count(*) FILTER (WHERE mode = 'O') > 0 THEN sum(votes) FILTER (WHERE mode = 'O') ELSE sum(votes) END AS votes, count(*) AS n_rows
FROM (SELECT l_orderkey AS race, l_linenumber AS candidate, l_returnflag AS party, l_linestatus AS mode, l_quantity AS votes FROM lineitem)
GROUP BY race, candidate, party
"""
FUSION_SQL = f"""
SELECT race, candidate, max({{'m': CASE WHEN party IN ('A', 'R') THEN 1 ELSE 0 END, 'v': votes, 'p': party}}).p AS party, sum(votes) AS votes, count(*) > 1 AS fusion_flag
FROM ({MODES_SQL}) GROUP BY race, candidate
"""


@register("mode_collapse", MODES_SQL)
def mode_collapse(spark, sf_dir):
    return collapse.collapse_modes(lines(spark, sf_dir), ["race", "candidate", "party"], "mode", "votes", "o")


@register("fusion_collapse", FUSION_SQL)
def fusion_collapse(spark, sf_dir):
    return collapsed(spark, sf_dir)


@register("vote_share", f"SELECT race, candidate, votes, round(votes / sum(votes) OVER (PARTITION BY race), 9) AS vote_share FROM ({FUSION_SQL})")
def vote_share(spark, sf_dir):
    out = collapse.share_of_race(collapsed(spark, sf_dir), "race", "votes")
    return out.select("race", "candidate", "votes", F.round("vote_share", 9).alias("vote_share"))


@register("uncontested", "SELECT l_orderkey AS race, count(DISTINCT l_linenumber) AS n_contenders, count(DISTINCT l_linenumber) < 2 AS uncontested_flag FROM lineitem GROUP BY l_orderkey")
def uncontested(spark, sf_dir):
    return collapse.uncontested(lines(spark, sf_dir), "race", "candidate", "votes")


ROLLUP_SQL = f"""
WITH f AS ({FUSION_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY votes DESC, candidate) AS k FROM f),
g AS (SELECT race, count(*) FILTER (WHERE votes > 0) AS n_candidates, sum(votes) AS total_votes,
    max(candidate) FILTER (WHERE k = 1) AS winner, max(party) FILTER (WHERE k = 1) AS winner_party, max(votes) FILTER (WHERE k = 1) AS winner_votes,
    max(candidate) FILTER (WHERE k = 2) AS runner_up, max(party) FILTER (WHERE k = 2) AS runner_up_party, coalesce(max(votes) FILTER (WHERE k = 2), 0) AS runner_up_votes,
    coalesce(sum(votes) FILTER (WHERE party = 'A'), 0) AS first_votes, coalesce(sum(votes) FILTER (WHERE party = 'R'), 0) AS second_votes FROM r GROUP BY race)
SELECT g.race, o_orderdate AS held_on, n_candidates, total_votes, winner, winner_party, winner_votes, runner_up, runner_up_party, runner_up_votes, winner_votes - runner_up_votes AS margin_votes,
    round((winner_votes - runner_up_votes) / total_votes, 9) AS margin_share, first_votes, second_votes, total_votes - first_votes - second_votes AS other_votes,
    round(first_votes / nullif(first_votes + second_votes, 0), 9) AS two_party_share
FROM g JOIN orders ON o_orderkey = g.race
"""


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of all races, with their order's date and customer."""
    rolled = collapse.roll_up_races(collapsed(spark, sf_dir), "race", "candidate", "party", "votes", "A", "R")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("race"), F.col("o_orderdate").alias("held_on"), F.col("o_custkey").alias("custkey"))
    return rolled.join(orders, "race")


@register("race_rollup", ROLLUP_SQL)
def race_rollup(spark, sf_dir):
    out = races(spark, sf_dir).drop("custkey")
    return out.withColumns({"margin_share": F.round("margin_share", 9), "two_party_share": F.round("two_party_share", 9)})


@register(
    "contest_buckets",
    """SELECT l_orderkey AS race, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS first_votes, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS second_votes,
    coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS other_votes, min({'v': -l_quantity, 'p': l_returnflag}).p AS winner_party FROM lineitem GROUP BY l_orderkey""",
)
def contest_buckets(spark, sf_dir):
    return collapse.contest_buckets(lines(spark, sf_dir), ["race"], "party", "votes", "A", "R")


@register("party_pivot", "SELECT l_shipdate AS shipdate, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS \"A\", coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS \"R\" FROM lineitem GROUP BY l_shipdate")
def party_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("shipdate"), "l_returnflag", "l_quantity")
    return collapse.pivot_parties(rows, ["shipdate"], "l_returnflag", "l_quantity", ["A", "R"])


RECONCILE_SQL = """
WITH a AS (SELECT l_orderkey AS race, sum(l_extendedprice) AS s, sum(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice ELSE 0 END) AS v FROM lineitem GROUP BY l_orderkey),
c AS (SELECT race, s, v, o_totalprice AS t FROM a JOIN orders ON o_orderkey = race WHERE o_totalprice > 0),
f AS (SELECT race, t, CASE WHEN abs(v - t) < abs(s - t) THEN v - t ELSE s - t END AS d FROM c WHERE least(abs(s - t), abs(v - t)) > greatest(10, 0.001 * t))
SELECT race, round(d, 4) AS difference, round(abs(d) / t * 100, 3) AS pct_of_total,
    CASE WHEN abs(d) <= 10 THEN 'rounding' WHEN round(abs(d) / t * 100, 3) >= 40 THEN 'multiple_rounds' WHEN d > 0 THEN 'above_total' ELSE 'below_total' END AS reason FROM f
"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race"), F.col("l_extendedprice").alias("votes"), (F.col("l_returnflag") != "N").alias("is_vote"))
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("race"), F.col("o_totalprice").alias("total"))
    return reconcile.unreconciled(rows, totals, "race", "votes", "is_vote", "total")


@register("reconcile_quarantine", RECONCILE_SQL)
def reconcile_quarantine(spark, sf_dir):
    return failures(spark, sf_dir).select("race", F.round("difference", 4).alias("difference"), F.round("pct_of_total", 3).alias("pct_of_total"), "reason")


@register("quarantine_reasons", f"SELECT reason, count(*) AS n FROM ({RECONCILE_SQL}) GROUP BY reason")
def quarantine_reasons(spark, sf_dir):
    return failures(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@register("quarantine_split", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT race FROM ({RECONCILE_SQL}))")
def quarantine_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return reconcile.split(orders, failures(spark, sf_dir).select(F.col("race").alias("o_orderkey")), ["o_orderkey"])[0]


DUPLICATES_SQL = "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1"


@register("duplicate_source_refusal", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN ({DUPLICATES_SQL})")
def duplicate_source_refusal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return reconcile.refuse_repeated(rows, ["l_orderkey", "l_linenumber"])


@register("override_union", "SELECT o_orderkey, 0.0 AS price, 'override' AS origin FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_totalprice, 'base' FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'")
def override_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("base").alias("origin"))
    better = orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit(0.0).alias("price"), F.lit("override").alias("origin"))
    return reconcile.override(base, better, ["o_orderkey"])


@register(
    "except_both",
    """SELECT custkey, side FROM (SELECT c_custkey AS custkey, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20))""",
)
def except_both(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    missing = reconcile.set_differences(customers.select(F.col("c_custkey").alias("custkey")), orders, ["custkey"]).where("side = 'missing'")
    extra = reconcile.set_differences(customers.where("c_nationkey < 20").select(F.col("c_custkey").alias("custkey")), orders, ["custkey"]).where("side = 'extra'")
    return missing.unionByName(extra)


@register(
    "full_outer_status",
    """SELECT coalesce(s.k, c.k) AS nationkey, s.n AS n_suppliers, c.n AS n_customers, CASE WHEN s.k IS NULL THEN 'right_only' WHEN c.k IS NULL THEN 'left_only' ELSE 'both' END AS status
    FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1) c ON s.k = c.k""",
)
def full_outer_status(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    c = table(spark, sf_dir, "customer").where("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    return reconcile.outer_status(s, c, ["nationkey"])
