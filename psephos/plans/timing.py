"""Queries of as-of joins, intervals, lags, latest rows and episodes, over events, orders and the nation by year panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, windows
from ..sources import staging
from .catalog import register, table
from .contests import ROLLUP_SQL, races


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.where(F.col("event_type") == kind) if kind else e


ASOF_SQL = """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.value AS view_value, v.ts AS matched_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts {} v.ts"""


def _asof(spark, sf_dir, strict):
    purchases = events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    views = events(spark, sf_dir, "view").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return joins.asof(purchases, views, ["user_id"], "ts", ["view_id", "view_value"], strict, "view_id")


@register("asof_backward", ASOF_SQL.format(">="))
def asof_backward(spark, sf_dir):
    return _asof(spark, sf_dir, False)


@register("asof_strict", ASOF_SQL.format(">"))
def asof_strict(spark, sf_dir):
    return _asof(spark, sf_dir, True)


PLANS_SQL = "SELECT s_suppkey AS plan, s_nationkey AS nationkey, CAST(1994 + s_suppkey % 7 AS INTEGER) AS first_year, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(1994 + s_suppkey % 7 + s_suppkey % 3 AS INTEGER) END AS last_year FROM supplier"


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals derived from suppliers."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("plan"),
        F.col("s_nationkey").alias("nationkey"),
        (1994 + F.col("s_suppkey") % 7).cast("int").alias("first_year"),
        F.when(F.col("s_suppkey") % 5 != 0, 1994 + F.col("s_suppkey") % 7 + F.col("s_suppkey") % 3).cast("int").alias("last_year"),
    )


@register("interval_lookup", f"SELECT n_nationkey AS nationkey, y.year, p.plan, p.first_year, p.last_year FROM nation CROSS JOIN (SELECT CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS year) y JOIN ({PLANS_SQL}) p ON p.nationkey = n_nationkey AND y.year BETWEEN p.first_year AND coalesce(p.last_year, 9999)")
def interval_lookup(spark, sf_dir):
    points = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    return joins.within_interval(points, plans(spark, sf_dir), ["nationkey"], "year", "first_year", "last_year")


@register(
    "interval_overlap",
    f"WITH p AS ({PLANS_SQL}) SELECT b.nationkey, b.plan, b.first_year FROM p b WHERE EXISTS (SELECT 1 FROM p a WHERE a.nationkey = b.nationkey AND (a.first_year, coalesce(a.last_year, 9999), a.plan) < (b.first_year, coalesce(b.last_year, 9999), b.plan) AND coalesce(a.last_year, 9999) >= b.first_year)",
)
def interval_overlap(spark, sf_dir):
    return joins.overlapping(plans(spark, sf_dir), ["nationkey"], "plan", "first_year", "last_year")


PANEL_SQL = f"""SELECT c_nationkey AS nationkey, CAST(year(held_on) AS INTEGER) AS year, sum(first_votes) AS first_votes, sum(second_votes) AS second_votes,
    sum(first_votes) / nullif(sum(first_votes) + sum(second_votes), 0) AS share FROM ({ROLLUP_SQL}) r JOIN orders ON o_orderkey = race JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-party share by nation and year, stored: it is a few rows, and those who use it look at them many times."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))
    votes = races(spark, sf_dir).join(customers, "custkey").groupBy("nationkey", F.year("held_on").alias("year"))
    sums = votes.agg(F.sum("first_votes").alias("first_votes"), F.sum("second_votes").alias("second_votes"))
    share = F.col("first_votes") / F.nullif(F.col("first_votes") + F.col("second_votes"), F.lit(0))
    return staging.stored(sums.withColumn("share", share), "panel")


@register("lag_consecutive", f"WITH p AS ({PANEL_SQL}) SELECT b.nationkey, b.year, round(b.share, 9) AS share, round(a.share, 9) AS lag_share FROM (SELECT * FROM p WHERE (nationkey + year) % 4 <> 0) b LEFT JOIN (SELECT * FROM p WHERE (nationkey + year) % 4 <> 0) a ON a.nationkey = b.nationkey AND a.year = b.year - 1")
def lag_consecutive(spark, sf_dir):
    rows = panel(spark, sf_dir).where("(nationkey + year) % 4 <> 0")
    out = windows.guarded_lag(rows, ["nationkey"], "year", ["share"])
    return out.select("nationkey", "year", F.round("share", 9).alias("share"), F.round("lag_share", 9).alias("lag_share"))


@register("incumbency_self_join", f"WITH p AS ({PANEL_SQL}) SELECT b.nationkey, b.year, round(b.share, 9) AS share, round(a.share, 9) AS prior_share FROM p b LEFT JOIN p a ON a.nationkey = b.nationkey AND a.year + 2 = b.year")
def incumbency_self_join(spark, sf_dir):
    out = joins.shifted_self(panel(spark, sf_dir), ["nationkey"], "year", 2, ["share"])
    return out.select("nationkey", "year", F.round("share", 9).alias("share"), F.round("prior_share", 9).alias("prior_share"))


@register("latest_per_key", "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    return windows.latest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")])


@register(
    "decisive_winner",
    """SELECT o_custkey AS seat, CAST(year(o_orderdate) - year(o_orderdate) % 2 AS INTEGER) AS period, o_orderkey AS winner, o_totalprice AS votes FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) - year(o_orderdate) % 2 ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END DESC, o_totalprice DESC NULLS LAST, o_orderkey) = 1""",
)
def decisive_winner(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("seat"), windows.even_period(F.year("o_orderdate")).cast("int").alias("period"), F.col("o_orderkey").alias("winner"), F.col("o_totalprice").alias("votes"), "o_orderstatus")
    rank = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return windows.decisive_winner(rows, ["seat", "period"], rank, "votes", "winner").drop("o_orderstatus")


@register(
    "holder_fallback",
    """WITH w AS (SELECT o_custkey AS seat, CAST(year(o_orderdate) AS INTEGER) AS y, max(o_orderkey) AS winner FROM orders GROUP BY 1, 2)
    SELECT seat, winner AS holder, y AS since, CASE WHEN y = 1998 THEN 'exact_term' ELSE 'earlier_period' END AS source FROM w WHERE y < 2000
    QUALIFY row_number() OVER (PARTITION BY seat ORDER BY (y = 1998) DESC, y DESC, winner) = 1""",
)
def holder_fallback(spark, sf_dir):
    won = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("seat"), F.year("o_orderdate").alias("y")).agg(F.max("o_orderkey").alias("winner"))
    return windows.holders(won, ["seat"], "y", "winner", 2000, 2)


@register(
    "episodes",
    """WITH e AS (SELECT user_id, ts, event_id, event_type = 'view' AS eligible, CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM events)
    SELECT user_id, event_id, episode, min(CASE WHEN eligible THEN ts END) OVER (PARTITION BY user_id, episode) AS episode_start FROM e""",
)
def episodes(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("event_type") == "view").alias("eligible"))
    return windows.episodes(rows, ["user_id"], ["ts", "event_id"], "eligible").select("user_id", "event_id", "episode", "episode_start")


@register("group_demean", "SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS centred FROM part")
def group_demean(spark, sf_dir):
    out = windows.demeaned(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "centred")
    return out.select("p_partkey", F.round("centred", 6).alias("centred"))


MONTHS_SQL = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS value FROM orders GROUP BY 1"


@register("year_over_year", f"WITH m AS ({MONTHS_SQL}) SELECT b.month, round(b.value, 2) AS value, round(ln(b.value / a.value), 9) AS growth FROM m b LEFT JOIN m a ON b.month = a.month + INTERVAL 12 MONTH")
def year_over_year(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("value"))
    return windows.growth(months, [], "month", "value").select("month", F.round("value", 2).alias("value"), F.round("growth", 9).alias("growth"))


@register(
    "line_carry",
    """WITH l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, last_value(CASE WHEN length(line) <= 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS header FROM l""",
)
def line_carry(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = windows.carried_header(lines, ["doc_id"], "pos", F.when(F.length("line") <= 60, F.col("line")), "header")
    return out.select("doc_id", "pos", "header")


@register("closest_row", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25), l_linenumber, l_quantity) = 1")
def closest_row(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return windows.closest(rows, ["l_orderkey"], F.col("l_quantity") - 25, ["l_linenumber", "l_quantity"])


@register("validated_join", "SELECT o_orderkey, o_custkey, c_nationkey FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_nationkey FROM customer) USING (o_custkey)")
def validated_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return joins.validated(orders, customers, ["o_custkey"])


@register("evidence_attach", "SELECT n_nationkey, n_name, CASE WHEN n = 1 THEN s END AS s_suppkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'attached' END AS status FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS s FROM supplier WHERE s_acctbal > 6000 GROUP BY 1) ON s_nationkey = n_nationkey")
def evidence_attach(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    found = table(spark, sf_dir, "supplier").where("s_acctbal > 6000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return joins.attach_evidence(nations, found, ["n_nationkey"], "s_suppkey")


@register("point_in_polygon", """SELECT c_custkey, CASE WHEN x >= 0 AND x < 10 AND y >= 0 AND y < 10 THEN 'near' WHEN x >= 10 AND x < 20 AND y >= 0 AND y < 10 THEN 'far' END AS area,
    CASE WHEN y < 10 AND x < 20 THEN 'placed' ELSE 'unplaced' END AS status FROM (SELECT c_custkey, (c_custkey % 23) + 0.5 AS x, (c_custkey % 13) + 0.25 AS y FROM customer)""")
def point_in_polygon(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 23 + 0.5).cast("double").alias("x"), (F.col("c_custkey") % 13 + 0.25).cast("double").alias("y"))
    box = lambda x: [(float(x), 0.0), (float(x + 10), 0.0), (float(x + 10), 10.0), (float(x), 10.0)]
    areas = spark.createDataFrame([("near", box(0)), ("far", box(10))], "area string, ring array<struct<x:double,y:double>>")
    return joins.points_in_polygons(points, areas, "c_custkey", "area").select("c_custkey", "area", "status")
