"""Queries of terms of office and races. Market segments of nations play seats, orders contests, urgent orders departures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terms
from .catalog import register, table

_START, _END, _YEARS = "1996-01-01", "2003-01-01", 4
#: Orders with the nation and seat of their customer. Regular contests: the largest order of a seat in a year of its class,
#: but for some that are missing; others: orders of status P. Departures: urgent orders of every seventh key.
_ORDERS_SQL = """o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS y, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS urgency,
        c_nationkey AS nation, c_nationkey || ':' || c_mktsegment AS seat, 'c' || (c_custkey % 40) AS who, CASE WHEN c_custkey % 3 = 0 THEN 'D' WHEN c_custkey % 3 = 1 THEN 'R' ELSE 'OTHER' END AS party FROM orders JOIN customer ON o_custkey = c_custkey)"""
_CONTESTS_SQL = f"""{_ORDERS_SQL},
    rw AS (SELECT * FROM o WHERE (y + nation) % 4 = 0 AND (y * nation) % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY seat, y ORDER BY price DESC, k) = 1),
    sw AS (SELECT * FROM o WHERE status = 'P' AND k % 3 = 0),
    lv AS (SELECT DISTINCT seat, day FROM o WHERE urgency = '1-URGENT' AND k % 7 = 0),
    rt AS (SELECT seat, who, party, 'regular' AS source, make_date(y - y % 2 + 1, 1, 3) AS f, make_date(y - y % 2 + 1 + {_YEARS}, 1, 3) AS u FROM rw),
    st AS (SELECT seat, who, party, CASE WHEN k % 2 = 0 THEN 'special' ELSE 'appointed' END AS source, CAST(day + INTERVAL (CASE WHEN k % 2 = 0 THEN 30 ELSE 0 END) DAY AS DATE) AS f FROM sw),
    su AS (SELECT seat, who, party, source, f, (SELECT arg_max(rt.u, rt.f) FROM rt WHERE rt.seat = st.seat AND rt.f <= st.f) AS x FROM st),
    t AS (SELECT * FROM rt UNION ALL SELECT seat, who, party, source, f, CASE WHEN x > f THEN x END FROM su)"""
_TERMS_SQL = f"""{_CONTESTS_SQL},
    one AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY seat, f ORDER BY list_position(['regular', 'special', 'appointed'], source), who, party) = 1),
    cut AS (SELECT *, (SELECT min(n.f) FROM one n WHERE n.seat = one.seat AND n.f > one.f) AS nx, (SELECT min(lv.day) FROM lv WHERE lv.seat = one.seat AND lv.day > one.f) AS lf FROM one),
    h AS (SELECT seat, who, party, source, greatest(f, DATE '{_START}') AS f, least(u, nx, lf, DATE '{_END}') AS u, coalesce(lf <= least(u, nx, DATE '{_END}'), false) AS gone FROM cut),
    hh AS (SELECT * FROM h WHERE f < u),
    n AS (SELECT *, CASE WHEN lag(u) OVER w = f AND lag(who) OVER w = who THEN 0 ELSE 1 END AS fresh FROM hh WINDOW w AS (PARTITION BY seat ORDER BY f)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY seat ORDER BY f ROWS UNBOUNDED PRECEDING) AS run FROM n),
    sp AS (SELECT seat, run, min(f) AS f, max(u) AS u, count(*) AS n, arg_min(who, f) AS who, arg_min(party, f) AS party, arg_min(source, f) AS source, arg_max(gone, f) AS gone FROM r GROUP BY seat, run),
    gp AS (SELECT seat, u AS f, coalesce(lead(f) OVER (PARTITION BY seat ORDER BY f), DATE '{_END}') AS u, CASE WHEN gone THEN 'vacant' ELSE 'unknown' END AS status FROM sp),
    every AS (SELECT DISTINCT seat FROM o),
    bg AS (SELECT every.seat, DATE '{_START}' AS f, coalesce((SELECT min(sp.f) FROM sp WHERE sp.seat = every.seat), DATE '{_END}') AS u FROM every),
    terms AS (SELECT seat, who AS holder, party, source, f AS valid_from, u AS valid_until, 'held' AS status, n AS n_terms FROM sp
        UNION ALL SELECT seat, NULL, NULL, NULL, f, u, status, 0 FROM gp WHERE f < u UNION ALL SELECT seat, NULL, NULL, NULL, f, u, 'unknown', 0 FROM bg WHERE f < u)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    party = F.when(F.col("c_custkey") % 3 == 0, "D").when(F.col("c_custkey") % 3 == 1, "R").otherwise("OTHER")
    return o.select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("urgency"), F.col("c_nationkey").alias("nation"), F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("seat"), F.concat(F.lit("c"), (F.col("c_custkey") % 40).cast("string")).alias("who"), party.alias("party"),
    )


def _regular(o: DataFrame) -> DataFrame:
    from ..operators.windows import latest

    return latest(o.where("(y + nation) % 4 = 0 and (y * nation) % 7 <> 3"), ["seat", "y"], [F.desc("price"), F.asc("k")])


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    even = F.col("k") % 2 == 0
    regular = _regular(o).select("seat", F.col("day").alias("held_on"), F.lit("regular").alias("source"), F.col("who").alias("holder"), "party", F.lit(None).cast("date").alias("takes_office"))
    others = o.where("status = 'P' and k % 3 = 0").select("seat", F.col("day").alias("held_on"), F.when(even, "special").otherwise("appointed").alias("source"), F.col("who").alias("holder"), "party", F.when(even, F.date_add("day", 30)).alias("takes_office"))
    left = o.where("urgency = '1-URGENT' and k % 7 = 0").select("seat", F.col("day").alias("left_on"))
    return terms.effective(terms.contest_terms(regular.unionByName(others), _YEARS), left, _START, _END, o.select("seat").distinct())


@register("office_terms", f"WITH {_TERMS_SQL} SELECT * FROM terms")
def office_terms(spark, sf_dir):
    """Who holds each seat from when to when, with vacant and unknown days; every seat is covered once per day."""
    return _terms(spark, sf_dir)


@register(
    "race_universe",
    f"""WITH {_TERMS_SQL}, e AS (SELECT CAST(make_date(2000, 11, 1) + CAST((8 - dayofweek(make_date(2000, 11, 1))) % 7 AS INTEGER) + 1 AS DATE) AS day),
    s AS (SELECT DISTINCT seat, nation, split_part(seat, ':', 2) AS state FROM o),
    res AS (SELECT seat, y AS cycle, who AS winner, party, least(1, price / 500000) AS share FROM rw WHERE y < 2000),
    ex AS (SELECT DISTINCT seat FROM res WHERE cycle = 2000 - {_YEARS}), out_of_turn AS (SELECT DISTINCT seat FROM sw WHERE y = 2000),
    up AS (SELECT s.*, ex.seat IS NOT NULL AS exact FROM s LEFT JOIN ex USING (seat) LEFT JOIN out_of_turn USING (seat) WHERE ex.seat IS NOT NULL OR out_of_turn.seat IS NOT NULL),
    now AS (SELECT * FROM terms, e WHERE valid_from <= day AND day < valid_until),
    bf AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY seat ORDER BY cycle DESC, winner) = 1)
    SELECT '2000_us_senate_' || lower(up.state) AS race_key, CAST(2000 AS INTEGER) AS cycle, e.day AS election_date, 'us_senate' AS office, CASE WHEN exact THEN 'regular' ELSE 'special' END AS election_type, up.state, up.nation AS district, up.seat, bf.cycle AS last_contested_cycle,
        CASE WHEN now.status = 'held' THEN now.holder ELSE bf.winner END AS incumbent_name, CASE WHEN now.status = 'held' THEN now.party ELSE bf.party END AS incumbent_party, 'unknown' AS incumbent_status,
        CASE WHEN now.status = 'held' THEN now.source || '_term' WHEN bf.winner IS NOT NULL THEN 'earlier_regular_winner_' || now.status ELSE 'none' END AS incumbent_source, round(bf.share, 9) AS prior_dem_share,
        CASE WHEN bf.cycle IS NOT NULL THEN 'last_result_' || bf.cycle ELSE 'none' END AS prior_source, 'n/a' AS boundary_confidence, 'none' AS litigation_risk, CAST(1992 AS INTEGER) AS plan_era
    FROM up CROSS JOIN e LEFT JOIN now ON now.seat = up.seat LEFT JOIN bf ON bf.seat = up.seat""",
)
def race_universe(spark, sf_dir):
    """The seats on the ballot of 2000, regular and out of turn, with their holders on election day and last results."""
    o = _orders(spark, sf_dir)
    seats = o.select("seat", F.lit("us_senate").alias("office"), F.substring_index("seat", ":", -1).alias("state"), F.col("nation").alias("district")).distinct()
    results = _regular(o).select("seat", F.lit("us_senate").alias("office"), F.col("y").alias("cycle"), F.lit(False).alias("special"), F.col("who").alias("winner"), F.col("party").alias("winner_party"), F.least(F.lit(1.0), F.col("price") / 500000).alias("share"))
    out = terms.race_universe(seats, _terms(spark, sf_dir), results, 2000, {"us_senate": _YEARS}, o.where("status = 'P' and k % 3 = 0 and y = 2000").select("seat"))
    return out.withColumn("prior_dem_share", F.round("prior_dem_share", 9))


@register(
    "cycle_table",
    """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) - year(o_orderdate) % 2 AS INTEGER) AS cycle FROM orders), r AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS cycle, o_custkey % 50 AS state FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey % 3 = year(o_orderdate) % 3),
    u AS (SELECT y.cycle, (SELECT count(*) FROM r WHERE r.cycle = y.cycle - 6) AS n, CAST(make_date(y.cycle, 11, 1) + CAST((8 - dayofweek(make_date(y.cycle, 11, 1))) % 7 AS INTEGER) + 1 AS DATE) AS election_date FROM y)
    SELECT cycle, election_date, 'us_house' AS office, 'nation' AS jurisdiction, 'regular' AS election_type, CAST(435 AS BIGINT) AS seats, 'covered' AS coverage FROM u
    UNION ALL SELECT cycle, election_date, 'us_senate', 'nation', 'regular', n, CASE WHEN n > 0 THEN 'covered' ELSE 'no_prior_class_data' END FROM u
    UNION ALL SELECT cycle, election_date, 'president', 'nation', CASE WHEN cycle % 4 = 0 THEN 'regular' ELSE 'not_held' END, CASE WHEN cycle % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN cycle % 4 = 0 THEN 'covered' ELSE 'not_held' END FROM u
    UNION ALL SELECT cycle, election_date, 'governor', 'states', 'regular', NULL, 'out_of_coverage' FROM u""",
)
def cycle_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_custkey", "o_orderpriority")
    returns = o.where("o_custkey % 3 = y % 3").select(F.lit("us_senate").alias("office"), F.col("y").alias("cycle"), (F.col("o_custkey") % 50).alias("state"), (F.col("o_orderpriority") == "1-URGENT").alias("special"))
    return terms.cycle_table(returns, o.select((F.col("y") - F.col("y") % 2).alias("cycle")), 435)
