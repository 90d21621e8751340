"""Queries of names, rosters, precinct reads, filings, winners, certified results, gates of specifications and definitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import forecasts, ledger, matching
from ..sources import delimited, documents, staging
from .catalog import register, table
from .outlook import UNITS_SQL, rounded, units

#: Names of parts said in four ways: as they are, with a comma, with a nickname and a title, and with marks.
_SAID_SQL = """SELECT p_partkey, string_split(upper(p_name), ' ') AS w, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN array_to_string(string_split(p_name, ' ')[2:], ' ') || ', ' || string_split(p_name, ' ')[1] || ' Jr.'
    WHEN 2 THEN 'Dr. ' || string_split(p_name, ' ')[1] || ' "Buddy" ' || array_to_string(string_split(p_name, ' ')[2:], ' ') ELSE replace(replace(p_name, 'e', 'é'), 'o', 'ö') END AS said FROM part"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    rest = F.array_join(F.slice(words, 2, 10), " ")
    marked = F.replace(F.replace(F.col("p_name"), F.lit("e"), F.lit("é")), F.lit("o"), F.lit("ö"))
    kind = F.col("p_partkey") % 4
    said = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat(rest, F.lit(", "), words[0], F.lit(" Jr."))).when(kind == 2, F.concat(F.lit("Dr. "), words[0], F.lit(' "Buddy" '), rest)).otherwise(marked)
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said"))


@register("name_parts", f"SELECT p_partkey, w[-1] AS surname, w[1] AS first_name, CASE WHEN len(w) = 1 OR p_partkey % 4 = 1 AND len(w) = 2 THEN w[-1] ELSE w[-1] || ',' || w[-2] || w[-1] END AS variants, array_to_string(list_sort(list_distinct(w)), '|') AS token_key FROM ({_SAID_SQL})")
def name_parts(spark, sf_dir):
    """Surname, first name, surname variants and the key of all words, whatever way a name is said."""
    said = F.col("said")
    return _said(spark, sf_dir).select("p_partkey", text.surname(said).alias("surname"), text.first_name(said).alias("first_name"), F.array_join(text.surname_variants(said), ",").alias("variants"), text.token_key(said).alias("token_key"))


@register("folded_letters", "SELECT p_partkey, p_name AS folded FROM part")
def folded_letters(spark, sf_dir):
    """Names whose letters carry marks of many kinds, as they were without."""
    marks = {"a": "ắ", "e": "ệ", "i": "ǐ", "o": "ộ", "u": "ǖ", "n": "ǹ", "d": "ḓ", "t": "ṱ", "g": "ｇ", "l": "ḽ", "r": "ṝ"}
    said = F.translate("p_name", "".join(marks), "".join(marks.values()))
    return table(spark, sf_dir, "part").select("p_partkey", text.folded(said).alias("folded"))


@register("major_party", "SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 'DEMOCRAT' WHEN 1 THEN 'REPUBLICAN' WHEN 5 THEN 'REPUBLICAN' END AS major FROM customer")
def major_party(spark, sf_dir):
    """The major party that a label of a customer's segment contains, by the nation; none where it has both, none, or is another party."""
    kind, segment = F.col("c_nationkey") % 6, F.col("c_mktsegment")
    label = F.when(kind == 0, F.concat(segment, F.lit(" Democratic Party"))).when(kind == 1, F.concat(F.lit("republican/"), segment)).when(kind == 2, F.concat(F.lit("Democrat and Republican "), segment))
    label = label.when(kind == 3, F.lit("National  Democrat")).when(kind == 4, segment).otherwise(F.concat(F.lit(" Independent Republican "), segment))
    return table(spark, sf_dir, "customer").select("c_custkey", text.major_party(label).alias("major"))


@register("district_ordinals", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 53 + 1 WHEN c_custkey % 3 = 1 THEN c_custkey % 59 ELSE 0 END AS INTEGER) AS district FROM customer")
def district_ordinals(spark, sf_dir):
    """Districts said in ordinal words up to the 53rd, in digits, or at large."""
    words = F.array(*map(F.lit, text.ORDINALS))
    k = F.col("c_custkey")
    word = F.concat(F.initcap(F.lower(F.element_at(words, (k % 53 + 1).cast("int")))), F.lit(" District"))
    said = F.when(k % 3 == 0, F.when(k % 2 == 0, F.replace(word, F.lit("-"), F.lit(" "))).otherwise(word)).when(k % 3 == 1, F.concat(F.lit("District "), (k % 59).cast("string"))).otherwise("At-Large")
    return table(spark, sf_dir, "customer").select("c_custkey", text.district_number(said).alias("district"))


@register("xml_roster", "SELECT 'A' || chr(CAST(65 + c_nationkey AS INTEGER)) AS state_po, CAST(c_custkey % 100 AS INTEGER) AS district_num, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS holder, CASE c_custkey % 4 WHEN 0 THEN 'DEMOCRAT' WHEN 1 THEN 'REPUBLICAN' WHEN 2 THEN 'INDEPENDENT' ELSE 'OTHER' END AS party FROM customer WHERE c_nationkey < 20")
def xml_roster(spark, sf_dir):
    """Customers as the members of a house, written as XML and read as a roster; five nations have no vote."""
    path = f"{staging.shared_dir(spark)}/roster-{uuid.uuid4().hex}"
    place = F.concat(F.lit("A"), F.chr(F.col("c_nationkey") + 65), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    name = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).otherwise("Vacant")
    party = F.when(F.col("c_custkey") % 4 == 0, "D").when(F.col("c_custkey") % 4 == 1, "R").when(F.col("c_custkey") % 4 == 2, "I").otherwise("X")
    rows = table(spark, sf_dir, "customer").select(place.alias("statedistrict"), F.struct(name.alias("official-name"), party.alias("party")).alias("member-info"))
    rows.write.format("xml").option("rowTag", "member").option("rootTag", "members").save(path)
    return documents.xml_roster(spark, path, [f"A{chr(65 + k)}" for k in range(20)])


@register(
    "precinct_rows",
    """SELECT CASE l_linenumber % 4 WHEN 1 THEN 'president' ELSE 'us_house' END AS office, CAST(l_suppkey % 50 AS VARCHAR) AS state, CAST(l_suppkey AS VARCHAR) AS county, 'P' || l_orderkey AS precinct, CAST(l_partkey % 9 AS VARCHAR) AS district, 'c' || l_partkey AS candidate, l_returnflag AS party,
    l_linestatus AS mode, CAST(l_quantity * 100 AS BIGINT) AS votes FROM lineitem WHERE l_linenumber % 4 IN (1, 2) AND l_returnflag <> 'R'""",
)
def precinct_rows(spark, sf_dir):
    """Order lines as precinct files, read back for two offices at the general stage, which some rows leave unsaid."""
    path = f"{staging.shared_dir(spark)}/precincts-{uuid.uuid4().hex}"
    office = F.element_at(F.array(*map(F.lit, ("US President", "US House", "Sheriff", "Coroner"))), ((F.col("l_linenumber") + 3) % 4 + 1).cast("int"))
    stage = F.when(F.col("l_returnflag") == "R", "PRI").when(F.col("l_returnflag") == "A", "gen")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("STATE_PO"), F.col("l_suppkey").alias("county_fips"), F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("precinct"), office.alias("Office"), (F.col("l_partkey") % 9).alias("district"),
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("candidate"), F.col("l_returnflag").alias("party_simplified"), F.col("l_linestatus").alias("mode"), F.format_number(F.col("l_quantity") * 100, 0).alias("votes"), stage.alias("stage"),
    )
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return delimited.precincts(spark, path, {"US President": "president", "US House": "us_house"}, sep="\t")


_SEATS_SQL = """s AS (SELECT p_partkey AS k, p_brand AS state, p_size % 10 AS seat, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS name, CASE p_partkey % 5 WHEN 0 THEN 'dem' WHEN 1 THEN 'Whig' WHEN 2 THEN '' ELSE 'Republican' END AS label FROM part WHERE p_partkey % 2 = 0),
    r AS (SELECT p_partkey AS id, p_brand AS state, p_size % 10 AS seat, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'LIB' ELSE 'REP' END AS label FROM part WHERE p_partkey % 2 = 1)"""
_TIERS_SQL = """{0} AS (SELECT k, id, CASE WHEN list_sort(string_split(s.name, ' ')) = list_sort(string_split(r.name, ' ')) THEN 1 WHEN split_part(s.name, ' ', -1) = split_part(r.name, ' ', -1) THEN CASE WHEN split_part(s.name, ' ', 1)[1] = split_part(r.name, ' ', 1)[1] THEN 3 ELSE 4 END END AS tier FROM s JOIN r ON {1} WHERE s.name IS NOT NULL),
    {0}m AS (SELECT k, tier, count(*) AS n, min(id) AS id FROM {0} QUALIFY tier = min(tier) OVER (PARTITION BY k) GROUP BY k, tier)"""


@register(
    "filing_status",
    f"""WITH {_SEATS_SQL}, {_TIERS_SQL.format("n", "s.state = r.state AND s.seat = r.seat").replace("QUALIFY tier = min(tier) OVER (PARTITION BY k) ", "WHERE tier IS NOT NULL ")}, {_TIERS_SQL.format("w", "s.state = r.state").replace("QUALIFY tier = min(tier) OVER (PARTITION BY k) ", "WHERE tier IS NOT NULL ")},
    a AS (SELECT * FROM nm QUALIFY tier = min(tier) OVER (PARTITION BY k)), b AS (SELECT * FROM wm WHERE k NOT IN (SELECT k FROM a) QUALIFY tier = min(tier) OVER (PARTITION BY k)),
    f AS (SELECT s.*, CASE WHEN a.n = 1 THEN a.id WHEN b.n = 1 THEN b.id END AS hit FROM s LEFT JOIN a USING (k) LEFT JOIN b USING (k))
    SELECT f.k, CASE WHEN f.name IS NULL THEN 'unknown' WHEN hit IS NOT NULL THEN 'filed' ELSE 'not_found' END AS incumbent_status, hit AS candidate_id,
        CASE WHEN f.label = 'dem' THEN 'DEMOCRAT' WHEN f.label = 'Republican' THEN 'REPUBLICAN' WHEN hit IS NULL THEN 'UNKNOWN' WHEN r.label = 'LIB' THEN 'LIBERTARIAN' ELSE 'REPUBLICAN' END AS resolved_party FROM f LEFT JOIN r ON r.id = f.hit""",
)
def filing_status(spark, sf_dir):
    """Seats of even parts whose incumbents are looked up among odd parts, in the seat's pool and then the state's."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("state"), (F.col("p_size") % 10).alias("seat"), "p_name")
    k = F.col("p_partkey")
    label = F.when(k % 5 == 0, "dem").when(k % 5 == 1, "Whig").when(k % 5 == 2, "").otherwise("Republican")
    seats = p.where(k % 2 == 0).select(k.alias("k"), "state", "seat", F.when(k % 9 != 0, F.col("p_name")).alias("name"), label.alias("label"))
    roster = p.where(k % 2 == 1).select(k.alias("candidate_id"), "state", "seat", F.col("p_name").alias("filed_name"), F.when(k % 3 == 0, "LIB").otherwise("REP").alias("filed_label"))
    out = forecasts.filing_status(seats, roster, "k", "name", "candidate_id", "filed_name", ["state", "seat"], ["state"], "label", "filed_label")
    return out.select("k", "incumbent_status", "candidate_id", "resolved_party")


@register(
    "person_winners",
    """WITH v AS (SELECT l_orderkey AS race, CASE WHEN l_linenumber % 5 = 1 THEN 'Exhausted  Ballot' WHEN l_linenumber % 5 = 2 THEN 'WRITE-IN' ELSE 'p' || l_partkey END AS name, min(CASE WHEN l_partkey % 3 = 0 THEN l_partkey END) AS id, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS runoff, CAST(sum(l_quantity) AS BIGINT) AS votes FROM lineitem GROUP BY 1, 2)
    SELECT race, name, id AS candidate_id, CASE WHEN id IS NULL THEN 'none' ELSE 'token_set' END AS method, votes FROM v WHERE name NOT IN ('Exhausted  Ballot', 'WRITE-IN') QUALIFY row_number() OVER (PARTITION BY race ORDER BY runoff DESC, votes DESC, name) = 1""",
)
def person_winners(spark, sf_dir):
    """Winners of races of order lines, where exhausted ballots and write-ins often have the most votes."""
    kind = F.col("l_linenumber") % 5
    name = F.when(kind == 1, "Exhausted  Ballot").when(kind == 2, "WRITE-IN").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("race"), name.alias("name")).agg(
        F.min(F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey"))).alias("candidate_id"), F.when(F.max(F.col("l_linestatus") == "F"), "Gen Runoff").otherwise("gen").alias("stage"), F.sum("l_quantity").cast("bigint").alias("votes")
    )
    links = lines.select("race", "name", "candidate_id", F.when(F.col("candidate_id").isNull(), "none").otherwise("token_set").alias("method"))
    return matching.person_winners(links, lines.select("race", "name", "stage", "votes"), "race", "name", "candidate_id", "stage", "votes")


@register(
    "actual_results",
    """WITH o AS (SELECT o_custkey AS seat, CAST(o_orderdate AS DATE) AS seen, max(o_orderstatus) AS status, CAST(floor(sum(o_totalprice)) AS BIGINT) AS first, max(o_orderkey) * 20 AS second FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30' GROUP BY 1, 2),
    e AS (SELECT *, sum(CASE WHEN status = 'F' THEN 0 ELSE 1 END) OVER (PARTITION BY seat ORDER BY seen) AS run FROM o),
    d AS (SELECT *, min(CASE WHEN status = 'F' THEN seen END) OVER (PARTITION BY seat, run) AS since FROM e),
    l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY seat ORDER BY seen DESC) = 1)
    SELECT seat, seen, CASE WHEN status = 'F' THEN since END AS certified_on, round(first / CAST(first + second AS DOUBLE), 9) AS actual_share, CASE WHEN seat % 10 = 0 THEN seat % 20 = 0 ELSE first > second END AS actual_win FROM l""",
)
def actual_results(spark, sf_dir):
    """Certified results of seats as of a date: the latest observation, the start of its run of certified ones, and who has won."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("seat"), F.col("o_orderdate").cast("date").alias("seen")).agg(F.max("o_orderstatus").alias("status"), F.floor(F.sum("o_totalprice")).cast("bigint").alias("first"), (F.max("o_orderkey") * 20).alias("second"))
    rows = o.withColumns({"certified": F.col("status") == "F", "other": F.lit(0), "winner": F.when(F.col("seat") % 20 == 0, "first").when(F.col("seat") % 10 == 0, "Third")})
    seen = ledger.certification(rows, ["seat"], "seen", "certified", "1999-06-30")
    out = ledger.actuals(seen, "first", "second", "other", "winner", "FIRST")
    return out.select("seat", "seen", "certified_on", F.round("actual_share", 9).alias("actual_share"), "actual_win")


@register(
    "specification_gate",
    f"""WITH u AS (SELECT share AS y, m, base, region FROM ({UNITS_SQL})), e AS (SELECT 'v0' AS spec, 0 AS k, y, 0.5 AS p, region FROM u UNION ALL SELECT 'v1', 1, y, m, region FROM u UNION ALL SELECT 'v2', 2, y, base, region FROM u UNION ALL SELECT 'v3', 3, y, least(1, base + 0.4), region FROM u),
    s AS (SELECT spec, k, avg(abs(p - y)) AS mae, avg(CASE WHEN region = 1 THEN abs(p - y) END) AS open_mae, avg(CASE WHEN abs(p - y) <= 0.3 THEN 1.0 ELSE 0.0 END) AS coverage FROM e GROUP BY 1, 2),
    f AS (SELECT s.*, s.spec <> 'v0' AND s.mae < b.mae AND s.open_mae < b.open_mae AND s.coverage >= b.coverage - 0.02 AS promoted, CASE WHEN s.spec = 'v0' THEN '' ELSE concat_ws(',', CASE WHEN NOT s.mae < b.mae THEN 'mae' END, CASE WHEN NOT s.open_mae < b.open_mae THEN 'open_mae' END, CASE WHEN NOT s.coverage >= b.coverage - 0.02 THEN 'coverage' END) END AS failed FROM s, s b WHERE b.spec = 'v0')
    SELECT spec, round(mae, 6) AS mae, round(open_mae, 6) AS open_mae, round(coverage, 6) AS coverage, failed, promoted, spec = coalesce((SELECT spec FROM f WHERE promoted ORDER BY k DESC LIMIT 1), 'v0') AS selected FROM f""",
)
def specification_gate(spark, sf_dir):
    """Which of four predictions of the units' shares may replace the first."""
    u = units(spark, sf_dir)
    kinds = F.array(*(F.struct(F.lit(f"v{k}").alias("spec"), F.lit(k).alias("k"), p.alias("p")) for k, p in enumerate((F.lit(0.5), F.col("m"), F.col("base"), F.least(F.lit(1.0), F.col("base") + 0.4)))))
    e = u.select("share", "region", F.explode(kinds).alias("x")).select("share", "region", "x.*").withColumn("e", F.abs(F.col("p") - F.col("share")))
    scores = e.groupBy("spec", "k").agg(F.avg("e").alias("mae"), F.avg(F.when(F.col("region") == 1, F.col("e"))).alias("open_mae"), F.avg((F.col("e") <= 0.3).cast("double")).alias("coverage"))
    out = forecasts.specification_gate(scores, "spec", "v0", ["mae", "open_mae"], "coverage", "k").drop("k")
    return rounded(out.withColumn("failed", F.array_join("failed", ",")))


@register(
    "national_definitions",
    """WITH r AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_totalprice AS a, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey * 100.0 ELSE 0 END AS b, o_totalprice * 3 AS t, o_orderkey % 11 = 0 AS alone FROM orders),
    s AS (SELECT y, sum(a) / sum(a + b) AS p, sum(CASE WHEN NOT alone THEN a END) / sum(CASE WHEN NOT alone THEN a + b END) AS q, sum(CASE WHEN NOT alone THEN a / (a + b) * t END) / sum(CASE WHEN NOT alone THEN t END) AS r FROM r GROUP BY y)
    SELECT y, 'all_races_ratio' AS definition, round(p, 8) AS share FROM s UNION ALL SELECT y, 'contested_ratio', round(q, 8) FROM s UNION ALL SELECT y, 'contested_weighted_mean', round(r, 8) FROM s""",
)
def national_definitions(spark, sf_dir):
    """Three definitions of a year's national share, over orders as races, some without an opponent."""
    alone = F.col("o_orderkey") % 11 == 0
    races = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("a"), F.when(~alone, F.col("o_custkey") * 100.0).otherwise(0.0).alias("b"), (F.col("o_totalprice") * 3).alias("t"), alone.alias("alone"))
    return forecasts.national_definitions(races, ["y"], "a", "b", "t", "alone").withColumn("share", F.round("share", 8))


_HISTORY_SQL = f"""u AS (SELECT nationkey, year, m, base, CAST(year % 3 AS INTEGER) - 1 AS s, share FROM ({UNITS_SQL})), q AS (SELECT * FROM u WHERE share > 0 AND share < 1),
    f AS (SELECT t.year, max(p.year) AS through, count(*) AS n, regr_slope(p.share, p.m) AS b, regr_intercept(p.share, p.m) AS a, regr_sxy(p.share, p.m) AS sxy, regr_syy(p.share, p.m) AS syy FROM (SELECT DISTINCT year FROM q) t JOIN q p ON p.year < t.year GROUP BY t.year HAVING count(DISTINCT p.year) >= 2),
    h AS (SELECT year, min(m) AS n, min(s) AS s FROM u GROUP BY year), g AS (SELECT year, s, lag(n) OVER (ORDER BY year) AS l, n - lag(n) OVER (ORDER BY year) AS d FROM h),
    c AS (SELECT x.year, least(greatest(x.l + coalesce(avg(y.d), 0), 0), 1) AS forecast FROM g x LEFT JOIN g y ON y.year < x.year AND y.s = x.s AND x.s <> 0 WHERE x.l IS NOT NULL GROUP BY x.year, x.l),
    e AS (SELECT f.*, forecast, forecast - h.n AS e FROM f JOIN c ON c.year = f.year JOIN h ON h.year = f.year),
    v AS (SELECT *, CASE WHEN count(e) OVER w >= 3 THEN stddev_samp(e) OVER w ELSE 0 END AS nat FROM e WINDOW w AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register(
    "chronological",
    f"WITH {_HISTORY_SQL} SELECT q.nationkey, q.year, round(a + b * forecast, 6) AS pred, round(sqrt(greatest(0, syy - b * sxy) / (n - 2) + b * b * nat * nat), 6) AS sigma, through AS train_through FROM q JOIN v ON v.year = q.year",
)
def chronological(spark, sf_dir):
    """The units' shares from earlier years only, with a forecast of the national share and its error in sigma."""
    rows = units(spark, sf_dir).withColumn("s", (F.col("year") % 3 - 1).cast("int"))
    return rounded(forecasts.chronological(rows, ["m"], "share", "year", "m", "s", 2).select("nationkey", "year", "pred", "sigma", "train_through"))
