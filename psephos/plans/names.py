"""Queries of text and calendar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, places, text
from .catalog import register, table


@register("name_key", "SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z]', '', 'g') AS name_key, upper(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS squeezed FROM customer")
def name_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.letters(F.col("c_name")).alias("name_key"), text.squeezed(F.col("c_name")).alias("squeezed"))


@register("token_key", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(upper(p_name), '[^A-Z]+', ' ', 'g')), ' '), lambda w: length(w) > 1))), '|') AS token_key FROM part")
def token_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.token_key(F.col("p_name")).alias("token_key"))


#: Labels that parts stand for by their size, so that every party occurs.
SAID = ("Republican Party", "dfl", "LIBERTARIAN", "", " Green ", "Democratic Socialist", "no  party preference", "GOP", "Whig", "DEMOCRAT/REPUBLICAN", "d", "oth")
PARTY_OF = ("REPUBLICAN", "DEMOCRAT", "LIBERTARIAN", "UNKNOWN", "GREEN", "OTHER", "INDEPENDENT", "REPUBLICAN", "OTHER", "OTHER", "DEMOCRAT", "OTHER")
_sql_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@register(
    "party_alias",
    f"""WITH s AS (SELECT p_partkey, p_size % 12 AS k, p_size % 5 AS j, {_sql_list(PARTY_OF)} AS ps FROM part),
    t AS (SELECT p_partkey, ps[k + 1] AS party, ps[j + 1] AS simplified, {_sql_list(SAID)}[k + 1] AS said FROM s)
    SELECT p_partkey, party, CASE party WHEN 'DEMOCRAT' THEN 'D' WHEN 'REPUBLICAN' THEN 'R' ELSE 'OTHER' END AS bucket,
    CASE WHEN party IN ('DEMOCRAT', 'REPUBLICAN') THEN party WHEN simplified IN ('DEMOCRAT', 'REPUBLICAN') THEN simplified WHEN p_partkey % 4 = 0 THEN 'GREEN'
        WHEN party NOT IN ('UNKNOWN', 'OTHER') THEN party WHEN simplified NOT IN ('UNKNOWN', 'OTHER') THEN simplified WHEN simplified <> 'UNKNOWN' THEN simplified ELSE 'UNKNOWN' END AS ballot_party,
    CASE WHEN party IN ('DEMOCRAT', 'REPUBLICAN') THEN 'raw' WHEN simplified IN ('DEMOCRAT', 'REPUBLICAN') THEN 'simplified' WHEN p_partkey % 4 = 0 THEN 'filed'
        WHEN party NOT IN ('UNKNOWN', 'OTHER') THEN 'raw' WHEN simplified <> 'UNKNOWN' THEN 'simplified' ELSE 'unresolved' END AS source
    FROM t""",
)
def party_alias(spark, sf_dir):
    """Parties by label, their bucket, and the ballot party by precedence; labels go by the parts' sizes."""
    labels = F.array(*map(F.lit, SAID))
    said, simplified = (F.element_at(labels, (F.col("p_size") % n + 1).cast("int")) for n in (12, 5))
    ballot = text.ballot_party(said, simplified, F.when(F.col("p_partkey") % 4 == 0, "GRE"))
    return table(spark, sf_dir, "part").select("p_partkey", text.party(said).alias("party"), text.bucket(said).alias("bucket"), ballot["value"].alias("ballot_party"), ballot["source"].alias("source"))


@register(
    "state_codes",
    """WITH s AS (SELECT c_custkey, c_nationkey, CASE c_nationkey WHEN 0 THEN ' al ' WHEN 1 THEN '2' WHEN 2 THEN 'new hampshire' WHEN 3 THEN '11' WHEN 4 THEN 'Puerto Rico' WHEN 5 THEN 'DC' WHEN 6 THEN '56' ELSE c_name END AS said FROM customer)
    SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'AL' WHEN 1 THEN 'AK' WHEN 2 THEN 'NH' WHEN 3 THEN 'DC' WHEN 4 THEN 'PR' WHEN 5 THEN 'DC' WHEN 6 THEN 'WY' END AS postal,
    CASE c_nationkey WHEN 0 THEN '01' WHEN 1 THEN '02' WHEN 2 THEN '33' WHEN 3 THEN '11' WHEN 4 THEN '72' WHEN 5 THEN '11' WHEN 6 THEN '56' END AS fips FROM s""",
)
def state_codes(spark, sf_dir):
    """Customers with a state said in one of the usual ways, as postal and FIPS codes."""
    said = F.col("c_name")
    for k, v in enumerate([" al ", "2", "new hampshire", "11", "Puerto Rico", "DC", "56"]):
        said = F.when(F.col("c_nationkey") == k, v).otherwise(said)
    return table(spark, sf_dir, "customer").select("c_custkey", places.postal(said).alias("postal"), places.fips(said).alias("fips"))


@register("code_normalize", "SELECT c_custkey, CASE WHEN regexp_extract(upper(c_name), '([A-Z0-9.]+)\\s*$', 1) SIMILAR TO '0+' THEN '0' ELSE regexp_replace(regexp_extract(upper(c_name), '([A-Z0-9.]+)\\s*$', 1), '^0+', '') END AS code, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS fips FROM customer")
def code_normalize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.precinct_code(F.col("c_name")).alias("code"), text.padded(F.col("c_nationkey"), 2).alias("fips"))


@register("contest_classify", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#1') THEN 'house' WHEN regexp_matches(p_brand, '^Brand') THEN 'senate' END AS office, CASE WHEN regexp_matches(p_brand, '^Brand#1') THEN TRY_CAST(regexp_extract(p_brand, '^Brand#1(\\d*)', 1) AS INTEGER) END AS district FROM part")
def contest_classify(spark, sf_dir):
    found = text.contest(F.col("p_brand"), [("house", r"^Brand#1(\d*)"), ("senate", "^Brand")])
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("c")).select("p_partkey", "c.office", "c.district")


@register("race_ids", "SELECT o_orderkey, concat_ws('_', CAST(year(o_orderdate) AS VARCHAR), 'us_house', o_orderstatus, lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0'), 'gen', CASE WHEN o_orderkey % 7 = 0 THEN 'special' END) AS race_id, CASE WHEN o_custkey % 10 = 0 THEN 'state:' || lpad(CAST(o_custkey % 56 AS VARCHAR), 2, '0') ELSE 'state:' || lpad(CAST(o_custkey % 56 AS VARCHAR), 2, '0') || '|district:cong_' || lpad(CAST(o_custkey % 10 AS VARCHAR), 2, '0') END AS geography_id FROM orders")
def race_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = text.race_id(F.year("o_orderdate"), F.lit("us_house"), F.col("o_orderstatus"), F.col("o_custkey") % 50, F.lit("gen"), F.col("o_orderkey") % 7 == 0, F.lit(False))
    place = text.geography_id(F.col("o_custkey") % 56, F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 10))
    return o.select("o_orderkey", key.alias("race_id"), place.alias("geography_id"))


@register("election_days", "SELECT y AS year, CAST(make_date(y, 11, 1) + CAST((8 - dayofweek(make_date(y, 11, 1))) % 7 AS INTEGER) + 1 AS DATE) AS day, CAST(floor((y - 2) / 10) * 10 + 2 AS INTEGER) AS era FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)")
def election_days(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.select("year", calendar.election_day(F.col("year")).alias("day"), calendar.plan_era(F.col("year")).alias("era"))


@register("url_parts", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN regexp_extract(url, '^https://([^/?#]*)', 1) END AS host FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.https_host(F.col("url")).alias("host"))
