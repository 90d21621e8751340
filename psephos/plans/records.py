"""Queries of gates, ledgers, seats, matching and page tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, ledger, matching, seats
from ..sources import documents, snapshots, staging
from ..streaming import latest, sink
from ..streaming import ledger as streams
from .catalog import register, table
from .timing import events, plans


@register(
    "check_report",
    """SELECT 'status_known' AS check_name, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) = 0 AS passed, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS n_bad FROM orders
    UNION ALL SELECT 'price_positive', count(*) FILTER (WHERE o_totalprice <= 0) = 0, count(*) FILTER (WHERE o_totalprice <= 0) FROM orders UNION ALL SELECT 'not_empty', count(*) > 0, CAST(count(*) = 0 AS BIGINT) FROM orders
    UNION ALL SELECT 'unique_key', count(*) = count(DISTINCT o_custkey), count(*) - count(DISTINCT o_custkey) FROM orders""",
)
def check_report(spark, sf_dir):
    rules = {"status_known": F.col("o_orderstatus").isin("F", "O"), "price_positive": F.col("o_totalprice") > 0}
    return checks.report(table(spark, sf_dir, "orders"), rules, ["o_custkey"])


@register("functional_dependency", "WITH g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY 1) SELECT 'o_orderstatus' AS \"column\", count(*) FILTER (WHERE a > 1) = 0 AS passed, count(*) FILTER (WHERE a > 1) AS n_bad FROM g UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE b > 1) = 0, count(*) FILTER (WHERE b > 1) FROM g")
def functional_dependency(spark, sf_dir):
    return checks.depends_only_on(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@register("violations", "SELECT o_orderkey, CASE WHEN o_totalprice < 20000 AND o_orderstatus = 'P' THEN 'price,status' WHEN o_totalprice < 20000 THEN 'price' ELSE 'status' END AS broken FROM orders WHERE o_totalprice < 20000 OR o_orderstatus = 'P'")
def violations(spark, sf_dir):
    out = checks.violations(table(spark, sf_dir, "orders"), {"price": F.col("o_totalprice") >= 20000, "status": F.col("o_orderstatus") != "P"})
    return out.select("o_orderkey", F.array_join("broken", ",").alias("broken"))


@register(
    "covered_once",
    """WITH p AS (SELECT s_nationkey AS nationkey, CAST(1994 + s_suppkey % 7 AS INTEGER) AS a, CASE WHEN s_suppkey % 5 = 0 THEN 9999 ELSE CAST(1994 + s_suppkey % 7 + s_suppkey % 3 AS INTEGER) END AS b FROM supplier),
    y AS (SELECT CAST(unnest([1996, 1998, 2000]) AS INTEGER) AS period) SELECT k.nationkey, y.period, count(p.a) AS n_plans FROM (SELECT DISTINCT nationkey FROM p) k CROSS JOIN y LEFT JOIN p ON p.nationkey = k.nationkey AND y.period BETWEEN p.a AND p.b GROUP BY 1, 2 HAVING count(p.a) <> 1""",
)
def covered_once(spark, sf_dir):
    return checks.covered_once(plans(spark, sf_dir), ["nationkey"], [1996, 1998, 2000], "first_year", "last_year")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("certified"))


LEDGER_SQL = """WITH e AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS certified FROM events {}), m AS (SELECT *, sum(CASE WHEN certified THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS r FROM e),
f AS (SELECT *, min(CASE WHEN certified THEN ts END) OVER (PARTITION BY user_id, r) AS c FROM m) SELECT user_id, ts, event_id, certified, CASE WHEN certified THEN c END AS certified_on FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"""


@register("certification_ledger", LEDGER_SQL.format(""))
def certification_ledger(spark, sf_dir):
    return ledger.certification(observations(spark, sf_dir), ["user_id"], "ts", "certified")


@register("certification_as_of", LEDGER_SQL.format("WHERE ts <= TIMESTAMP '2024-01-15'"))
def certification_as_of(spark, sf_dir):
    return ledger.certification(observations(spark, sf_dir), ["user_id"], "ts", "certified", "2024-01-15")


@register("incumbency", """WITH w AS (SELECT o_custkey AS seat, CAST(year(o_orderdate) AS INTEGER) AS cycle, max({'p': o_totalprice, 'k': o_orderpriority}).k AS winner FROM orders GROUP BY 1, 2),
    n AS (SELECT DISTINCT o_custkey AS seat, CAST(year(o_orderdate) AS INTEGER) AS cycle, regexp_replace(upper(o_orderpriority), '[^A-Z]', '', 'g') AS k FROM orders)
    SELECT w.seat, w.cycle, w.winner, p.winner AS incumbent_name, p.winner IS NOT NULL AS prior_available, n.k IS NOT NULL AS incumbent_running, p.winner IS NOT NULL AND n.k IS NULL AS open_seat, coalesce(n.k IS NOT NULL AND w.winner = p.winner, false) AS incumbent_won
    FROM w LEFT JOIN w p ON p.seat = w.seat AND p.cycle + 2 = w.cycle LEFT JOIN n ON n.seat = w.seat AND n.cycle = w.cycle AND n.k = regexp_replace(upper(p.winner), '[^A-Z]', '', 'g')""")
def incumbency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seat"), F.year("o_orderdate").alias("cycle"), "o_totalprice", "o_orderpriority")
    winners = o.groupBy("seat", "cycle").agg(F.max(F.struct("o_totalprice", "o_orderpriority"))["o_orderpriority"].alias("winner"))
    return seats.incumbency(winners, o, "seat", "cycle", "winner", "o_orderpriority", 2).withColumn("incumbent_won", F.coalesce("incumbent_won", F.lit(False)))


@register("seat_universe", """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'model' WHEN c_custkey % 2 = 0 THEN 'partisanship_prior' ELSE 'recent_result' END AS source, CAST(CASE WHEN c_acctbal > 5000 THEN 0.6 WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.4 END AS DOUBLE) AS mean_share,
    CAST(CASE WHEN c_acctbal > 5000 THEN 0.05 ELSE 0.1 END AS DOUBLE) AS sigma FROM customer WHERE c_acctbal > 5000 OR c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def seat_universe(spark, sf_dir):
    when = lambda c, v: F.when(c, F.lit(v))
    rows = table(spark, sf_dir, "customer").select("c_custkey", when(F.col("c_acctbal") > 5000, 0.6).alias("m"), when(F.col("c_custkey") % 2 == 0, 0.5).alias("p"), when(F.col("c_custkey") % 3 == 0, 0.4).alias("r"), F.lit(None).cast("double").alias("s"))
    return seats.seat_universe(rows, "m", "p", "r", "s", 0.05).select("c_custkey", "source", "mean_share", "sigma")


PROJECT_SQL = """WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'redrawn' WHEN 2 THEN 'unverified' ELSE 'redrawn' END AS b, CASE WHEN c_custkey % 5 > 0 THEN 0.3 + c_nationkey / 100.0 END AS o, CASE WHEN c_custkey % 4 = 1 THEN 0.55 END AS t, 0.04 AS ts, c_nationkey / 200.0 - 0.06 AS l FROM customer),
x AS (SELECT *, CASE WHEN b = 'redrawn' AND t IS NOT NULL THEN t - 0.51 WHEN b = 'redrawn' THEN l ELSE o - 0.51 END AS lean FROM s)
SELECT c_custkey, round(lean, 9) AS lean, CASE WHEN b = 'redrawn' AND t IS NOT NULL THEN 'model_transferred' WHEN b = 'redrawn' THEN 'fallback_state_lean' WHEN b = 'unverified' THEN 'model_unverified' ELSE 'model' END AS source,
    round(CASE WHEN b = 'redrawn' AND t IS NOT NULL THEN sqrt(0.06 * 0.06 + 0.8 * 0.04 * 0.8 * 0.04) WHEN b = 'redrawn' THEN sqrt(0.06 * 0.06 + 0.8 * 0.09 * 0.8 * 0.09) ELSE 0.06 END, 9) AS sigma, round(0.01 + 0.8 * lean + 0.95 * 0.52, 9) AS mean_share FROM x WHERE lean IS NOT NULL"""


@register("seat_projection", PROJECT_SQL)
def seat_projection(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 4 == 0, "unchanged").when(k % 4 == 2, "unverified").otherwise("redrawn").alias("b"),
        F.when(k % 5 > 0, 0.3 + F.col("c_nationkey") / 100.0).alias("o"),
        F.when(k % 4 == 1, F.lit(0.55)).alias("t"),
        F.lit(0.04).alias("ts"),
        (F.col("c_nationkey") / 200.0 - 0.06).alias("l"),
    )
    out = seats.project(rows, "b", "o", "t", "ts", "l", 0.51, F.lit(0.52), 0.01, 0.8, 0.95, 0.06, 0.09)
    return out.select("c_custkey", F.round("lean", 9).alias("lean"), "source", F.round("sigma", 9).alias("sigma"), F.round("mean_share", 9).alias("mean_share"))


@register("under_each_assumption", "SELECT n_nationkey, CAST(k AS INTEGER) AS assumption, round(0.5 - 0.03 + 0.06 * k / 3, 9) AS national FROM nation CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)")
def under_each_assumption(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey")
    return seats.under_each(rows, seats.precision_band(0.5, -0.03, 0.03, 4)).select("n_nationkey", F.col("assumption").cast("int").alias("assumption"), F.round("national", 9).alias("national"))


_WORDS = "list_filter(string_split(trim(regexp_replace(upper({0}), '[^A-Z]+', ' ', 'g')), ' '), lambda w: length(w) > 1)"


@register(
    "tiered_match",
    f"""WITH w AS (SELECT p_partkey, p_brand, {_WORDS.format("p_name")} AS r,
        {_WORDS.format("CASE p_partkey % 3 WHEN 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') WHEN 1 THEN array_to_string(string_split(p_name, ' ')[2:], ' ') ELSE p_name END")} AS n FROM part),
    k AS (SELECT p_partkey, p_brand, n, r, [n[-1], CASE WHEN len(n) >= 2 THEN n[-2] || n[-1] END] AS nl, [r[-1], CASE WHEN len(r) >= 2 THEN r[-2] || r[-1] END] AS rl FROM w),
    p AS (SELECT a.p_partkey AS row_id, b.p_partkey AS hit, list_has_any(list_filter(a.nl, lambda x: x IS NOT NULL), list_filter(b.rl, lambda x: x IS NOT NULL)) AS same, list_sort(list_distinct(a.n)) = list_sort(list_distinct(b.r)) AS whole, a.n[1] = b.r[1] AS first, a.n[1][1] = b.r[1][1] AS initial, len(list_distinct(a.n)) >= 2 AND list_has_all(b.r, a.n) AS inside
        FROM k a JOIN k b ON a.p_brand = b.p_brand),
    t AS (SELECT row_id, hit, CASE WHEN whole THEN 1 WHEN same AND first THEN 2 WHEN same AND initial THEN 3 WHEN same THEN 4 WHEN inside THEN 5 END AS tier FROM p),
    m AS (SELECT row_id, min(tier) AS tier FROM t WHERE tier IS NOT NULL GROUP BY row_id),
    c AS (SELECT t.row_id, t.tier, count(*) AS n, min(hit) AS hit FROM t JOIN m ON t.row_id = m.row_id AND t.tier = m.tier GROUP BY ALL)
    SELECT w.p_partkey AS row_id, CASE WHEN c.n = 1 THEN hit END AS p_partkey, coalesce(CASE WHEN c.n = 1 THEN '' ELSE 'ambiguous_' END || ['token_set', 'last_first', 'last_initial', 'surname_unique', 'tokens_within'][tier], 'none') AS method FROM w LEFT JOIN c ON c.row_id = w.p_partkey""",
)
def tiered_match(spark, sf_dir):
    """Part names, some with swapped or missing words, matched to the part list of their brand; unit tests check each tier."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    words = F.split("p_name", " ")
    said = F.when(F.col("p_partkey") % 3 == 0, F.array_join(F.reverse(words), " ")).when(F.col("p_partkey") % 3 == 1, F.array_join(F.slice(words, 2, 10), " ")).otherwise(F.col("p_name"))
    names = parts.select(F.col("p_partkey").alias("row_id"), said.alias("name"), "p_brand")
    return matching.tiered(names, parts, "row_id", "name", "p_partkey", "p_name", ["p_brand"])


@register(
    "html_table",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation), k AS (SELECT unnest([0, 1]) AS c)
    SELECT r_regionkey, CAST(0 AS INTEGER) AS "table", CAST(0 AS INTEGER) AS "row", CAST(c AS INTEGER) AS "column", CASE c WHEN 0 THEN 'key' ELSE 'nation & name' END AS text FROM region, k
    UNION ALL SELECT n_regionkey, 0, CAST(r AS INTEGER), CAST(c AS INTEGER), CASE c WHEN 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END FROM n, k
    UNION ALL SELECT r_regionkey, 1, 0, 0, r_name FROM region""",
)
def html_table(spark, sf_dir):
    """Cells of pages of the regions: a table of each one's nations, in untidy markup, and one of its name."""
    row = F.concat(F.lit("<tr><td> "), F.col("n_nationkey").cast("string"), F.lit("<td class='n'><b>"), F.col("n_name"), F.lit("</b>\n</td></tr>"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("x")))).alias("l"))
    pages = table(spark, sf_dir, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    body = F.concat(F.lit("<p>none</p><TABLE><tr><th>key</th><th>nation &amp; name</th></tr>"), F.array_join(F.coalesce(F.col("l.x"), F.array().cast("array<string>")), ""), F.lit("</TABLE><table><tr><td>"), F.col("r_name"), F.lit("</table>"))
    return documents.html_cells(pages.select("r_regionkey", body.alias("html")), "r_regionkey", "html")


_DIGEST_PARTS = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * k + 1}, 8)) AS HUGEINT)) AS VARCHAR)" for k in range(8))


@register(
    "table_digest",
    f"""WITH d AS (SELECT sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders)
    SELECT count(*) AS n, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_DIGEST_PARTS})) AS sha256 FROM d""",
)
def table_digest(spark, sf_dir):
    return snapshots.digest(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])


def _streamed(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:
    """What a streaming query over the events gives once all of them have gone through it."""
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return sink.finished(build(files.withColumn("ts", F.col("ts").cast("timestamp"))), mode)


@register("streaming_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def streaming_windows(spark, sf_dir):
    out = _streamed(spark, sf_dir, lambda s: streams.windowed(s, "ts", ["event_type"], "value", "1 day"), "complete")
    return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "event_type", "n", F.round("total", 4).alias("total"))


@register("streaming_latest", "SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def streaming_latest(spark, sf_dir):
    out = _streamed(spark, sf_dir, lambda s: streams.latest_per_key(s, ["user_id"], "ts", ["event_id"]), "complete")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Parts of the events' time that reach the stream one after the other, and days after which a key is forgotten.
_SLICES, _EXPIRY = 4, 3.5


@register(
    "streaming_changes",
    f"""WITH b AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events),
    l AS (SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, event_type, ts, event_id, epoch_us(ts) // 1000 + {int(_EXPIRY * 86_400_000)} <= b.high // 1000 - CAST(ceil((b.high - b.low) / {_SLICES} / 1000000.0) AS BIGINT) * 1000 AS expired FROM l, b""",
)
def streaming_changes(spark, sf_dir):
    """The latest event of each user and kind, and whether it has expired, from the change rows of a keyed state.

    The events come in slices of time, each fifth one slice late, with a run of the stream from its checkpoint for each.
    """
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    low, high, kinds = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts")), F.approx_count_distinct(F.struct("user_id", "event_type"))).first()
    groups = max(latest.GROUPS, kinds // latest.GROUP_KEYS)
    width = (high - low) // _SLICES + 1
    late = F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    slices = staging.stored(events.withColumn("slice", F.floor((F.unix_micros("ts") - low) / width).cast("int") + late), "event-slices")
    folder = f"{staging.shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    latest.use_store(spark)
    try:
        for k in range(_SLICES + 1):
            slices.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            changes = latest.latest_changes(stream, ["user_id", "event_type"], "ts", ["event_id"], f"{-(-(high - low) // _SLICES // 1_000_000)} seconds", _EXPIRY, groups)
            sink.appended(changes, f"{folder}/changes", f"{folder}/state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    standing = latest.standing(spark.read.parquet(f"{folder}/changes/*"), ["user_id", "event_type"], "ts", ["event_id"])
    return standing.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "expired")
