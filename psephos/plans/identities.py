"""Queries of identity: two-sided assignment, and whether holders are on the ballot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity
from .catalog import register, table

_TIERS = ("whole", "last", "first")


def _rounds_sql(rounds: int) -> str:
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"""x{k} AS (SELECT *, min(tier) OVER (PARTITION BY l) AS ml, min(tier) OVER (PARTITION BY r) AS mr FROM e{k - 1}),
        y{k} AS (SELECT *, count(*) FILTER (WHERE tier = ml) OVER (PARTITION BY l) AS cl, count(*) FILTER (WHERE tier = mr) OVER (PARTITION BY r) AS cr FROM x{k}),
        f{k} AS MATERIALIZED (SELECT l, r, tier FROM y{k} WHERE tier = ml AND tier = mr AND cl = 1 AND cr = 1),
        e{k} AS MATERIALIZED (SELECT l, r, tier FROM e{k - 1} WHERE l NOT IN (SELECT l FROM f{k}) AND r NOT IN (SELECT r FROM f{k}))""")
    return ",\n".join(steps)


@register(
    "two_sided_identity",
    f"""WITH n AS (SELECT p_partkey AS id, p_brand, p_size % 10 AS s, p_name AS whole, string_split(p_name, ' ')[-1] AS last, string_split(p_name, ' ')[1] AS first FROM part),
    a AS (SELECT * FROM n WHERE id % 2 = 0), b AS (SELECT * FROM n WHERE id % 2 = 1),
    f0 AS (SELECT a.id AS l, b.id AS r FROM a JOIN b ON b.id = a.id + 1 WHERE a.id % 100 = 0),
    p AS (SELECT a.id AS l, b.id AS r, CASE WHEN a.whole = b.whole THEN 0 WHEN a.last = b.last THEN 1 WHEN a.first = b.first THEN 2 END AS tier
        FROM a JOIN b ON a.p_brand = b.p_brand AND a.s = b.s WHERE NOT (a.id % 14 = 0 AND b.id // 100 = a.id // 100)),
    e0 AS (SELECT * FROM p WHERE tier IS NOT NULL AND l NOT IN (SELECT l FROM f0) AND r NOT IN (SELECT r FROM f0)),
    {_rounds_sql(identity.ROUNDS)},
    f AS (SELECT l, r, 'reviewed' AS method, 0 AS k FROM f0 {" ".join(f"UNION ALL SELECT l, r, ['whole', 'last', 'first'][tier + 1], {k} FROM f{k}" for k in range(1, identity.ROUNDS + 1))}),
    o AS (SELECT l, count(*) FILTER (WHERE tier = ml) AS n FROM (SELECT *, min(tier) OVER (PARTITION BY l) AS ml FROM e{identity.ROUNDS}) GROUP BY l)
    SELECT a.id AS row_id, f.r AS entry_id, f.method, CAST(f.k AS INTEGER) AS round, CASE WHEN f.l IS NOT NULL THEN NULL WHEN o.n IS NULL THEN 'none' WHEN o.n > 1 THEN 'ambiguous' ELSE 'contested' END AS reason,
        CASE WHEN f.l IS NULL THEN coalesce(o.n, 0) END AS n_partners
    FROM a LEFT JOIN f ON f.l = a.id LEFT JOIN o ON o.l = a.id""",
)
def two_sided_identity(spark, sf_dir):
    """Parts of even keys and parts of odd keys assigned to each other within brand and size class, by name, last or first word.

    Each hundredth pair of neighbours is reviewed as the same; every fourteenth part is reviewed as none of its hundred.
    """
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 10).alias("size_class"), F.col("p_name").alias("whole"), F.element_at(words, -1).alias("last"), words[0].alias("first"))
    names = parts.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "row_id")
    entries = parts.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "entry_id")
    same = names.where("row_id % 100 = 0").select("row_id", (F.col("row_id") + 1).alias("entry_id"))
    others = names.where("row_id % 14 = 0").select("row_id", F.explode(F.sequence(F.expr("row_id div 100 * 100 + 1"), F.expr("row_id div 100 * 100 + 99"), F.lit(2))).alias("entry_id"))
    assigned, rest = identity.two_sided(names, entries, "row_id", "entry_id", ["p_brand", "size_class"], _TIERS, same, others)
    found = assigned.withColumns({"reason": F.lit(None).cast("string"), "n_partners": F.lit(None).cast("bigint")})
    open_ = rest.select("row_id", F.lit(None).cast("bigint").alias("entry_id"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("round"), "reason", F.col("n").alias("n_partners"))
    return found.unionByName(open_)


@register(
    "ballot_evidence",
    """WITH p AS (SELECT p_partkey AS k, CAST(right(p_brand, 1) AS INTEGER) % 5 AS state, p_size % 8 AS district, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last FROM part),
    h AS (SELECT state, district, arg_min(first, k) AS first, arg_min(last, k) AS last, CASE WHEN min(k) % 3 = 0 THEN 'DEMOCRAT' ELSE 'REPUBLICAN' END AS party FROM p WHERE k % 2 = 1 GROUP BY state, district),
    c AS (SELECT DISTINCT state, district, first, last FROM p WHERE k % 2 = 0 AND k % 11 = 0),
    b AS (SELECT *, CASE WHEN length(first) % 2 = 0 THEN 'DEMOCRAT' ELSE 'REPUBLICAN' END AS party, length(last) % 3 = 0 AS partial FROM c),
    nr AS (SELECT state, last, first, count(*) AS n FROM h GROUP BY ALL), nc AS (SELECT state, last, first, count(*) AS n FROM b GROUP BY ALL),
    m AS (SELECT b.*, h.district AS held, h.party AS held_by FROM b JOIN nr USING (state, last, first) JOIN nc USING (state, last, first) JOIN h USING (state, last, first) WHERE nr.n = 1 AND nc.n = 1),
    o AS (SELECT b.state, b.district, bool_or(true) AS open FROM b ANTI JOIN m ON (b.state, b.district, b.last, b.first) = (m.state, m.district, m.last, m.first)
        JOIN h ON h.state = b.state AND h.last = b.last AND h.first[1] = b.first[1] GROUP BY ALL),
    r AS (SELECT b.state, b.district, max(h.first || ' ' || h.last) AS incumbent, count(h.first) AS seats, bool_or(m.held = b.district) AS running, bool_or(b.partial) AS partial, bool_or(b.last = h.last) AS namesake, bool_or(o.open) AS open,
            coalesce(string_agg(b.first || ' ' || b.last, ' | ' ORDER BY b.first || ' ' || b.last) FILTER (WHERE b.party = 'DEMOCRAT'), '') AS dem, coalesce(string_agg(b.first || ' ' || b.last, ' | ' ORDER BY b.first || ' ' || b.last) FILTER (WHERE b.party = 'REPUBLICAN'), '') AS rep,
            coalesce(bool_or(m.held_by = 'DEMOCRAT'), false) AS id, coalesce(bool_or(m.held_by = 'REPUBLICAN'), false) AS ir
        FROM b LEFT JOIN m ON (b.state, b.district, b.last, b.first) = (m.state, m.district, m.last, m.first) LEFT JOIN h ON h.state = b.state AND h.district = b.district LEFT JOIN o ON o.state = b.state AND o.district = b.district GROUP BY ALL)
    SELECT state, district, incumbent, coalesce(running, false) AS incumbent_running, dem AS dem_nominee, rep AS rep_nominee, CAST(id AS INTEGER) AS ballot_incumbent_dem, CAST(ir AS INTEGER) AS ballot_incumbent_rep, CASE WHEN partial THEN 'ballot presence only' ELSE 'complete ballot' END AS evidence
    FROM r WHERE seats > 0 AND coalesce(open, false) = false AND (coalesce(running, false) OR (NOT partial AND coalesce(namesake, false) = false))""",
)
def ballot_evidence(spark, sf_dir):
    """Which holders of made seats (by brand and size) are among the parts' names on their ballots; settled races only."""
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.substring("p_brand", -1, 1).cast("int") % 5).alias("state"), F.lit("house").alias("office"), (F.col("p_size") % 8).alias("district"), F.element_at(words, 1).alias("f"), F.element_at(words, -1).alias("l"))
    name = F.concat_ws(" ", "f", "l")
    first = parts.where("p_partkey % 2 = 1").groupBy("state", "office", "district").agg(F.min(F.struct("p_partkey", name.alias("holder"))).alias("m"))
    roster = first.select("state", "office", "district", "m.holder", F.when(F.col("m.p_partkey") % 3 == 0, "DEMOCRAT").otherwise("REPUBLICAN").alias("party"))
    said = parts.where("p_partkey % 22 = 0").select("state", "office", "district", name.alias("candidate"), F.when(F.length("f") % 2 == 0, "DEMOCRAT").otherwise("REPUBLICAN").alias("party"), (F.length("l") % 3 == 0).alias("partial"))
    reviews = spark.createDataFrame([], "state int, office string, candidate string, holder string, same_person string, retrieved_on date")
    settled, _ = identity.ballot_evidence(said, roster, reviews, "2026-09-01", {"DEMOCRAT": "dem", "REPUBLICAN": "rep"})
    return settled.drop("office")
