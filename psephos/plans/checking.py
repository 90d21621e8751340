"""Queries of the quality gates: given tables dressed as the gated ones, with rows that break each rule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from ..operators import checks, gates
from .catalog import register, table


def gate_sql(frame: str, rules: Mapping[str, str], key: str | None = None) -> str:
    """A gate's report in SQL: a row per rule with how many rows of the frame don't meet it."""
    row = lambda name, bad: f"SELECT '{name}' AS check_name, {bad} = 0 AS passed, CAST({bad} AS BIGINT) AS n_bad FROM t"
    parts = [row(name, f"count(*) FILTER (WHERE NOT coalesce({rule}, false))") for name, rule in rules.items()]
    parts.append(row("not_empty", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"))
    if key:
        parts.append(row("unique_key", f"(count(*) - count(DISTINCT ({key})))"))
    return f"WITH t AS ({frame}) " + " UNION ALL ".join(parts)


def frame(spark, sf_dir: str, name: str, **columns: str):
    """Columns of a table by expressions that Spark and DuckDB read alike."""
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def sql_of(name: str, columns: Mapping[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {name}"


FILLED = "trim(coalesce(CAST({} AS VARCHAR), '')) <> ''"
_filled = lambda *columns: "(" + " AND ".join(FILLED.format(c) for c in columns) + ")"

SPINE = {
    "geography_id": "CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE concat('state:', c_nationkey) END",
    "level": "CASE WHEN c_custkey % 3 = 0 THEN 'nation' ELSE 'state' END",
    "parent": "CASE WHEN c_custkey % 4 <> 1 THEN 'nation:us' END",
}


@register("geography_gate", gate_sql(sql_of("customer", SPINE), {"id_present": _filled("geography_id"), "parent_present": f"level = 'nation' OR {_filled('parent')}"}))
def geography_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "customer", **SPINE), gates.geography())


POLLS = {
    "poll_id": "CAST(o_orderkey % 5000 AS VARCHAR(20))",
    "pollster": "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END",
    "office": "CASE WHEN o_orderkey % 5 = 0 THEN 'us_house_generic' ELSE 'us_senate' END",
    "geography_id": "CASE WHEN o_orderkey % 5 = 0 THEN 'nation:us' ELSE 'state:01' END",
    "district_num": "CASE WHEN o_orderkey % 35 = 0 THEN 1 END",
    "state_po": "CASE WHEN o_orderkey % 5 = 0 THEN 'US' WHEN o_orderkey % 13 = 0 THEN 'XX' ELSE 'AL' END",
    "population": "CASE WHEN o_orderkey % 17 = 0 THEN 'all' ELSE 'lv' END",
    "mode": "o_orderstatus",
    "source_url": "CASE WHEN o_orderkey % 19 = 0 THEN 'ftp://x' ELSE 'https://x' END",
    "field_start": "CAST(o_orderdate AS DATE)",
    "field_end": "CAST(CASE WHEN o_orderkey % 23 = 0 THEN o_orderdate - INTERVAL '1' DAY ELSE o_orderdate END AS DATE)",
    "published_on": "CAST(CASE WHEN o_orderkey % 29 = 0 THEN o_orderdate - INTERVAL '2' DAY ELSE o_orderdate END AS DATE)",
    "sample_size": "o_custkey % 900",
    "dem_pct": "(o_custkey % 120) / 100.0",
    "rep_pct": "0.3",
    "two_party_dem_share": "(o_orderkey % 101) / 100.0",
    "house_effect_dem": "(o_orderkey % 50) / 200.0",
}


@register(
    "poll_gate",
    gate_sql(
        sql_of("orders", POLLS),
        {
            "required_values_present": _filled("poll_id", "pollster", "office", "geography_id", "population", "mode", "source_url"),
            "dates_valid": "field_start <= field_end",
            "sample_size_positive": "sample_size > 0",
            "major_shares_valid": "dem_pct BETWEEN 0 AND 1 AND rep_pct BETWEEN 0 AND 1 AND two_party_dem_share BETWEEN 0 AND 1 AND dem_pct + rep_pct > 0",
            "house_effect_valid": "house_effect_dem BETWEEN -0.2 AND 0.2",
            "population_known": "population IN ('lv', 'rv')",
            "state_known": "state_po IN ('AL', 'AK') OR (state_po = 'US' AND office = 'us_house_generic' AND geography_id = 'nation:us' AND district_num IS NULL)",
            "publication_valid": "published_on >= field_end",
            "source_urls_present": "regexp_matches(source_url, '^https?://')",
        },
        "poll_id",
    ),
)
def poll_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "orders", **POLLS), gates.polls(["lv", "rv"], ["AL", "AK"]), ["poll_id"])


PANEL = {
    "poll_date": "CAST(o_orderdate AS DATE)",
    "election_date": "CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL '9' DAY END AS DATE)",
    "poll_dem_share": "(o_orderkey % 103) / 100.0",
    "actual_dem_share": "(o_custkey % 90) / 100.0",
    "pred_dem_share": "CASE WHEN o_orderkey % 31 <> 0 THEN 0.5 END",
    "resid_sigma": "(o_orderkey % 9) / 10.0",
    "train_through": "1995",
    "cycle": "1992 + o_orderkey % 8",
    "lean_reference_cycle": "1990 + o_orderkey % 5",
}


@register(
    "research_panel_gate",
    gate_sql(
        sql_of("orders", PANEL),
        {
            "poll_before_election": "poll_date < election_date",
            "shares_valid": "poll_dem_share BETWEEN 0 AND 1 AND actual_dem_share BETWEEN 0 AND 1 AND pred_dem_share BETWEEN 0 AND 1",
            "sigma_positive": "resid_sigma > 0",
            "trained_before": "train_through < cycle",
            "lean_from_before": "lean_reference_cycle < cycle",
        },
    ),
)
def research_panel_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "orders", **PANEL), gates.research_panel())


SPECIALS = {
    "include_in_metric": "o_orderkey % 4 <> 0",
    "source_url": "CASE WHEN o_orderkey % 6 <> 0 THEN 'https://x' END",
    "retrieved_on": "CASE WHEN o_orderkey % 10 <> 0 THEN '1999-01-01' ELSE '' END",
    "baseline_source": "'b'",
    "election_date": "CASE WHEN o_orderkey % 12 = 1 THEN '1996-02-30' WHEN o_orderkey % 12 = 2 THEN '2030-01-01' ELSE '1997-05-06' END",
    "results_updated_on": "CASE WHEN o_orderkey % 9 = 0 THEN 'soon' WHEN o_orderkey % 9 = 1 THEN '1997-01-01' WHEN o_orderkey % 9 = 2 THEN '1997-06-01' END",
    "office": "CASE WHEN o_orderkey % 14 = 0 THEN 'mayor' ELSE ' Us_House ' END",
    "dem_votes": "o_custkey % 500 - 3",
    "rep_votes": "CASE WHEN o_orderkey % 15 <> 0 THEN o_orderkey % 400 END",
    "other_votes": "0",
    "contest_format": "CASE WHEN o_orderkey % 16 = 0 THEN 'odd' WHEN o_orderkey % 16 <> 1 THEN 'Partisan' END",
    "exclusion_reason": "CASE WHEN o_orderkey % 8 = 0 THEN 'one party' END",
    "baseline_dem_share": "CASE WHEN o_orderkey % 18 <> 0 THEN (o_custkey % 105) / 100.0 END",
}
_HELD, _UPDATED = (f"CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({c} AS DATE) END" for c in ("election_date", "results_updated_on"))


@register(
    "specials_gate",
    gate_sql(
        sql_of("orders", SPECIALS),
        {
            "source_url_present": f"NOT include_in_metric OR {_filled('source_url')}",
            "retrieved_on_present": f"NOT include_in_metric OR {_filled('retrieved_on')}",
            "baseline_source_present": f"NOT include_in_metric OR {_filled('baseline_source')}",
            "date_valid": f"({_HELD}) IS NOT NULL AND ({_HELD}) <= DATE '1999-12-31'",
            "update_valid": f"NOT {_filled('results_updated_on')} OR ({_UPDATED}) IS NOT NULL",
            "update_after_election": f"({_UPDATED}) IS NULL OR ({_UPDATED}) >= ({_HELD})",
            "office_known": "lower(trim(office)) IN ('us_house', 'us_senate')",
            "votes_nonnegative": "coalesce(dem_votes, 0) >= 0 AND coalesce(rep_votes, 0) >= 0",
            "total_plausible": "NOT include_in_metric OR coalesce(dem_votes, 0) + coalesce(rep_votes, 0) + coalesce(other_votes, 0) >= 100",
            "both_parties": "NOT include_in_metric OR coalesce(dem_votes > 0 AND rep_votes > 0, false)",
            "format_known": "lower(trim(coalesce(contest_format, 'unknown'))) IN ('partisan', 'unknown')",
            "exclusion_explained": f"include_in_metric OR {_filled('exclusion_reason')}",
            "baseline_in_unit_interval": "baseline_dem_share IS NULL OR baseline_dem_share BETWEEN -1e-9 AND 1 + 1e-9",
            "baseline_present": "NOT include_in_metric OR baseline_dem_share IS NOT NULL",
        },
    ),
)
def specials_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "orders", **SPECIALS), gates.specials(["us_house", "us_senate"], ["partisan", "unknown"], 100, "1999-12-31"))


SNAPSHOT = {
    "state_po": "CASE c_nationkey % 5 WHEN 0 THEN 'LA' WHEN 1 THEN 'dc' WHEN 2 THEN ' tx ' WHEN 3 THEN 'ZZ' ELSE 'AL' END",
    "office": "CASE WHEN c_custkey % 6 = 0 THEN 'governor' WHEN c_custkey % 6 = 1 THEN ' US_SENATE' ELSE 'us_house' END",
    "winner_party": "CASE WHEN c_custkey % 7 = 0 THEN 'Green' WHEN c_custkey % 7 = 1 THEN 'democrat ' END",
    "dem_votes": "CAST(c_custkey AS DOUBLE) - 1.0",
    "rep_votes": "CASE WHEN c_custkey % 8 = 0 THEN 1.5 ELSE 2.0 END",
    "other_votes": "CASE WHEN c_custkey % 9 <> 0 THEN 0.0 END",
    "source_url": "CASE c_custkey % 4 WHEN 0 THEN 'http://x.y/z' WHEN 1 THEN 'ftp://x.y' WHEN 2 THEN 'https://a.b' END",
    "retrieved_on": "CASE WHEN c_custkey % 10 = 0 THEN '2026-1-1' ELSE '2026-01-01' END",
    "certified": "CASE WHEN c_custkey % 11 <> 0 THEN true END",
    "election_round": "CASE c_custkey % 12 WHEN 0 THEN 'runoff' WHEN 1 THEN 'second' WHEN 2 THEN 'first_round' END",
    "outcome_resolved": "CASE WHEN c_custkey % 13 <> 0 THEN false END",
    "district_num": "CASE WHEN c_custkey % 14 <> 0 THEN CAST(c_custkey % 9 AS DOUBLE) END",
}
_WHOLE = "coalesce({0} >= 0 AND {0} % 1 = 0, false)"
_LOUISIANA = "(upper(trim(state_po)) = 'LA' AND lower(trim(office)) = 'us_house')"


@register(
    "snapshot_gate",
    gate_sql(
        sql_of("customer", SNAPSHOT),
        {
            "state_known": "upper(trim(state_po)) IN ('AL', 'LA', 'TX')",
            "office_known": "lower(trim(office)) IN ('us_house', 'us_senate')",
            "winner_known": "upper(trim(coalesce(winner_party, ''))) IN ('', 'DEMOCRAT', 'REPUBLICAN', 'OTHER')",
            "votes_are_counts": " AND ".join(_WHOLE.format(c) for c in ("dem_votes", "rep_votes", "other_votes")),
            "source_url_valid": "coalesce(regexp_matches(source_url, '^https?://[^/]+'), false)",
            "retrieved_on_iso_date": "regexp_matches(retrieved_on, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')",
            "certified_stated": "certified IS NOT NULL",
            "round_known": "coalesce(election_round, 'general') IN ('general', 'first_round', 'runoff', 'rcv_final')",
            "louisiana_round": f"NOT {_LOUISIANA} OR coalesce(election_round, 'general') IN ('first_round', 'runoff')",
            "louisiana_resolved_stated": f"NOT {_LOUISIANA} OR outcome_resolved IS NOT NULL",
            "district_for_house": f"lower(trim(office)) <> 'us_house' OR {_WHOLE.format('district_num')}",
        },
    ),
)
def snapshot_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "customer", **SNAPSHOT), gates.snapshot(["AL", "LA", "TX", "DC", "PR"]))


FILINGS = {
    "seat": "o_custkey",
    "incumbent_status": "CASE o_orderkey % 7 WHEN 0 THEN 'nominated' WHEN 1 THEN 'unknown' WHEN 2 THEN 'gone' WHEN 3 THEN 'not_found' ELSE 'filed' END",
    "incumbent_status_evidence": "CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'fec' END",
    "incumbent_candidate_id": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END",
}


@register(
    "filings_gate",
    gate_sql(
        sql_of("orders", FILINGS),
        {
            "status_known": "incumbent_status IN ('filed', 'not_found', 'unknown', 'nominated', 'withdrawn')",
            "no_unsupported_claims": "incumbent_status NOT IN ('nominated', 'withdrawn')",
            "evidence_present": f"incumbent_status = 'unknown' OR {_filled('incumbent_status_evidence')}",
            "filed_has_id": "incumbent_status <> 'filed' OR incumbent_candidate_id IS NOT NULL",
        },
        "seat",
    ),
)
def filings_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "orders", **FILINGS), gates.filings(), ["seat"])


FUNDS = {
    "cycle": "2000",
    "office": "'us_house'",
    "state_po": "o_orderpriority",
    "district_num": "o_custkey",
    "dem_receipts": "o_totalprice - 2000",
    "rep_receipts": "CAST(o_custkey AS DOUBLE)",
    "dem_top_receipts": "o_totalprice / 2",
    "rep_top_receipts": "CAST(CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey + o_orderkey % 2 END AS DOUBLE)",
    "dem_receipt_share": "o_totalprice / 400000",
    "log_receipt_ratio": "CASE WHEN o_orderkey % 9 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN o_orderkey % 9 = 1 THEN CAST('NaN' AS DOUBLE) ELSE 0.5 END",
    "usable": "o_orderkey % 4 <> 0",
    "unusable_reason": "CASE WHEN o_orderkey % 16 <> 0 THEN 'late' ELSE '' END",
}


@register(
    "fundraising_gate",
    gate_sql(
        sql_of("orders", FUNDS),
        {
            "receipts_nonnegative": "dem_receipts >= 0 AND rep_receipts >= 0 AND dem_top_receipts >= 0 AND rep_top_receipts >= 0",
            "top_within_party_total": "dem_top_receipts <= dem_receipts + 1e-6 AND rep_top_receipts <= rep_receipts + 1e-6",
            "share_in_unit_interval": "dem_receipt_share BETWEEN 0 AND 1",
            "ratio_finite": "log_receipt_ratio IS NOT NULL AND isfinite(log_receipt_ratio)",
            "unusable_explained": f"usable OR {_filled('unusable_reason')}",
        },
        "cycle, office, state_po, district_num",
    ),
)
def fundraising_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "orders", **FUNDS), gates.fundraising(), gates.FUNDRAISING_KEY)


STATES = {
    "geoid": "CAST(c_custkey % 140 AS VARCHAR(9))",
    "state_fips": "CAST(c_nationkey AS VARCHAR(9))",
    "total_population": "c_custkey % 50",
    "median_age": "CASE WHEN c_custkey % 21 <> 0 THEN 38.5 END",
    "college_share": "(c_custkey % 110) / 100.0",
    "pct_white": "0.5",
}


@register(
    "demographics_gate",
    gate_sql(
        sql_of("customer", STATES),
        {
            "state_fips_known": "state_fips IN ('1', '2', '3', '4', '5', '20')",
            "no_required_nulls": _filled("geoid", "state_fips", "total_population", "median_age", "college_share", "pct_white"),
            "positive_population": "total_population > 0",
            "rates_in_range": "college_share BETWEEN 0 AND 1 AND pct_white BETWEEN 0 AND 1",
        },
        "geoid",
    ),
)
def demographics_gate(spark, sf_dir):
    rules = gates.demographics(["1", "2", "3", "4", "5", "20"], ["total_population", "median_age"], ["college_share", "pct_white"])
    return checks.report(frame(spark, sf_dir, "customer", **STATES), rules, ["geoid"])


BALLOTS = {
    "state_po": "CASE WHEN c_nationkey = 24 THEN 'XX' ELSE 'MI' END",
    "office": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'us_senate' ELSE 'us_house' END",
    "district_num": "CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey % 13 + 1 END",
    "candidate_name": "CASE WHEN c_custkey % 50 <> 7 THEN concat('n', c_custkey % 400) END",
    "party": "CASE WHEN c_custkey % 2 = 0 THEN 'D' ELSE 'R' END",
    "source_url": "'https://x'",
}


@register("ballot_gate", gate_sql(sql_of("customer", BALLOTS), {"one_state": "state_po = 'MI'", "facts_present": _filled(*BALLOTS)}))
def ballot_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "customer", **BALLOTS), gates.ballots("MI"))


@register(
    "ballot_coverage",
    f"""WITH r AS (SELECT DISTINCT office, district_num AS d FROM ({sql_of("customer", BALLOTS)})), c AS (SELECT count(*) FILTER (WHERE office = 'us_house' AND d BETWEEN 1 AND 13) AS h, count(*) FILTER (WHERE office = 'us_house' AND NOT d BETWEEN 1 AND 13) AS o, count(*) FILTER (WHERE office = 'us_senate') AS s FROM r)
    SELECT h = 13 AND o = 0 AND s = 1 AS passed, h AS n_house, o AS n_other, s AS n_senate FROM c""",
)
def ballot_coverage(spark, sf_dir):
    return gates.ballot_coverage(frame(spark, sf_dir, "customer", **BALLOTS), 13, 1)


CATALOG = {
    "state_po": "concat('S', n_nationkey)",
    "primary_url": "CASE WHEN n_nationkey % 4 = 0 THEN 'http://x.y' ELSE 'https://x.y/z' END",
    "fallback_url": "CASE WHEN n_nationkey % 6 <> 0 THEN 'https://f' END",
    "extraction_status": "CASE n_nationkey % 3 WHEN 0 THEN 'tested' WHEN 1 THEN 'planned' ELSE 'lost' END",
    "certification_evidence": "'law'",
    "download_access": "CASE n_nationkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'shut' WHEN 2 THEN '' END",
    "extraction_evidence": "CASE WHEN n_nationkey % 9 = 0 THEN 'file' END",
}


@register(
    "catalog_gate",
    gate_sql(
        sql_of("nation", CATALOG),
        {
            "provenance_present": _filled("state_po", "primary_url", "fallback_url", "extraction_status", "certification_evidence"),
            "primary_is_https": "starts_with(primary_url, 'https://')",
            "fallback_is_https": "starts_with(fallback_url, 'https://')",
            "status_known": "extraction_status IN ('tested', 'planned')",
            "access_known": "CASE WHEN trim(coalesce(download_access, '')) <> '' THEN download_access ELSE 'untested' END IN ('open', 'untested')",
            "tested_has_evidence": f"extraction_status <> 'tested' OR {_filled('extraction_evidence')}",
        },
        "state_po",
    ),
)
def catalog_gate(spark, sf_dir):
    return checks.report(frame(spark, sf_dir, "nation", **CATALOG), gates.catalog(["tested", "planned"], ["open", "untested"], ["tested"]), ["state_po"])


@register("catalog_covers", "SELECT false AS passed, 50 - count(DISTINCT n_nationkey) FILTER (WHERE n_nationkey < 50) AS n_missing, CAST(0 AS BIGINT) AS n_other FROM nation")
def catalog_covers(spark, sf_dir):
    return gates.covers(frame(spark, sf_dir, "nation", **CATALOG), "state_po", [f"S{k}" for k in range(50)]).select("passed", F.col("n_missing").cast("bigint").alias("n_missing"), "n_other")
