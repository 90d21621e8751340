"""The rules of each table's quality gate, for ``checks.report`` and ``checks.violations``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import https_host, iso_date


def _share(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).between(-1e-9, 1 + 1e-9)


def _filled(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    return out


def silver(states: Sequence[str]) -> dict[str, Column]:
    """Candidate rows; their key is (race_id, candidate, party)."""
    return {"votes_nonnegative": F.col("candidatevotes").isNull() | (F.col("candidatevotes") >= 0), "share_in_unit_interval": _share("vote_share"), "state_fips_valid": F.col("state_fips").isNull() | F.col("state_fips").isin(list(states))}


def geography() -> dict[str, Column]:
    return {"id_present": _filled("geography_id"), "parent_present": (F.col("level") == "nation") | _filled("parent")}


#: The rule names and bounds of ``polls`` are fixed values: they are labels of its report.
def polls(populations: Sequence[str], states: Sequence[str]) -> dict[str, Column]:
    """Poll toplines; their key is poll_id."""
    national = (F.col("state_po") == "US") & (F.col("office") == "us_house_generic") & (F.col("geography_id") == "nation:us") & F.col("district_num").isNull()
    return {
        "required_values_present": _filled("poll_id", "pollster", "office", "geography_id", "population", "mode", "source_url"),
        "dates_valid": F.col("field_start") <= F.col("field_end"),
        "sample_size_positive": F.col("sample_size") > 0,
        "major_shares_valid": F.col("dem_pct").between(0, 1) & F.col("rep_pct").between(0, 1) & F.col("two_party_dem_share").between(0, 1) & (F.col("dem_pct") + F.col("rep_pct") > 0),
        "house_effect_valid": F.col("house_effect_dem").between(-0.20, 0.20),
        "population_known": F.col("population").isin(list(populations)),
        "state_known": F.col("state_po").isin(list(states)) | national,
        "publication_valid": F.col("published_on") >= F.col("field_end"),
        "source_urls_present": F.col("source_url").rlike("^https?://"),
    }


def research_panel() -> dict[str, Column]:
    """Polls of the lean study; per race the facts that must not vary are checked by ``checks.depends_only_on``."""
    return {
        "poll_before_election": F.col("poll_date") < F.col("election_date"),
        "shares_valid": F.col("poll_dem_share").between(0, 1) & F.col("actual_dem_share").between(0, 1) & F.col("pred_dem_share").between(0, 1),
        "sigma_positive": F.col("resid_sigma") > 0,
        "trained_before": F.col("train_through") < F.col("cycle"),
        "lean_from_before": F.col("lean_reference_cycle") < F.col("cycle"),
    }


#: Facts of a race that all of its polls must agree on.
RACE_FACTS = ("cycle", "office", "state_po", "election_date", "actual_dem_share", "actual_dem_win", "lean", "lean_reference_cycle", "pred_dem_share", "resid_sigma", "train_through", "lean_basis")


#: Rounds of a result, and the parties of a stated winner.
ROUNDS = ("general", "first_round", "runoff", "rcv_final")
WINNERS = ("", "DEMOCRAT", "REPUBLICAN", "OTHER")


def specials(offices: Sequence[str], formats: Sequence[str], least_votes: int, as_of: str) -> dict[str, Column]:
    """Special elections; their key is special_id, and SEAT is the key of the included rows.

    Only rows that are included need sources, votes of both parties and a baseline; an exclusion needs its reason.
    """
    included = F.coalesce("include_in_metric", F.lit(False))
    if_included = lambda test: ~included | F.coalesce(test, F.lit(False))
    votes = lambda c: F.coalesce(c, F.lit(0))
    held, updated = iso_date(F.col("election_date")), iso_date(F.col("results_updated_on"))
    return {
        "source_url_present": if_included(_filled("source_url")),
        "retrieved_on_present": if_included(_filled("retrieved_on")),
        "baseline_source_present": if_included(_filled("baseline_source")),
        "date_valid": held.isNotNull() & (held <= F.lit(as_of).cast("date")),
        "update_valid": ~_filled("results_updated_on") | updated.isNotNull(),
        "update_after_election": updated.isNull() | (updated >= held),
        "office_known": F.lower(F.trim("office")).isin(list(offices)),
        "votes_nonnegative": (votes("dem_votes") >= 0) & (votes("rep_votes") >= 0),
        "total_plausible": if_included(votes("dem_votes") + votes("rep_votes") + votes("other_votes") >= least_votes),
        "both_parties": if_included((F.col("dem_votes") > 0) & (F.col("rep_votes") > 0)),
        "format_known": F.lower(F.trim(F.coalesce("contest_format", F.lit("unknown")))).isin(list(formats)),
        "exclusion_explained": included | _filled("exclusion_reason"),
        "baseline_in_unit_interval": _share("baseline_dem_share"),
        "baseline_present": if_included(F.col("baseline_dem_share").isNotNull()),
    }


SEAT = ("state_po", "office", "district")


def snapshot(states: Sequence[str]) -> dict[str, Column]:
    """Dated results of House and Senate; their key is (state_po, office, district_num)."""
    office, place = F.lower(F.trim("office")), F.upper(F.trim("state_po"))
    whole = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) % 1 == 0), F.lit(False))
    turn = F.coalesce("election_round", F.lit("general"))
    louisiana = (place == "LA") & (office == "us_house")
    address = F.try_parse_url("source_url", F.lit("PROTOCOL"))
    return {
        "state_known": place.isin([s for s in states if s not in ("DC", "PR")]),
        "office_known": office.isin("us_house", "us_senate"),
        "winner_known": F.upper(F.trim(F.coalesce("winner_party", F.lit("")))).isin(list(WINNERS)),
        "votes_are_counts": whole("dem_votes") & whole("rep_votes") & whole("other_votes"),
        "source_url_valid": F.coalesce(address.isin("http", "https") & F.try_parse_url("source_url", F.lit("HOST")).isNotNull(), F.lit(False)),
        "retrieved_on_iso_date": iso_date(F.col("retrieved_on").cast("string")).isNotNull(),
        "certified_stated": F.col("certified").isNotNull(),
        "round_known": turn.isin(list(ROUNDS)),
        "louisiana_round": ~louisiana | turn.isin("first_round", "runoff"),
        "louisiana_resolved_stated": ~louisiana | F.col("outcome_resolved").isNotNull(),
        "district_for_house": (office != "us_house") | whole("district_num"),
    }


def plan_register(statuses: Sequence[str], risks: Sequence[str]) -> dict[str, Column]:
    """Districting plans; overlaps and coverage are ``joins.overlapping`` and ``checks.covered_once``."""
    return {
        "status_known": F.col("status").isin(list(statuses)),
        "risk_known": F.col("litigation_risk").isin(list(risks)),
        "cycles_in_order": F.col("last_cycle").isNull() | (F.col("first_cycle") <= F.col("last_cycle")),
        "source_present": _filled("source_url", "retrieved_on"),
        "verified": _filled("verified_by"),
    }


def crosswalk(methods: Sequence[str]) -> dict[str, Column]:
    matched = F.col("candidate_id").isNotNull()
    return {"method_known": F.col("match_method").isin(list(methods)) | F.col("match_method").rlike("^(state|ambiguous)_"), "ambiguous_unmatched": ~(matched & F.col("match_method").startswith("ambiguous"))}


#: What a filing can say of an incumbent, and what it can't.
FILING_STATUSES = ("filed", "not_found", "unknown", "nominated", "withdrawn")
UNSUPPORTED = ("nominated", "withdrawn")


def filings() -> dict[str, Column]:
    """Resolved filings: statuses that no filing supports must not appear, and all but ``unknown`` say where they come from."""
    status = F.col("incumbent_status")
    return {
        "status_known": status.isin(*FILING_STATUSES),
        "no_unsupported_claims": ~status.isin(*UNSUPPORTED),
        "evidence_present": (status == "unknown") | _filled("incumbent_status_evidence"),
        "filed_has_id": (status != "filed") | F.col("incumbent_candidate_id").isNotNull(),
    }


#: The key of ``fundraising``.
FUNDRAISING_KEY = ("cycle", "office", "state_po", "district_num")


def fundraising(slack: float = 1e-6) -> dict[str, Column]:
    """Receipts of a seat's parties and top filers, with the share and smoothed ratio made from them."""
    least = lambda *columns: F.least(*(F.col(c) for c in columns))
    known = lambda *columns: F.forall(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    receipts = ("dem_receipts", "rep_receipts", "dem_top_receipts", "rep_top_receipts")
    ratio = F.col("log_receipt_ratio")
    return {
        "receipts_nonnegative": known(*receipts) & (least(*receipts) >= 0),
        "top_within_party_total": (F.col("dem_top_receipts") <= F.col("dem_receipts") + slack) & (F.col("rep_top_receipts") <= F.col("rep_receipts") + slack),
        "share_in_unit_interval": F.col("dem_receipt_share").between(0, 1),
        "ratio_finite": ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) < float("inf")),
        "unusable_explained": F.col("usable") | _filled("unusable_reason"),
    }


def demographics(states: Sequence[str], numbers: Sequence[str], rates: Sequence[str]) -> dict[str, Column]:
    """Features of states; their key is geoid."""
    rate = F.lit(True)
    for c in rates:
        rate &= F.col(c).between(0, 1)
    return {
        "state_fips_known": F.col("state_fips").isin(list(states)),
        "no_required_nulls": _filled("geoid", "state_fips", *numbers, *rates),
        "positive_population": F.col("total_population") > 0,
        "rates_in_range": rate,
    }


#: The key of ``ballots``.
BALLOT_KEY = ("office", "district_num", "candidate_name", "party")


def ballots(state: str) -> dict[str, Column]:
    """Candidates of one state's ballot; ``ballot_coverage`` says whether all its races are there."""
    return {"one_state": F.col("state_po") == state, "facts_present": _filled("state_po", "office", "district_num", "candidate_name", "party", "source_url")}


def ballot_coverage(rows: DataFrame, house_seats: int, senate_seats: int) -> DataFrame:
    """One row: whether the districts are exactly 1 to ``house_seats`` (0 for a single one) and the Senate races as many as expected."""
    expected = [0] if house_seats == 1 else list(range(1, house_seats + 1))
    races = rows.select("office", F.col("district_num").cast("int").alias("d")).distinct()
    house = F.col("office") == "us_house"
    one = races.agg(F.count_if(house & F.col("d").isin(expected)).alias("n_house"), F.count_if(house & ~F.coalesce(F.col("d").isin(expected), F.lit(False))).alias("n_other"), F.count_if(F.col("office") == "us_senate").alias("n_senate"))
    return one.select(((F.col("n_house") == len(expected)) & (F.col("n_other") == 0) & (F.col("n_senate") == senate_seats)).alias("passed"), "n_house", "n_other", "n_senate")


def catalog(statuses: Sequence[str], access: Sequence[str], tested: Sequence[str]) -> dict[str, Column]:
    """Result sources, one per state: their key is state_po, and ``covers`` says whether all states are there."""
    return {
        "provenance_present": _filled("state_po", "primary_url", "fallback_url", "extraction_status", "certification_evidence"),
        "primary_is_https": https_host(F.col("primary_url")).isNotNull(),
        "fallback_is_https": https_host(F.col("fallback_url")).isNotNull(),
        "status_known": F.col("extraction_status").isin(list(statuses)),
        "access_known": F.when(_filled("download_access"), F.col("download_access")).otherwise("untested").isin(list(access)),
        "tested_has_evidence": ~F.col("extraction_status").isin(list(tested)) | _filled("extraction_evidence"),
    }


def covers(rows: DataFrame, key: str, expected: Sequence[str]) -> DataFrame:
    """One row: whether ``key`` takes exactly the expected values, how many of them are missing, and how many others there are."""
    known = F.col(key).isin(list(expected))
    out = rows.agg((F.lit(len(set(expected))) - F.countDistinct(F.when(known, F.col(key)))).alias("n_missing"), F.countDistinct(F.when(~known, F.col(key))).alias("n_other"))
    return out.select(((F.col("n_missing") == 0) & (F.col("n_other") == 0)).alias("passed"), "n_missing", "n_other")
