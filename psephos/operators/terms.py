"""Effective-dated terms of office, the races of a cycle with their holders, and the table of cycles.

Contests and appointments become intervals of office-holding. Per seat they are sorted once: a later start cuts what runs,
a departure cuts it to a vacancy, intervals of one holder that touch are one, and what no interval covers is named. The
result covers every seat once per day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import election_day, plan_era
from .windows import even_period, latest

#: Terms begin on this day of the year behind the election (month, day).
OFFICE_DAY = (1, 3)
#: Which source holds where several begin on one day, first to last.
SOURCES = ("regular", "special", "appointed")


def office_day(year: Column) -> Column:
    return F.make_date(year, *map(F.lit, OFFICE_DAY))


def contest_terms(contests: DataFrame, years: int | Column) -> DataFrame:
    """(seat, holder, party, source, valid_from, valid_until) from won contests.

    ``contests``: seat, held_on, source (see ``SOURCES``), holder, party, takes_office. A regular contest gives a term of
    ``years`` from the office day behind its cycle. Any other gives what is left of the regular term in which it takes
    office (by default the day it is held), to no known end where there is none.
    """
    regular = contests.where("source = 'regular'")
    begins = office_day(even_period(F.year("held_on")) + 1)
    full = regular.select("seat", "holder", "party", "source", begins.alias("valid_from"), F.add_months(begins, F.lit(12) * years).alias("valid_until"))
    starts = contests.where("source <> 'regular'").select("seat", "holder", "party", "source", F.coalesce("takes_office", "held_on").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"))
    both = full.unionByName(starts)
    # The regular term that runs when the other begins, carried to it in the order of starts.
    before = Window.partitionBy("seat").orderBy("valid_from", F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))).rowsBetween(Window.unboundedPreceding, 0)
    running = F.last(F.when(F.col("source") == "regular", F.col("valid_until")), ignorenulls=True).over(before)
    rest = F.when(running > F.col("valid_from"), running)
    return both.withColumn("_rest", rest).withColumn("valid_until", F.when(F.col("source") == "regular", F.col("valid_until")).otherwise(F.col("_rest"))).drop("_rest")


def effective(terms: DataFrame, departures: DataFrame, start: str, end: str, seats: DataFrame | None = None) -> DataFrame:
    """Each seat's days from ``start`` to before ``end``, once: seat, holder, party, source, valid_from, valid_until, status, n_terms.

    ``terms`` as of ``contest_terms``; ``departures``: seat, left_on. status is held, vacant (behind a departure) or
    unknown (no term covers the days); gaps have no holder. Of several terms that begin on one day the first source
    holds, then the smaller holder. ``seats`` adds seats of which nothing is known.
    """
    first, last = (F.lit(d).cast("date") for d in (start, end))
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    one = latest(terms.where("valid_from is not null").withColumn("_rank", rank), ["seat", "valid_from"], [F.asc("_rank"), F.asc("holder"), F.asc("party")])
    events = one.select("seat", F.col("valid_from").alias("day"), F.lit(1).alias("_kind"), F.struct("holder", "party", "source", "valid_until").alias("t"))
    gone = departures.where("left_on is not null").select("seat", F.col("left_on").alias("day"), F.lit(0).alias("_kind")).distinct().withColumn("t", F.lit(None).cast(events.schema["t"].dataType))
    # Departures stand before terms of their day, so they end what ran before.
    ahead = Window.partitionBy("seat").orderBy("day", "_kind").rowsBetween(1, Window.unboundedFollowing)
    ends = lambda kind: F.min(F.when(F.col("_kind") == kind, F.col("day"))).over(ahead)
    cut = events.unionByName(gone).withColumns({"_next": ends(1), "_left": ends(0)}).where("_kind = 1")
    # No term goes past the next; least() skips what is unknown.
    until = F.least("t.valid_until", "_next", "_left", last)
    held = cut.select("seat", "t.holder", "t.party", "t.source", F.greatest("day", first).alias("valid_from"), until.alias("valid_until"), (F.col("_left") <= F.least(F.col("t.valid_until"), F.col("_next"), last)).alias("_departed"))
    held = held.where("valid_from < valid_until")
    # Touching terms of one holder are one.
    order = Window.partitionBy("seat").orderBy("valid_from")
    fresh = F.when((F.lag("valid_until").over(order) == F.col("valid_from")) & F.lag("holder").over(order).eqNullSafe(F.col("holder")), 0).otherwise(1)
    runs = held.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order))
    spells = runs.groupBy("seat", "_run").agg(
        F.min("valid_from").alias("valid_from"), F.max("valid_until").alias("valid_until"), F.count("*").cast("bigint").alias("n_terms"),
        F.min_by(F.struct("holder", "party", "source"), "valid_from").alias("m"), F.max_by("_departed", "valid_from").alias("_departed"),
    )
    known = spells.select("seat", "m.*", "valid_from", "valid_until", F.lit("held").alias("status"), "n_terms", "_departed")
    # Gaps: behind each spell up to the next, and before the first.
    behind = known.withColumn("_to", F.coalesce(F.lead("valid_from").over(order), last)).where("valid_until < _to")
    none = [F.lit(None).cast("string").alias(c) for c in ("holder", "party", "source")]
    gap = lambda df, a, b, status: df.select("seat", *none, a.alias("valid_from"), b.alias("valid_until"), status.alias("status"), F.lit(0).cast("bigint").alias("n_terms"))
    gaps = gap(behind, F.col("valid_until"), F.col("_to"), F.when(F.col("_departed"), "vacant").otherwise("unknown"))
    begins = known.groupBy("seat").agg(F.min("valid_from").alias("_from"))
    every = begins.select("seat") if seats is None else seats.select("seat").unionByName(begins.select("seat")).distinct()
    early = gap(every.join(begins, "seat", "left").withColumn("_from", F.coalesce("_from", last)).where(F.col("_from") > first), first, F.col("_from"), F.lit("unknown"))
    return known.drop("_departed").unionByName(gaps).unionByName(early)


def holder_on(terms: DataFrame, day: Column) -> DataFrame:
    """The row of each seat that covers a day."""
    return terms.where((F.col("valid_from") <= day) & (day < F.col("valid_until")))


def up_states(returns: DataFrame, cycle: Column | int, years: int) -> DataFrame:
    """(state, cycle) of the seats of an office whose regular contest was exactly one term before; special contests don't count."""
    regular = returns.where(~F.coalesce(F.col("special"), F.lit(False)))
    return regular.select("state", (F.col("cycle") + years).alias("cycle")).where(F.col("cycle") == cycle).where("state is not null").distinct()


def cycle_table(returns: DataFrame, cycles: DataFrame, house_seats: int, senate_years: int = 6) -> DataFrame:
    """Each cycle by office: election_date, jurisdiction, election_type, seats and coverage.

    ``returns``: office, cycle, state, special; ``cycles``: cycle. Senate seats are those whose class was up a term
    before; governors are out of coverage.
    """
    up = returns.where("office = 'us_senate'").where(~F.coalesce(F.col("special"), F.lit(False))).groupBy((F.col("cycle") + senate_years).alias("cycle")).agg(F.count_distinct("state").alias("_up"))
    known = cycles.select("cycle").distinct().join(up, "cycle", "left").withColumn("_up", F.coalesce("_up", F.lit(0)))
    held = F.col("cycle") % 4 == 0
    row = lambda office, where, kind, seats, coverage: F.struct(F.lit(office).alias("office"), F.lit(where).alias("jurisdiction"), kind.alias("election_type"), seats.cast("bigint").alias("seats"), coverage.alias("coverage"))
    rows = F.array(
        row("us_house", "nation", F.lit("regular"), F.lit(house_seats), F.lit("covered")),
        row("us_senate", "nation", F.lit("regular"), F.col("_up"), F.when(F.col("_up") > 0, "covered").otherwise("no_prior_class_data")),
        row("president", "nation", F.when(held, "regular").otherwise("not_held"), held.cast("int"), F.when(held, "covered").otherwise("not_held")),
        row("governor", "states", F.lit("regular"), F.lit(None), F.lit("out_of_coverage")),
    )
    return known.select("cycle", election_day(F.col("cycle")).alias("election_date"), F.explode(rows).alias("r")).select("cycle", "election_date", "r.*")


def race_universe(seats: DataFrame, terms: DataFrame, results: DataFrame, cycle: int, years: Mapping[str, int], specials: DataFrame | None = None, boundaries: DataFrame | None = None) -> DataFrame:
    """One row per seat on the ballot of ``cycle``, with its holder on election day and its last known share.

    ``seats``: seat, office, state, district. ``terms``: of ``effective``. ``results``: seat, office, cycle, special,
    winner, winner_party, share. Seats of an office whose term (``years``) is two years are all up, others where their
    last regular contest was exactly a term before; ``specials`` (seat) are up out of turn. A seat that is vacant or whose days
    are unknown takes the latest earlier regular winner, with that source. ``boundaries``: state, boundary_confidence,
    litigation_risk; without them districts are ``unverified``.
    """
    day = election_day(F.lit(cycle))
    regular = results.where(~F.coalesce(F.col("special"), F.lit(False)) & (F.col("cycle") < cycle))
    term = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in years.items() for x in kv)), F.col("office")), F.lit(0))
    exact = regular.where(F.col("cycle") == cycle - term).select("seat").distinct().withColumn("_exact", F.lit(True))
    out_of_turn = (specials.select("seat").distinct() if specials is not None else seats.select("seat").limit(0)).withColumn("_special", F.lit(True))
    up = seats.join(exact, "seat", "left").join(out_of_turn, "seat", "left").where((term == 2) | F.col("_exact") | F.col("_special"))
    kind = F.when(F.col("_exact") | (term == 2), "regular").otherwise("special")
    now = holder_on(terms, day).select("seat", "holder", F.col("party").alias("_party"), "source", "status")
    before = latest(regular, ["seat"], [F.desc("cycle"), F.asc("winner")]).select("seat", F.col("winner").alias("_winner"), F.col("winner_party").alias("_winner_party"), F.col("cycle").alias("last_contested_cycle"))
    prior = latest(results.where((F.col("cycle") < cycle) & F.col("share").isNotNull()), ["seat"], [F.desc("cycle"), F.asc("share")]).select("seat", F.col("share").alias("prior_dem_share"), F.col("cycle").alias("_prior"))
    joined = up.join(now, "seat", "left").join(before, "seat", "left").join(prior, "seat", "left")
    held = F.col("status") == "held"
    district = F.col("office") == "us_house"
    if boundaries is None:
        joined = joined.withColumns({"boundary_confidence": F.lit(None).cast("string"), "litigation_risk": F.lit(None).cast("string")})
    else:
        joined = joined.join(boundaries.select("state", "boundary_confidence", "litigation_risk"), "state", "left")
    return joined.select(
        F.concat_ws("_", F.lit(str(cycle)), F.lower("office"), F.lower("state"), F.when(district, F.lpad(F.col("district").cast("string"), 2, "0"))).alias("race_key"),
        F.lit(cycle).alias("cycle"), day.alias("election_date"), "office", kind.alias("election_type"), "state", "district", "seat", "last_contested_cycle",
        F.when(held, F.col("holder")).otherwise(F.col("_winner")).alias("incumbent_name"),
        F.when(held, F.col("_party")).otherwise(F.col("_winner_party")).alias("incumbent_party"),
        F.lit("unknown").alias("incumbent_status"),
        F.when(held, F.concat(F.col("source"), F.lit("_term"))).when(F.col("_winner").isNotNull(), F.concat(F.lit("earlier_regular_winner_"), F.coalesce("status", F.lit("unknown")))).otherwise("none").alias("incumbent_source"),
        "prior_dem_share",
        F.when(F.col("_prior").isNotNull(), F.concat(F.lit("last_result_"), F.col("_prior").cast("string"))).otherwise("none").alias("prior_source"),
        F.when(district, F.coalesce("boundary_confidence", F.lit("unverified"))).otherwise("n/a").alias("boundary_confidence"),
        F.coalesce("litigation_risk", F.lit("none")).alias("litigation_risk"),
        plan_era(F.lit(cycle)).alias("plan_era"),
    )


def coverage(universe: DataFrame, by: Sequence[str] = ("office", "incumbent_source", "boundary_confidence")) -> DataFrame:
    """(measure, value, n): seats in all, with a known holder, with a prior, of unresolved party, and by each column of ``by``."""
    flags = {"seats_total": F.lit(True), "incumbent_known": F.col("incumbent_name").isNotNull(), "prior_known": F.col("prior_dem_share").isNotNull(), "party_unresolved": F.col("incumbent_party") == "OTHER"}
    every = F.array(*(F.struct(F.lit(k).alias("measure"), F.when(v, "yes").alias("value")) for k, v in flags.items()), *(F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c), F.lit("null")).alias("value")) for c in by))
    return universe.select(F.explode(every).alias("m")).where("m.value is not null").groupBy("m.measure", "m.value").agg(F.count("*").alias("n"))
