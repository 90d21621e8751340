"""Seats: incumbency, fallbacks for seats without a model, forward projection with boundary routing, scheduled rosters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters


def incumbency(winners: DataFrame, rosters: DataFrame, seat: str, cycle: str, winner: str, candidate: str, term: int, broken: Column | None = None) -> DataFrame:
    """Per contest: the winner one term before in the seat, if no boundary break, and whether they run again, won, or left it open.

    ``rosters`` has (seat, cycle, candidate). Names are compared by their letters.
    """
    keyed = winners.withColumn("_w", letters(F.col(winner)))
    prior = winners.select(seat, (F.col(cycle) + term).alias(cycle), F.col(winner).alias("incumbent_name"))
    names = rosters.groupBy(seat, cycle).agg(F.collect_set(letters(F.col(candidate))).alias("_names"))
    joined = keyed.join(prior, [seat, cycle], "left").join(names, [seat, cycle], "left")
    usable = F.col("incumbent_name").isNotNull() & ~(broken if broken is not None else F.lit(False))
    key = letters(F.col("incumbent_name"))
    running = usable & (key != "") & F.coalesce(F.array_contains("_names", key), F.lit(False))
    return joined.select(
        *winners.columns,
        F.when(usable, F.col("incumbent_name")).alias("incumbent_name"),
        F.col("incumbent_name").isNotNull().alias("prior_available"),
        running.alias("incumbent_running"),
        (usable & ~running).alias("open_seat"),
        (running & (F.col("_w") == key)).alias("incumbent_won"),
    )


def seat_universe(seats: DataFrame, model: str, prior: str, recent: str, sigma: str, sigma_model: float, multiplier: float = 2.0) -> DataFrame:
    """Mean, sigma and source of every seat: model, else prior, else recent result, the latter two with a wider sigma."""
    source = F.when(F.col(model).isNotNull(), "model").when(F.col(prior).isNotNull(), "partisanship_prior").otherwise("recent_result")
    out = seats.withColumns({"source": source, "mean_share": F.coalesce(model, prior, recent)})
    wide = F.when(F.col("source") == "model", F.coalesce(F.col(sigma), F.lit(sigma_model))).otherwise(sigma_model * multiplier)
    return out.withColumn("sigma", wide).where("mean_share is not null")


def project(seats: DataFrame, boundary: str, old_prior: str, transferred: str, transfer_sigma: str, state_lean: str, national_then: float, national_now: Column, intercept: float, beta: float, gamma: float, sigma: float, state_sd: float) -> DataFrame:
    """Shares from a lean model by how sure the boundary is: unchanged, transferred, redrawn (state's lean), unverified.

    A redrawn seat's own last result is not used. The lean's own uncertainty adds in quadrature, times its coefficient.
    Seats without any lean are left out.
    """
    redrawn = F.col(boundary) == "redrawn"
    has_transfer = redrawn & F.col(transferred).isNotNull()
    fallback = redrawn & F.col(transferred).isNull()
    lean = F.when(has_transfer, F.col(transferred) - national_then).when(fallback, F.col(state_lean)).otherwise(F.col(old_prior) - national_then)
    source = F.when(F.col("lean").isNull(), "no_prior_result").when(has_transfer, "model_transferred").when(fallback, "fallback_state_lean").when(F.col(boundary) == "unverified", "model_unverified").otherwise("model")
    own = F.when(has_transfer, F.hypot(F.lit(sigma), beta * F.col(transfer_sigma))).when(fallback, F.hypot(F.lit(sigma), F.lit(beta * state_sd))).otherwise(sigma)
    mean = F.lit(intercept) + beta * F.col("lean") + gamma * national_now
    out = seats.withColumn("lean", lean).withColumns({"source": source, "sigma": own, "mean_share": F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))})
    return out.where("lean is not null")


def refused(seats: DataFrame, boundary: str, allowed: Sequence[str]) -> DataFrame:
    """``seats`` that raises, when it is run, on a boundary status that is not allowed."""
    ok = F.coalesce(F.col(boundary).isin(list(allowed)), F.lit(False))
    return seats.withColumn(boundary, F.when(ok, F.col(boundary)).otherwise(F.raise_error(F.concat(F.lit("boundary status not allowed: "), F.coalesce(F.col(boundary), F.lit("null"))))))


def scheduled(roster: DataFrame, seat_class: str, cycle: int, total: int) -> DataFrame:
    """One row per party: seats up in ``cycle`` by class, seats held over, and whether all add up to ``total``."""
    up = F.col(seat_class) == {2: 1, 4: 2, 0: 3}[cycle % 6]
    out = roster.groupBy("party").agg(F.count_if(up).alias("up"), F.count_if(~up).alias("held_over"))
    whole = roster.agg((F.count("*") == total).alias("complete"))
    return out.crossJoin(F.broadcast(whole))  # one row


def regional_scenario(seats: DataFrame, swings: DataFrame, region: str, share: str, excess: str, factor: float) -> DataFrame:
    """Shares moved by ``factor`` times their region's excess swing, in [0, 1]; regions without one stay."""
    moved = F.col(share) + factor * F.coalesce(F.col(excess), F.lit(0.0))
    return seats.join(swings.select(region, excess), region, "left").withColumn("scenario_share", F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).drop(excess)


def precision_band(centre: float, low: float, high: float, steps: int) -> list[tuple[int, float]]:
    """Evenly spaced assumptions from low to high around a centre, as (number, value)."""
    return [(k, centre + low + (high - low) * k / max(1, steps - 1)) for k in range(steps)]


def under_each(df: DataFrame, assumptions: Sequence[tuple[int, float]], name: str = "national") -> DataFrame:
    """Every row under every assumption: (assumption, value) are literals, so nothing is shuffled."""
    each = F.array(*(F.struct(F.lit(k).alias("assumption"), F.lit(v).alias(name)) for k, v in assumptions))
    return df.withColumn("_a", F.explode(each)).select(*df.columns, "_a.*")
