"""Composites of forecasting: panels, national history, gates, bands, sealed forecasts, roster status, demographics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from . import allocation, matching, polls, reconcile, regression
from .panels import weighted_mean
from .windows import guarded_lag


def contest_panel(rows: DataFrame, unit: Sequence[str], cycle: str, share: str, weight: str, gap: int) -> DataFrame:
    """Rows with their own and the national share of the cycle before, if it lies exactly ``gap`` earlier."""
    national = rows.groupBy(cycle).agg(weighted_mean(F.col(share), F.col(weight)).alias("national_share"))
    lagged = guarded_lag(rows, unit, cycle, [share], gap)
    before = national.select((F.col(cycle) + gap).alias(cycle), F.col("national_share").alias("lag_national_share"))
    return lagged.join(national, cycle, "left").join(before, cycle, "left").withColumn("lag_lean", F.col(f"lag_{share}") - F.col("lag_national_share"))


def national_history(history: DataFrame, cycle: str, national: str, sign: str) -> DataFrame:
    """(cycle, forecast) from earlier cycles only: the last share, plus the mean earlier swing of the same non-zero sign.

    ``history`` may have many rows per cycle; each cycle counts once. The first cycle has no forecast.
    """
    one = history.groupBy(cycle).agg(F.min(national).alias("_n"), F.min(sign).alias("_s"))
    w = Window.orderBy(cycle)  # a row per cycle
    steps = one.withColumns({"_last": F.lag("_n").over(w), "_swing": F.col("_n") - F.lag("_n").over(w)})
    earlier = steps.select(F.col(cycle).alias("_c"), F.col("_s").alias("_t"), F.col("_swing").alias("_w"))
    same = steps.join(earlier, (F.col("_c") < F.col(cycle)) & (F.col("_t") == F.col("_s")) & (F.col("_s") != 0), "left")
    out = same.groupBy(cycle, "_last").agg(F.coalesce(F.avg("_w"), F.lit(0.0)).alias("_m")).where("_last is not null")
    return out.select(cycle, regression.clipped(F.col("_last") + F.col("_m")).alias("forecast"))


def specification_gate(scores: DataFrame, name: str, baseline: str, lower: Sequence[str], coverage: str, order: str, slack: float = 0.02) -> DataFrame:
    """A row per specification: failed (what keeps it from promotion), promoted, and selected (the last promoted one in ``order``, else the baseline).

    One is promoted if it is lower than the baseline in all of ``lower``, known on both sides, and loses at most ``slack`` coverage.
    """
    base = scores.where(F.col(name) == baseline).select(*(F.col(c).alias(f"_b_{c}") for c in (*lower, coverage)))
    both = scores.crossJoin(F.broadcast(base))  # one row
    tests = [F.when(~F.coalesce(F.col(c) < F.col(f"_b_{c}"), F.lit(False)), F.lit(c)) for c in lower]
    tests.append(F.when(~F.coalesce(F.col(coverage) >= F.col(f"_b_{coverage}") - slack, F.lit(False)), F.lit(coverage)))
    failed = F.when(F.col(name) != baseline, F.array_compact(F.array(*tests))).otherwise(F.array().cast("array<string>"))
    judged = both.withColumn("failed", failed).withColumn("promoted", (F.col(name) != baseline) & (F.size("failed") == 0))
    best = judged.agg(F.coalesce(F.max_by(F.when(F.col("promoted"), F.col(name)), F.when(F.col("promoted"), F.col(order))), F.lit(baseline)).alias("_best"))
    return judged.crossJoin(F.broadcast(best)).select(*scores.columns, "failed", "promoted", (F.col(name) == F.col("_best")).alias("selected"))  # one row


def national_definitions(races: DataFrame, keys: Sequence[str], first: str, second: str, total: str, uncontested: str) -> DataFrame:
    """(keys, definition, share): the national share as the ratio of all two-party votes, of contested ones, and as the mean of contested races' shares weighed by all their votes."""
    a, b = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in (first, second))
    open_ = ~F.coalesce(F.col(uncontested), F.lit(False))
    ratio = lambda test: F.sum(F.when(test, a)) / F.nullif(F.sum(F.when(test, a + b)), F.lit(0.0))
    known = open_ & (a + b > 0) & F.col(total).isNotNull()
    weighed = F.sum(F.when(known, a / F.nullif(a + b, F.lit(0.0)) * F.col(total))) / F.nullif(F.sum(F.when(known, F.col(total))).cast("double"), F.lit(0.0))
    sums = races.groupBy(*keys).agg(ratio(F.lit(True)).alias("all_races_ratio"), ratio(open_).alias("contested_ratio"), weighed.alias("contested_weighted_mean"))
    return sums.unpivot(list(keys), ["all_races_ratio", "contested_ratio", "contested_weighted_mean"], "definition", "share")


def chronological(df: DataFrame, features: Sequence[str], target: str, cycle: str, national: str, sign: str, least: int = 4) -> DataFrame:
    """Rows predicted from earlier cycles only, the national share too: pred, sigma, train_through.

    The national share of a cycle is ``national_history``'s forecast; sigma is widened by the spread of at least three earlier
    errors of it, times its slope. Rows without all features or with a target outside (0, 1) take no part.
    """
    known = df.where(F.forall(F.array(*(F.col(c).cast("double") for c in (*features, target))), lambda x: x.isNotNull() & ~F.isnan(x)) & (F.col(target) > 0) & (F.col(target) < 1))
    fits = regression.fits_before(known, features, target, cycle, least)
    if not fits:
        kinds = dict(df.dtypes)
        return df.where("false").select(*df.columns, *(F.lit(None).cast(t).alias(c) for c, t in (("pred", "double"), ("sigma", "double"), ("train_through", kinds[cycle]))))
    kind = dict(df.dtypes)[cycle]
    rows = [(c, [float(b) for b in fit.coefficients], float(fit.sigma), before) for c, (fit, before) in fits.items()]
    fitted = df.sparkSession.createDataFrame(rows, f"{cycle} {kind}, _b array<double>, _sigma double, train_through {kind}")  # a row per cycle
    steps = fitted.join(national_history(df, cycle, national, sign), cycle).join(known.groupBy(cycle).agg(F.min(national).alias("_true")), cycle)
    order = Window.orderBy(cycle).rowsBetween(Window.unboundedPreceding, -1)
    error = F.col("forecast") - F.col("_true")
    spread = F.when(F.count(error).over(order) >= 3, F.stddev_samp(error).over(order)).otherwise(0.0)
    steps = steps.withColumn("_spread", spread).drop("_true")
    model = F.col("_b")[0]
    for k, name in enumerate(features):
        model = model + F.col("_b")[k + 1] * (F.col("forecast") if name == national else F.col(name))
    slope = F.abs(F.col("_b")[1 + list(features).index(national)])
    out = known.join(F.broadcast(steps), cycle)
    return out.select(*df.columns, model.alias("pred"), F.hypot(F.col("_sigma"), slope * F.col("_spread")).alias("sigma"), "train_through")


def shrinkage_bounds(pairs: DataFrame, specials: str, general: str, least: int = 3) -> DataFrame:
    """One row: the smallest and largest ratio of general to special swing over at least ``least`` pairs, else nulls."""
    ratio = F.col(general) / F.nullif(specials, F.lit(0.0))
    out = pairs.agg(F.count(ratio).alias("n_pairs"), F.min(ratio).alias("low"), F.max(ratio).alias("high"))
    enough = F.col("n_pairs") >= least
    return out.select("n_pairs", F.when(enough, "bound").otherwise("insufficient").alias("status"), F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def overperformance(specials: DataFrame, first: str, second: str, baseline_share: str, baseline_votes: str) -> DataFrame:
    """Two-party share and margin of a special contest, its margin over the baseline's, and turnout against the baseline."""
    a, b = (F.coalesce(F.col(c), F.lit(0)) for c in (first, second))
    two = F.nullif(a + b, F.lit(0))
    margin = (a - b) / two
    return specials.withColumns(
        {
            "special_share": a / two,
            "special_margin": margin,
            "overperformance": margin - (2 * F.col(baseline_share) - 1),
            "turnout_ratio": (a + b) / F.when(F.col(baseline_votes) > 0, F.col(baseline_votes)),
        }
    )


def executive_party(states: DataFrame, votes: DataFrame, cycle: str, state: str, share: str, electors: str) -> DataFrame:
    """Who wins each cycle by electors: first if states of more than half of them are above one half."""
    joined = states.where(F.col(share).isNotNull()).join(votes.select(state, electors), state, "left")
    won = F.sum(F.when(F.col(share) > 0.5, F.coalesce(F.col(electors), F.lit(0))).otherwise(0))
    return joined.groupBy(cycle).agg((won * 2 > F.sum(F.coalesce(F.col(electors), F.lit(0)))).alias("_f")).select(cycle, F.when(F.col("_f"), "first").otherwise("second").alias("party"))


def race_averages(rows: DataFrame, race: str, poll: str, share: str, sample: str, days: str, prior: str, prior_sigma: str, horizon: float, lookback: float, half_life: float = 21.0, floor: float = 0.025, blend_floor: float = 0.02) -> DataFrame:
    """Per race: mean of the polls in the window before the horizon, questions of one poll sharing its weight, its sigma, and the blend with the prior.

    A poll's questions count as one sample: its precision comes from its summed weight and largest sample.
    """
    inside = rows.where(F.col(days).between(horizon, horizon + lookback))
    weight = polls.decay(F.col(days) - horizon, half_life) * F.sqrt(F.col(sample).cast("double"))
    asked = polls.question_weights(inside, race, poll).withColumn("_w", weight * F.col("question_weight"))
    by_poll = asked.groupBy(race, poll).agg(
        F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col(share)).alias("ws"), F.sum(F.col("_w") * F.col(share) * F.col(share)).alias("wss"), F.max(sample).alias("n"), F.count("*").alias("q"), F.min(prior).alias("p"), F.min(prior_sigma).alias("s")
    )
    sums = by_poll.groupBy(race).agg(
        F.sum("w").alias("w"), F.sum("ws").alias("ws"), F.sum("wss").alias("wss"), F.sum(F.col("w") * F.col("w") / F.col("n")).alias("v"), F.count("*").alias("n_polls"), F.sum("q").alias("n_questions"), F.min("p").alias("p"), F.min("s").alias("s")
    )
    mean = F.col("ws") / F.col("w")
    sigma = F.sqrt(F.greatest(F.col("wss") / F.col("w") - mean * mean, F.lit(0.0)) + F.col("v") / (F.col("w") * F.col("w")) * mean * (1 - mean) + floor**2)
    out = sums.select(race, mean.alias("poll_mean"), sigma.alias("poll_sigma"), "n_polls", "n_questions", "p", "s")
    return out.withColumns(polls.blend(F.col("p"), F.col("s"), F.col("poll_mean"), F.col("poll_sigma"), blend_floor)).drop("p", "s")


def allocation_backtest(units: DataFrame, region: Sequence[str], area: str, value: str, weight: str) -> DataFrame:
    """(region, area, actual, allocated, error share): pool known votes to regions and allocate them anew by another weight."""
    known = units.groupBy(*region, area).agg(F.sum(value).alias("actual"), F.sum(weight).alias("_w"))
    pooled = known.groupBy(*region).agg(F.sum("actual").alias("allocated"))
    placed, _ = allocation.allocate(pooled, known.select(*region, area, "_w"), region, area, "allocated", "_w")
    total = F.sum("actual").over(Window.partitionBy(*region))
    return known.drop("_w").join(placed, [*region, area], "left").withColumn("error_share", (F.coalesce("allocated", F.lit(0.0)) - F.col("actual")) / F.nullif(total, F.lit(0.0)))


def transfer_backtest(rows: DataFrame, actual: str, transferred: str, state_lean: str, most_sigma: float) -> DataFrame:
    """One row: mean absolute error and sample sd of a transfer, of no prior (one half) and of the state's lean, and whether the transfer may be used."""
    e = lambda c: c - F.col(actual)
    one = rows.where(F.col(transferred).isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e(F.col(transferred)))).alias("mae"),
        F.stddev_samp(e(F.col(transferred))).alias("sigma"),
        F.avg(F.abs(e(F.lit(0.5)))).alias("mae_no_prior"),
        F.avg(F.abs(e(F.col(state_lean)))).alias("mae_state_lean"),
        F.stddev_samp(e(F.col(state_lean))).alias("sigma_state_lean"),
    )
    ok = (F.col("sigma") <= most_sigma) & (F.col("mae") < F.col("mae_state_lean"))
    return one.withColumn("usable", F.coalesce(ok, F.lit(False)))


def run_difference(run: DataFrame, sealed: DataFrame, key: str, value: str) -> DataFrame:
    """Every contest of either run with both values, their difference and where it is."""
    both = reconcile.outer_status(run.select(key, F.col(value).alias("run")), sealed.select(key, F.col(value).alias("sealed")), [key])
    return both.withColumn("difference", F.col("run") - F.col("sealed"))


def filing_status(seats: DataFrame, roster: DataFrame, row_id: str, name: str, roster_id: str, roster_name: str, seat: Sequence[str], state: Sequence[str], party: str | None = None, roster_party: str | None = None) -> DataFrame:
    """filed, not_found or unknown (no incumbent named) per seat, with the matching method and the evidence. Not found is not retired.

    With ``party`` and ``roster_party``, resolved_party is the seat's own label where it is a party, else the filing's.
    """
    named = seats.where(F.coalesce(F.trim(name), F.lit("")) != "")
    found = matching.seat_then_state(named, roster, row_id, name, roster_id, roster_name, seat, state)
    if party and roster_party:
        found = found.join(roster.select(roster_id, F.col(roster_party).alias("_filed_as")).hint("merge"), roster_id, "left")  # a whole roster looks small to Spark by two columns
    status = F.when(F.col("method").isNull(), "unknown").when(F.col(roster_id).isNotNull(), "filed").otherwise("not_found")
    evidence = F.when(F.col("method").isNull(), "no incumbent identified").when(F.col(roster_id).isNotNull(), F.concat(F.lit("filed as "), F.col(roster_id).cast("string"))).otherwise(F.concat(F.lit("not matched: "), F.col("method")))
    out = seats.join(found.hint("merge"), row_id, "left").withColumns({"incumbent_status": status, "incumbent_status_evidence": evidence})
    if not (party and roster_party):
        return out
    own, filed = text.party(F.col(party)), text.party(F.col("_filed_as"))
    return out.withColumn("resolved_party", F.when(~own.isin("OTHER", "UNKNOWN"), own).otherwise(F.when(F.col("_filed_as").isNotNull(), filed).otherwise("UNKNOWN"))).drop("_filed_as")


def derived_rates(rows: DataFrame, rates: Mapping[str, tuple[str, str]], fips: str) -> DataFrame:
    """Ratios of (numerator, denominator) columns, null without a positive denominator, and the padded code as geoid."""
    ratio = lambda a, b: F.col(a).try_cast("double") / F.when(F.col(b).try_cast("double") > 0, F.col(b).try_cast("double"))
    return rows.withColumns({**{n: ratio(*ab) for n, ab in rates.items()}, "geoid": F.lpad(F.trim(fips), 2, "0")})


def geography_spine(observed: DataFrame, fips: str, district: str) -> DataFrame:
    """(geography_id, level, parent) of the nation and all observed states and districts, once each."""
    from ..functions.text import geography_id

    none = F.lit(None).cast("string")
    spark = observed.sparkSession
    nation = spark.range(1).select(F.lit("nation:us").alias("geography_id"), F.lit("nation").alias("level"), none.alias("parent"))
    states = observed.where(F.col(fips).isNotNull()).select(geography_id(F.col(fips), none).alias("geography_id"), F.lit("state").alias("level"), F.lit("nation:us").alias("parent")).distinct()
    districts = observed.where(F.col(fips).isNotNull() & F.col(district).isNotNull())
    parts = districts.select(geography_id(F.col(fips), F.col(district)).alias("geography_id"), F.lit("district").alias("level"), geography_id(F.col(fips), none).alias("parent")).distinct()
    return nation.unionByName(states).unionByName(parts)


def prepared_archive(rows: DataFrame, checks: Sequence[tuple[str, Column]], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and counts of rejected ones by their first reason; keys that repeat among the accepted are refused as well."""
    marked = rows.withColumn("reason", polls.first_reason(checks))
    accepted = marked.where("reason is null").drop("reason")
    repeats = accepted.groupBy(*key).count().where("count > 1")
    kept, refused = reconcile.split(accepted, repeats.select(*key), key)
    counts = marked.where("reason is not null").groupBy("reason").count().unionByName(refused.groupBy(F.lit("repeated_key").alias("reason")).count())
    return kept, counts
