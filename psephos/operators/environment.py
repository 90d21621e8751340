"""National environment: maps between bases, estimates with their bands and contract, whole-chamber backtests, promotion gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import evaluation, forecasts, joins, polls, regression

Z90 = 1.6448536269514722
FALLBACK_SIGMA = 2.0
#: A band's shrinkage factors, estimators, those that can't be identified, and statuses.
FACTORS = (0.25, 0.5, 0.75, 1.0)
ESTIMATORS = ("specials_band", "generic_ballot", "fundamentals", "scenario")
UNIDENTIFIED = ("specials_band", "scenario")
STATUSES = ("point", "band", "unavailable")


def basis_panel(own: DataFrame, base: DataFrame, unit: Sequence[str], cycle: str, share: str, national: str, uncontested: str, base_share: str, quality: str) -> DataFrame:
    """(unit, cycle, reference, base_lean, own_lean) of contested units with a sound baseline.

    The reference is the mean baseline of the cycle's units, each weighing alike; leans are against it and against ``national``.
    """
    sound = base.where((F.col(quality) == "ok") & F.col(base_share).isNotNull()).select(*unit, cycle, base_share)
    contested = own.where(~F.col(uncontested) & F.col(share).isNotNull() & F.col(national).isNotNull()).select(*unit, cycle, share, national)
    both = contested.join(sound, [*unit, cycle])
    mean = both.groupBy(cycle).agg(F.avg(base_share).alias("reference"))
    return both.join(mean, cycle).select(*unit, cycle, "reference", (F.col(base_share) - F.col("reference")).alias("base_lean"), (F.col(share) - F.col(national)).alias("own_lean"))


def basis_map(panel: DataFrame, cycle: str, least: int = 100) -> DataFrame:
    """One row: intercept, slope, residual_sd, n, mae, loco_sd and raw_mae of own_lean on base_lean; status unfitted below ``least`` rows.

    loco_sd is the sample deviation of the errors of cycles that are predicted from all others, where these have ``least`` rows.
    """
    known = panel.where("base_lean is not null and own_lean is not null")
    fit = regression.solve(regression.grams(known, ["base_lean"], "own_lean").get(None, regression.Gram(np.zeros((3, 3)))), ["base_lean"])
    if fit.n < least:
        return known.agg(F.lit("unfitted").alias("status"), F.count("*").alias("n"))
    held = regression.leave_one_out(known, ["base_lean"], "own_lean", cycle).where(F.col("n_train") >= least)
    loco = held.agg(F.stddev_samp(F.col("own_lean") - F.col("pred")).alias("loco_sd"))
    whole = known.agg(
        F.lit("fitted").alias("status"),
        F.count("*").alias("n"),
        F.lit(float(fit.coefficients[0])).alias("intercept"),
        F.lit(float(fit.coefficients[1])).alias("slope"),
        F.lit(fit.sigma).alias("residual_sd"),
        F.avg(F.abs(F.col("own_lean") - fit.predict())).alias("mae"),
        F.avg(F.abs(F.col("own_lean") - F.col("base_lean"))).alias("raw_mae"),
    )
    return whole.crossJoin(loco)  # one row each


def on_own_basis(share: Column, reference: float, lagged_national: float, intercept: float, slope: float) -> Column:
    """A share on the baseline's basis as one on the own basis, by the map's intercept and slope."""
    return lagged_national + intercept + slope * (share - reference)


def topline_check(toplines: DataFrame, targets: DataFrame, date: str, first: str, second: str, cycle: str, actual: str, month: int = 10, day: int = 20, days: int = 7) -> DataFrame:
    """Per target cycle the last published average within ``days`` up to the cutoff: average_date, prediction and error; cycles without one are left out."""
    cutoff = targets.select(cycle, actual, F.make_date(F.col(cycle), F.lit(month), F.lit(day)).alias("cutoff"))
    dated = toplines.select(F.col(date).alias("average_date"), F.year(date).alias(cycle), (F.col(first) / (F.col(first) + F.col(second))).alias("prediction"))
    near = cutoff.join(dated, cycle).where((F.col("average_date") <= F.col("cutoff")) & (F.col("average_date") >= F.date_sub("cutoff", days)))
    last = near.groupBy(cycle, actual).agg(F.max(F.struct("average_date", "prediction")).alias("_last"))
    return last.select(cycle, "_last.average_date", "_last.prediction", (F.col("_last.prediction") - F.col(actual)).alias("error"))


def generic_ballot(rows: DataFrame, as_of: str, rmse: float | None, share: str, sample: str, pollster: str, ended: str, published: str, population: Column, lookback: int = 60, half_life: float = 21.0) -> DataFrame:
    """One row: status, national_share and sigma of the national polls that were out by ``as_of``; unavailable without any."""
    day = F.lit(as_of).cast("date")
    recent = rows.where((F.col(ended) >= F.date_sub(day, lookback)) & (F.col(ended) <= day) & (F.col(published) <= day)).withColumn("_g", F.lit("nation:us"))
    weight = polls.decay(F.datediff(day, F.col(ended)), half_life) * F.sqrt(F.col(sample).cast("double")) * population
    found = polls.average(recent, ["_g"], share, weight, sample, pollster, max(0.025, rmse or 0.025))
    one = found.agg(F.max("poll_mean").alias("national_share"), F.max("poll_sigma").alias("sigma"), F.coalesce(F.max("n_polls"), F.lit(0)).alias("n_polls"))
    return one.select(F.when(F.col("national_share").isNull(), "unavailable").otherwise("point").alias("status"), "national_share", "sigma", "n_polls")


def specials_band(estimate: DataFrame, mean: str, error: str, baseline: float, factors: Sequence[float] = FACTORS) -> DataFrame:
    """A row per shrinkage factor of a one-row estimate of margins: assumption, swing, national_share and sigma. A margin is half a share."""
    factor = F.explode(F.array(*map(F.lit, factors))).alias("shrinkage")
    swept = estimate.where(F.col(mean).isNotNull()).select(mean, error, factor)
    swing = F.col(mean) * F.col("shrinkage")
    return swept.select(F.concat(F.lit("shrinkage="), F.col("shrinkage").cast("string")).alias("assumption"), "shrinkage", swing.alias("swing"), (baseline + swing / 2).alias("national_share"), (F.abs("shrinkage") * F.col(error) / 2).alias("sigma"))


def contract_error() -> Column:
    """The first rule that an estimate (estimator, status, national_share, n_band, identified, assumption) breaks, or null."""
    c, blank = F.col, F.coalesce(F.trim("assumption"), F.lit("")) == ""
    rules = [
        (~c("estimator").isin(*ESTIMATORS), "unknown_estimator"),
        (~c("status").isin(*STATUSES), "unknown_status"),
        (c("estimator").isin(*UNIDENTIFIED) & c("identified"), "cannot_be_identified"),
        ((c("status") == "band") & c("national_share").isNotNull(), "band_with_single_share"),
        ((c("status") == "band") & (c("n_band") == 0), "empty_band"),
        ((c("status") == "band") & blank, "band_without_assumption"),
        ((c("status") == "band") & c("identified"), "identified_band"),
        ((c("status") == "point") & c("national_share").isNull(), "point_without_share"),
        ((c("status") == "point") & (c("n_band") > 0), "point_with_band"),
        ((c("status") == "point") & ~c("identified") & blank, "point_without_assumption"),
        ((c("status") == "unavailable") & (c("national_share").isNotNull() | (c("n_band") > 0)), "unavailable_with_value"),
    ]
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), name) for test, name in rules))


def projectable() -> Column:
    """Whether a projection may go over an estimate's rows: sound, and a band, an identified point or a scenario."""
    point = (F.col("status") == "point") & (F.col("identified") | (F.col("estimator") == "scenario"))
    return contract_error().isNull() & ((F.col("status") == "band") | point)


def control_conclusion(band: DataFrame, chamber: str, p: str) -> DataFrame:
    """Per chamber what all assumptions say of its control: first, second, depends (and then where the first is favoured) or no_band."""
    low, high = F.min(p), F.max(p)
    crossing = F.array_sort(F.collect_list(F.when(F.col(p) >= 0.5, F.col("assumption"))))
    out = band.groupBy(chamber).agg(low.alias("low"), high.alias("high"), crossing.alias("c"))
    verdict = F.when(F.col("low") > 0.5, "first").when(F.col("high") < 0.5, "second").when(F.col("low").isNotNull(), "depends").otherwise("no_band")
    return out.select(chamber, "low", "high", verdict.alias("conclusion"), F.when(verdict == "depends", F.array_join("c", ", ")).alias("favoured_at"))


def political_features(winners: DataFrame, cycles: DataFrame, year: str, party: str, cycle: str) -> DataFrame:
    """Per cycle the party that won last before it, how many contests in a row it had won, and whether the cycle is a midterm."""
    order = Window.orderBy(year)  # a row per contest of the nation
    runs = winners.select(year, party, F.coalesce((F.lag(party).over(order) != F.col(party)).cast("int"), F.lit(1)).alias("_new"))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    terms = runs.withColumn("terms", F.row_number().over(Window.partitionBy("_run").orderBy(year)))
    found = joins.asof(cycles.select(F.col(cycle).alias(year), F.lit(1).alias("_k")), terms.select(year, party, "terms", F.lit(1).alias("_k")), ["_k"], year, [party, "terms"], strict=True)
    return found.where(F.col(party).isNotNull()).select(F.col(year).alias(cycle), party, F.col("terms").cast("bigint").alias("terms"), (F.col(year) % 4 == 2).alias("midterm"))


def incumbent_target(races: DataFrame, in_office: DataFrame, cycle: str, first_votes: str, second_votes: str, party: str, first: str) -> DataFrame:
    """Per cycle the two-party share of the party in office."""
    share = F.sum(first_votes) / F.nullif(F.sum(first_votes) + F.sum(second_votes), F.lit(0.0))
    own = races.groupBy(cycle).agg(share.alias("_s")).join(in_office.select(cycle, party), cycle)
    return own.select(cycle, F.when(F.col(party) == first, F.col("_s")).otherwise(1 - F.col("_s")).alias("incumbent_share"))


def fundamentals_backtest(panel: DataFrame, features: Sequence[str], cycle: str, target: str, party: str, first: str, control: str, least: int = 6) -> DataFrame:
    """A row per cycle that is predicted from all earlier ones: prediction, sigma, persistence (the last cycle's share, by party) and the control's prediction."""
    known = panel.where(F.forall(F.array(*(F.col(c).cast("double") for c in (*features, target))), lambda x: x.isNotNull() & ~F.isnan(x)))
    enough = max(least, len(features) + 2)
    main = regression.expanding(known, features, target, cycle, enough)
    plain = regression.expanding(known, [control], target, cycle, enough).select(cycle, F.col("pred").alias("control"))
    order = Window.orderBy(cycle)  # a row per cycle
    of_first = F.when(F.col(party) == first, F.col(target)).otherwise(1 - F.col(target))
    last = known.select(cycle, F.lag(of_first).over(order).alias("_last"), F.col(party).alias("_p"))
    persistence = F.when(F.col("_p") == first, F.col("_last")).otherwise(1 - F.col("_last"))
    joined = main.join(plain, cycle).join(last, cycle)
    return joined.select(cycle, F.col(target).alias("actual"), F.col("pred").alias("prediction"), "sigma", persistence.alias("persistence"), "control")


def fundamentals_gate(backtest: DataFrame, least: int = 8, coverage: float = 0.85) -> DataFrame:
    """One row of the backtest's errors, and whether the specification may be promoted: enough cycles, coverage, and better than both rivals."""
    error = lambda c: F.avg(F.abs(F.col(c) - F.col("actual"))).alias(f"{c}_mae")
    inside = (F.abs(F.col("prediction") - F.col("actual")) <= Z90 * F.col("sigma")).cast("double")
    rmse = F.sqrt(F.avg((F.col("prediction") - F.col("actual")) * (F.col("prediction") - F.col("actual"))))
    one = backtest.agg(F.count("*").alias("n"), error("prediction"), error("persistence"), error("control"), F.avg(inside).alias("coverage_90"), rmse.alias("rmse"))
    good = (F.col("n") >= least) & (F.col("coverage_90") >= coverage) & (F.col("prediction_mae") < F.least("persistence_mae", "control_mae"))
    return one.withColumn("eligible", F.coalesce(good, F.lit(False)))


def chamber(panel: DataFrame, state_history: DataFrame, features: Sequence[str], national: str, cycle: str, unit: str, state: str, share: str, sign: str, units: int, least: int = 4, winner: str | None = None, majors: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Every unit of each whole chamber, predicted from earlier cycles (pred, sigma, source and train_through), and the cycles left out.

    Left out, with reason, n_rows and n_units, are cycles without exactly ``units`` units (``incomplete``), with a
    ``winner`` that is none of ``majors`` (``other_winner``), without ``least`` earlier contested cycles (``short_history``)
    or with a unit that has neither features nor its state's lean in ``state_history`` (state, cycle, share, national;
    ``missing_fallback``); the first reason counts. The national share is forecast too, and its past errors widen sigma by the
    slope on it. Sides without opponent (share 0 or 1) are known.
    """
    other = F.max((~F.coalesce(F.col(winner).isin(list(majors)), F.lit(False))).cast("int")) if winner else F.lit(0)
    counts = panel.groupBy(cycle).agg(F.count("*").alias("_n"), F.countDistinct(unit).alias("_u"), F.max(national).alias("_true"), other.alias("_other"))
    early = F.when((F.col("_n") != units) | (F.col("_u") != units), "incomplete").when(F.col("_other") == 1, "other_winner")
    judged = counts.withColumn("_reason", early)
    whole = judged.where("_reason is null").select(cycle, "_true")
    contested = panel.where((F.col(share) > 0) & (F.col(share) < 1))
    parts = regression.grams(contested, features, share, cycle)
    total, fits = regression.Gram(np.zeros((len(features) + 2,) * 2)), []
    for k, c in enumerate(sorted(parts)):
        if k >= least:
            fit = regression.solve(total, features)
            fits.append((c, [float(b) for b in fit.coefficients], float(fit.sigma), sorted(parts)[k - 1]))
        total = total + parts[c]
    kind = dict(panel.dtypes)[cycle]
    fitted = panel.sparkSession.createDataFrame(fits, f"{cycle} {kind}, _b array<double>, _sigma double, train_through {kind}")
    forecast = forecasts.national_history(panel, cycle, national, sign)
    order = Window.orderBy(cycle).rowsBetween(Window.unboundedPreceding, -1)  # a row per cycle
    steps = whole.join(fitted, cycle).join(forecast, cycle).withColumn("_e", F.col("forecast") - F.col("_true"))
    past = F.when(F.count("_e").over(order) >= 3, F.stddev_samp("_e").over(order)).otherwise(0.03)
    steps = steps.withColumn("_nat", past).drop("_true", "_e")
    lean = state_history.select(state, cycle, (F.col("share") - F.col("national")).alias("_lean"))
    rows = joins.asof(panel.select(unit, state, cycle, share, *features), lean, [state], cycle, ["_lean"], strict=True).join(steps, cycle)
    ready = F.forall(F.array(*(F.col(c).cast("double") for c in features if c != national)), lambda x: x.isNotNull()) if len(features) > 1 else F.lit(True)
    model = F.col("_b")[0]
    for k, name in enumerate(features):
        model = model + F.col("_b")[k + 1] * (F.col("forecast") if name == national else F.col(name))
    slope = F.col("_b")[1 + list(features).index(national)]
    alone = F.col(share).isin(0.0, 1.0)
    sigma = F.hypot(F.col("_sigma"), F.abs(slope) * F.col("_nat")) * F.when(ready, 1.0).otherwise(FALLBACK_SIGMA)
    out = rows.select(
        unit,
        state,
        cycle,
        F.col(share).alias("actual"),
        F.when(alone, F.col(share)).otherwise(regression.clipped(F.when(ready, model).otherwise(F.col("forecast") + F.col("_lean")))).alias("pred"),
        F.when(alone, 0.0).otherwise(sigma).alias("sigma"),
        F.when(alone, "one_sided").when(ready, "unit_model").otherwise("state_fallback").alias("source"),
        "train_through",
        ready.alias("_ready"),
        "_lean",
    )
    missing = out.where(F.col("pred").isNull() | (~F.col("_ready") & F.col("_lean").isNull())).select(cycle, F.lit(True).alias("_missing")).distinct()
    late = judged.join(steps.select(cycle, F.lit(True).alias("_fitted")), cycle, "left").join(missing, cycle, "left")
    reason = F.coalesce("_reason", F.when(F.col("_fitted").isNull(), "short_history").when(F.col("_missing"), "missing_fallback"))
    omitted = late.select(cycle, reason.alias("reason"), F.col("_n").alias("n_rows"), F.col("_u").alias("n_units")).where("reason is not null")
    return out.join(missing, cycle, "left_anti").drop("_ready", "_lean"), omitted


def chamber_predictions(*args, **options) -> DataFrame:
    """The predictions of ``chamber``."""
    return chamber(*args, **options)[0]


def interval_gate(folds: DataFrame, model: str, cycle: str, covered: str, score: str, units: str, expected: int, rival: str, least: int = 4, coverage: float = 0.85) -> DataFrame:
    """One row: whether a model's chamber intervals pass against ``rival``'s: enough cycles, coverage, a lower mean score, and the whole chamber in all."""
    per = folds.groupBy(model).agg(F.countDistinct(cycle).alias("n"), F.avg(F.col(covered).cast("double")).alias("coverage"), F.avg(score).alias("score"), F.bool_and(F.col(units) == expected).alias("whole"))
    a, b = per.where(F.col(model) != rival).alias("a"), per.where(F.col(model) == rival).alias("b")
    both = a.crossJoin(b)  # a row per model against one row
    passed = (F.col("a.n") >= least) & (F.col("a.coverage") >= coverage) & (F.col("a.score") < F.col("b.score"))
    return both.select(F.col(f"a.{model}").alias(model), F.col("a.n").alias("n_cycles"), F.col("a.coverage").alias("coverage"), F.col("a.score").alias("score"), F.col("b.score").alias("rival_score"), passed.alias("subset_passed"), (passed & F.col("a.whole")).alias("promoted"))


def metrics_gate(scores: DataFrame, office: str, pipeline: str, segment: str, metrics: Sequence[str], corrected: str, base: str, vintage: Mapping[str, bool] | None = None, least: int = 4, coverage: float = 0.85) -> DataFrame:
    """Per office whether the corrected pipeline is lower than the base in all metrics, covered, and seen often enough in every segment.

    ``scores`` has a row per office, pipeline and segment with n_cycles, coverage_90 and the equal-cycle metrics.
    """
    a = scores.where(F.col(pipeline) == corrected).select(office, segment, "n_cycles", "coverage_90", *(F.col(m).alias(f"_a_{m}") for m in metrics))
    b = scores.where(F.col(pipeline) == base).select(office, segment, *(F.col(m).alias(f"_b_{m}") for m in metrics))
    better = F.lit(True)
    for m in metrics:
        better = better & (F.col(f"_a_{m}") < F.col(f"_b_{m}"))
    good = F.coalesce(better & (F.col("n_cycles") >= least) & (F.col("coverage_90") >= coverage), F.lit(False))
    out = a.join(b, [office, segment], "left").groupBy(office).agg(F.bool_and(good).alias("metrics_passed"), F.array_join(F.array_sort(F.collect_list(F.when(~good, F.col(segment)))), ",").alias("failed"))
    sound = F.coalesce(F.create_map(*[F.lit(x) for pair in (vintage or {}).items() for x in pair])[F.col(office)], F.lit(False)) if vintage else F.lit(False)
    return out.withColumns({"vintage_passed": sound, "review_candidate": F.col("metrics_passed") & sound})


def attach_targets(rows: DataFrame, canonical: DataFrame, keys: Sequence[str], archived: str, share: str, tolerance: float = 0.0005) -> DataFrame:
    """Rows with the target of the one race that has their keys, and the first reason that excludes them ("" for none).

    ``canonical`` has race_id, the keys, ``share``, certified, uncontested and winner; keys of several races match none.
    """
    single = canonical.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct("race_id", share, "certified", "uncontested", "winner")).alias("_r")).where("_n = 1").select(*keys, "_r.*")
    out = rows.join(single, list(keys), "left")
    reasons = [
        (F.col("race_id").isNull(), "missing_or_ambiguous_race"),
        (~F.coalesce("certified", F.lit(False)), "not_certified"),
        (F.coalesce("uncontested", F.lit(True)), "uncontested_or_unknown"),
        (F.col("winner") == "OTHER", "other_party_winner"),
        (F.abs(F.col(archived) - F.col(share)) > tolerance, "share_mismatch"),
    ]
    return out.withColumn("exclusion", F.coalesce(*(F.when(F.coalesce(t, F.lit(False)), n) for t, n in reasons), F.lit("")))


def quarantine_sensitivity(kept: DataFrame, quarantined: DataFrame, features: Sequence[str], target: str, group: str) -> DataFrame:
    """One row: the leave-one-out error without and with the quarantined rows, and the difference."""
    names = [*features, target, group]

    def score(rows: DataFrame, suffix: str) -> DataFrame:
        held = regression.leave_one_out(rows, features, target, group)
        return held.agg(F.count("*").alias(f"n_{suffix}"), F.avg(F.abs(F.col("pred") - F.col(target))).alias(f"mae_{suffix}"))

    both = score(kept.select(*names), "excluding").crossJoin(score(kept.select(*names).unionByName(quarantined.select(*names)), "including"))  # one row each
    return both.withColumn("mae_delta", F.col("mae_including") - F.col("mae_excluding"))


def interim_scores(runs: DataFrame, actuals: DataFrame, run: str, key: str, as_of: str, splits: Sequence[str]) -> DataFrame:
    """Scores per frozen run and split over the contests certified by ``as_of`` only; runs have share, sigma and p."""
    known = actuals.where(F.col("certified_on") <= F.lit(as_of).cast(dict(actuals.dtypes)["certified_on"])).select(key, "actual_share", "actual_win")
    scored = runs.join(known.where("actual_share is not null"), key)
    y, error = F.col("actual_win").cast("double"), F.col("share") - F.col("actual_share")
    parts = scored.select(run, F.explode(F.array(F.struct(F.lit("overall").alias("split"), F.lit("all").alias("level")), *(F.struct(F.lit(s).alias("split"), F.col(s).cast("string").alias("level")) for s in splits))).alias("s"), error.alias("e"), F.col("p"), y.alias("y"), "sigma")
    inside = (F.abs("e") <= Z90 * F.col("sigma")).cast("double")
    right = ((F.col("p") > 0.5) == (F.col("y") > 0.5)).cast("double")
    return parts.groupBy(run, "s.split", "s.level").agg(
        F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), evaluation.brier(F.col("p"), F.col("y")).alias("brier"), evaluation.log_score(F.col("p"), F.col("y")).alias("log_score"), F.avg(inside).alias("coverage_90"), F.avg(right).alias("accuracy")
    )
