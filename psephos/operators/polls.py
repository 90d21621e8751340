"""Poll averages, house effects and precision blends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fraction(x: Column) -> Column:
    """Percentages become fractions; what is at most 1 already is one."""
    return F.when(F.abs(x) <= 1, x).otherwise(x / 100)


def decay(age_days: Column, half_life: float) -> Column:
    return F.exp(-F.ln(F.lit(2.0)) * F.greatest(age_days, F.lit(0.0)) / half_life)


def average(polls: DataFrame, keys: Sequence[str], share: str, weight: Column, sample: str, pollster: str, error_floor: float = 0.025) -> DataFrame:
    """One estimate per group: weighted mean, its sigma (sampling, between polls, floor), counts, effective number of polls.

    Moments are summed in one pass: no window, no second read. Sampling variance of a poll is s (1 - s) / n.
    """
    w = polls.select(*keys, F.col(share).alias("s"), weight.alias("w"), F.col(sample).alias("n"), F.col(pollster).alias("p"))
    sums = w.groupBy(*keys).agg(
        F.sum("w").alias("w"),
        F.sum(F.col("w") * F.col("s")).alias("ws"),
        F.sum(F.col("w") * F.col("s") * F.col("s")).alias("wss"),
        F.sum(F.col("w") * F.col("w")).alias("ww"),
        F.sum(F.col("w") * F.col("w") * F.col("s") * (1 - F.col("s")) / F.col("n")).alias("v"),
        F.count("*").alias("n_polls"),
        F.countDistinct("p").alias("n_pollsters"),
    )
    mean = F.col("ws") / F.col("w")
    between = F.greatest(F.col("wss") / F.col("w") - mean * mean, F.lit(0.0))
    sampling = F.col("v") / (F.col("w") * F.col("w"))
    sigma = F.sqrt(sampling + between + F.lit(error_floor**2))
    return sums.where("w > 0").select(*keys, mean.alias("poll_mean"), sigma.alias("poll_sigma"), "n_polls", "n_pollsters", (F.col("w") * F.col("w") / F.col("ww")).alias("effective_polls"))


def blend(mean_a: Column, sigma_a: Column, mean_b: Column, sigma_b: Column, floor: float = 0.02) -> dict[str, Column]:
    """Precision-weighted mean, sigma and the weight of b; a missing b leaves a."""
    p, q = (1 / F.pow(F.greatest(s, F.lit(1e-6)), F.lit(2.0)) for s in (sigma_a, sigma_b))
    has = mean_b.isNotNull()
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return {
        "blend_mean": clip(F.when(has, (p * mean_a + q * mean_b) / (p + q)).otherwise(mean_a)),
        "blend_sigma": F.when(has, F.greatest(F.sqrt(1 / (p + q)), F.lit(floor))).otherwise(sigma_a),
        "poll_weight": F.when(has, q / (p + q)).otherwise(F.lit(0.0)),
        "signal": F.when(has, "fundamentals+polls").otherwise("fundamentals_only"),
    }


def house_effects(polls: DataFrame, pollster: str, period: str, error: str, prior: float = 5, min_polls: int = 5, min_periods: int = 2) -> DataFrame:
    """Each pollster's mean departure from its periods' common error, shrunk by ``prior`` polls of none; 0 if not identified."""
    centred = polls.withColumn("_c", F.col(error) - F.avg(error).over(Window.partitionBy(period)))
    sums = centred.groupBy(pollster).agg(F.count("*").alias("n_polls"), F.countDistinct(period).alias("n_periods"), F.sum("_c").alias("_sum"))
    identified = (F.col("n_polls") >= min_polls) & (F.col("n_periods") >= min_periods)
    return sums.withColumns({"identified": identified, "house_effect": F.when(identified, F.col("_sum") / (F.col("n_polls") + prior)).otherwise(0.0)}).drop("_sum")


def question_weights(polls: DataFrame, race: str, poll: str) -> DataFrame:
    """A poll's questions share its weight: 1 over how many the poll has in the race."""
    return polls.withColumn("question_weight", 1 / F.count("*").over(Window.partitionBy(race, poll)))


def unique_pair(answers: DataFrame, question: str, party: str, value: str, first: str, second: str) -> DataFrame:
    """Questions with exactly one answer of each of two parties: both values; all others with the first reason that holds."""
    n = lambda p: F.count_if(F.col(party) == p)
    sums = answers.groupBy(question).agg(
        n(first).alias("_a"), n(second).alias("_b"), F.max(F.when(F.col(party) == first, F.col(value))).alias("first_value"), F.max(F.when(F.col(party) == second, F.col(value))).alias("second_value")
    )
    reason = F.when(F.col("_a") == 0, "no_first").when(F.col("_b") == 0, "no_second").when(F.col("_a") > 1, "several_first").when(F.col("_b") > 1, "several_second").otherwise("accepted")
    return sums.withColumn("reason", reason).drop("_a", "_b")


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that a row fails, null if it passes all; a null outcome fails."""
    out = None
    for name, ok in checks:
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out
