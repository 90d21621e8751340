"""Correlated simulation with counter-based random numbers: a draw depends on its names only, never on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *names: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from the MD5 of (seed, stream, names)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *(n.cast("string") for n in names)).cast("binary"))
    part = lambda k: (F.conv(F.substring(h, k, 8), 16, 10).cast("bigint") + 0.5) / 4294967296.0
    return part(1), part(9)


def normal(seed: int, stream: str, *names: Column) -> Column:
    u, v = uniform(seed, stream, *names)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v)


def simulate(units: DataFrame, unit: str, region: str, mean: str, sigma: str, n_sims: int, shares: Sequence[float], seed: int = 7) -> DataFrame:
    """(sim, unit, region, share): mean + sigma * (national, regional and own shock), by the roots of their variance shares, in [0, 1].

    Rows are exploded from the units, so the work is spread as the units are.
    """
    total = sum(shares)
    a, b, c = ((x / total) ** 0.5 for x in shares)
    rows = units.select(unit, region, mean, sigma, F.explode(F.sequence(F.lit(1), F.lit(n_sims))).alias("sim"))
    shock = a * normal(seed, "national", F.col("sim")) + b * normal(seed, "region", F.col("sim"), F.col(region)) + c * normal(seed, "unit", F.col("sim"), F.col(unit))
    return rows.select("sim", unit, region, F.least(F.greatest(F.col(mean) + F.col(sigma) * shock, F.lit(0.0)), F.lit(1.0)).alias("share"))


def unit_distribution(draws: DataFrame, unit: str) -> DataFrame:
    """Mean, median, 5th and 95th percentile, chance of more than one half, and who leads on average."""
    mean = F.avg("share")
    return draws.groupBy(unit).agg(
        mean.alias("mean_share"),
        F.percentile("share", 0.5).alias("median_share"),
        F.percentile("share", 0.05).alias("share_5th"),
        F.percentile("share", 0.95).alias("share_95th"),
        F.avg((F.col("share") > 0.5).cast("double")).alias("win_probability"),
        F.when(mean > 0.5, "first").when(mean < 0.5, "second").otherwise("even").alias("leader"),
    )


def seat_distribution(draws: DataFrame, weight: Column | None = None, held: float = 0, majority: float = 0) -> DataFrame:
    """One row: distribution of seats (or of weights) won per draw, added to ``held``, and the chance of more than ``majority``."""
    won = F.when(F.col("share") > 0.5, weight if weight is not None else F.lit(1)).otherwise(0)
    seats = draws.groupBy("sim").agg((F.sum(won) + held).cast("double").alias("s"))
    return seats.agg(
        F.avg("s").alias("mean_seats"), F.percentile("s", 0.5).alias("median_seats"), F.percentile("s", 0.05).alias("seats_5th"), F.percentile("s", 0.95).alias("seats_95th"), F.avg((F.col("s") > majority).cast("double")).alias("p_control")
    )


def with_shared_slope(draws: DataFrame, leans: DataFrame, unit: str, lean: str, slopes: Sequence[float], seed: int = 7) -> DataFrame:
    """Draws shifted by lean times one slope per sim, picked from ``slopes`` (at most some thousands) by hash."""
    u, _ = uniform(seed + 1, "slope", F.col("sim"))
    pick = F.element_at(F.array(*map(F.lit, slopes)), (F.floor(u * len(slopes)) + 1).cast("int"))
    shifted = F.col("share") + pick * F.coalesce(F.col(lean), F.lit(0.0))
    return draws.join(leans.select(unit, lean), unit).withColumn("share", F.least(F.greatest(shifted, F.lit(0.0)), F.lit(1.0))).drop(lean)
