"""Forecast scores: errors, Brier and log scores, calibration, coverage, intervals, shared-error components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The edges of ten calibration bins as the floats that an even spacing gives (fixed values: 0.3 and others lie a bit off).
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by a rational approximation of erf, error below 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def win_probability(mean: Column, sigma: Column) -> Column:
    return normal_cdf((mean - 0.5) / sigma)


def metrics(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """n, MAE, RMSE, and how often both lie on the same side of one half."""
    error = F.col(predicted) - F.col(actual)
    right = (F.col(predicted) > 0.5) == (F.col(actual) > 0.5)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(right.cast("double")).alias("accuracy"))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_score(p: Column, y: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def calibration_bin(p: Column) -> Column:
    """Bin 0 to 9 by the fixed edges, the last one closed."""
    n = sum(((p >= e).cast("int") for e in EDGES[1:]), F.lit(0))
    return F.least(n, F.lit(9))


def calibration(df: DataFrame, p: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(p).isNotNull()).groupBy(*keys, calibration_bin(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def coverage(df: DataFrame, mean: str, sigma: str, actual: str, levels: Sequence[tuple[int, float]] = ((80, 1.2815515655446004), (90, 1.6448536269514722), (95, 1.959963984540054))) -> DataFrame:
    """One row: the share of actual values inside the central intervals of each level."""
    inside = lambda z: (F.abs(F.col(actual) - F.col(mean)) <= z * F.col(sigma)).cast("double")
    return df.agg(*(F.avg(inside(z)).alias(f"coverage_{level}") for level, z in levels))


def interval_score(low: Column, high: Column, actual: Column, penalty: float = 20) -> Column:
    """Width of a 90 % interval and what the actual value misses it by, times the penalty."""
    return high - low + penalty * F.greatest(low - actual, F.lit(0)) + penalty * F.greatest(actual - high, F.lit(0))


def pair_covariance(df: DataFrame, period: str, region: str, z: str) -> DataFrame:
    """Per period: mean product of pairs in different regions, of pairs in one region, and mean square; from sums, never from pairs."""
    by_region = df.groupBy(period, region).agg(F.count(z).alias("n"), F.sum(z).alias("s"), F.sum(F.col(z) * F.col(z)).alias("q"))
    n, s = F.col("n").cast("double"), F.col("s")
    sums = by_region.groupBy(period).agg(
        F.sum(n).alias("N"), F.sum(s).alias("S"), F.sum(s * s).alias("SS"), F.sum("q").alias("Q"), F.sum(n * n).alias("NN"), F.sum(n * (n - 1)).alias("P")
    )
    cross = F.col("N") * F.col("N") - F.col("NN")
    return sums.where((cross > 0) & (F.col("P") > 0)).select(
        period,
        ((F.col("S") * F.col("S") - F.col("SS")) / cross).alias("across"),
        ((F.col("SS") - F.col("Q")) / F.col("P")).alias("within"),
        (F.col("Q") / F.col("N")).alias("variance"),
    )


def error_components(pairs: DataFrame) -> DataFrame:
    """One row: national, regional and own share of the error variance from the mean of ``pair_covariance``, each at least 0."""
    m = pairs.agg(F.avg("across").alias("a"), F.avg("within").alias("w"), F.avg("variance").alias("v"), F.count("*").alias("n_periods"))
    zero = F.lit(0.0)
    m = m.withColumn("national", F.greatest("a", zero)).withColumn("regional", F.greatest(F.col("w") - F.col("national"), zero))
    m = m.withColumn("own", F.greatest(F.col("v") - F.col("national") - F.col("regional"), zero))
    total = F.nullif(F.col("national") + F.col("regional") + F.col("own"), zero)
    return m.select("n_periods", *((F.col(c) / total).alias(c) for c in ("national", "regional", "own")))


def quality_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_missing, n_distinct) of each column, all in one pass."""
    parts = [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.countDistinct(c).alias(f"d_{c}"))]
    one = df.agg(F.count("*").alias("n"), *parts)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"m_{c}").alias("n_missing"), F.col(f"d_{c}").alias("n_distinct")) for c in columns))
    return one.select(F.inline(rows))


def macro_average(df: DataFrame, period: str, slices: Sequence[str], error: str) -> DataFrame:
    """Mean absolute error per slice, each period weighing alike."""
    by_period = df.groupBy(*slices, period).agg(F.avg(F.abs(error)).alias("_m"), F.count("*").alias("_n"))
    return by_period.groupBy(*slices).agg(F.avg("_m").alias("mae"), F.count("*").alias("n_periods"), F.sum("_n").alias("n"))


def realised_against(intervals: DataFrame, actual: float, low: str, high: str) -> DataFrame:
    """One row: how many assumptions' intervals hold the actual value, and failed, if none does."""
    inside = (F.col(low) <= actual) & (F.col(high) >= actual)
    return intervals.agg(F.count_if(inside).alias("n_inside"), F.count("*").alias("n"), (~F.bool_or(inside)).alias("failed"))
