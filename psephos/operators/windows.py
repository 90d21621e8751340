"""Lags with guards, latest rows, precedence picks, episodes, carry-forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def guarded_lag(df: DataFrame, keys: Sequence[str], period: str, values: Sequence[str], gap: int = 1, prefix: str = "lag_") -> DataFrame:
    """The values of the row before, only where it is exactly ``gap`` periods earlier."""
    w = Window.partitionBy(*keys).orderBy(period)
    follows = F.col(period) - F.lag(period).over(w) == gap
    return df.withColumns({prefix + v: F.when(follows, F.lag(v).over(w)) for v in values})


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``: as a sorted aggregate, so no key needs a window over all its rows."""
    others = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_r = 1").select(*keys, *others)


def decisive_winner(df: DataFrame, keys: Sequence[str], stage_rank: Column, votes: str, tie: str) -> DataFrame:
    """The row that decides a seat: the latest decisive stage, then votes (nulls last), then the smaller ``tie``."""
    return latest(df.withColumn("_stage", stage_rank), keys, [F.desc("_stage"), F.desc_nulls_last(votes), F.asc(tie)]).drop("_stage")


def even_period(year: Column) -> Column:
    """A contest of an odd year, a runoff, decides the even period before it."""
    return year - year % 2


def holders(df: DataFrame, keys: Sequence[str], period: str, winner: str, at: int, term: int) -> DataFrame:
    """Who holds each seat before period ``at``: the winner one term earlier, else the latest earlier winner, with the source."""
    earlier = df.where(F.col(period) < at)
    exact = F.col(period) == at - term
    pick = latest(earlier.withColumn("_e", exact), keys, [F.desc("_e"), F.desc(period), F.asc(winner)])
    return pick.select(*keys, F.col(winner).alias("holder"), F.col(period).alias("since"), F.when(F.col("_e"), "exact_term").otherwise("earlier_period").alias("source"))


def episodes(df: DataFrame, keys: Sequence[str], order: Sequence[str], eligible: str) -> DataFrame:
    """``episode``: how many ineligible rows came up to here, so a run of eligible rows shares a number; and its first order value."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("episode", F.sum(F.when(F.col(eligible), 0).otherwise(1)).over(w).cast("bigint"))
    run = Window.partitionBy(*keys, "episode")
    return out.withColumn("episode_start", F.min(F.when(F.col(eligible), F.col(order[0]))).over(run))


def demeaned(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def spread_known(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Nulls of ``value`` filled with the smallest known value of the key."""
    return df.withColumn(value, F.coalesce(F.col(value), F.min(value).over(Window.partitionBy(*keys))))


def growth(df: DataFrame, keys: Sequence[str], day: str, value: str, months: int = 12, name: str = "growth") -> DataFrame:
    """Log growth against the row exactly ``months`` earlier; none or not positive: null."""
    earlier = df.select(*keys, F.add_months(day, months).alias(day), F.col(value).alias("_before"))
    rate = F.when((F.col(value) > 0) & (F.col("_before") > 0), F.ln(F.col(value) / F.col("_before")))
    return df.join(earlier, [*keys, day], "left").withColumn(name, rate).drop("_before")


def carried_header(df: DataFrame, keys: Sequence[str], order: str, header: Column, name: str) -> DataFrame:
    """Each row with the last header at or above it in its key: a parser's state as a window."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(header, ignorenulls=True).over(w))


def closest(df: DataFrame, keys: Sequence[str], distance: Column, tie: Sequence[str]) -> DataFrame:
    """The row of each key of the least absolute distance."""
    return latest(df.withColumn("_d", F.abs(distance)), keys, [F.asc("_d"), *map(F.asc, tie)]).drop("_d")
