"""Weighted means, partisanship, swings, coverage counts, grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows where both are known; no weight: null."""
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0.0))


def lean_label(lean: Column, first: str = "D", second: str = "R") -> Column:
    """``D+6``, ``R+3`` or ``EVEN`` from a lean as a fraction, rounded half to even points."""
    points = F.bround(lean * 100).cast("int")
    return F.when(points > 0, F.concat(F.lit(f"{first}+"), points)).when(points < 0, F.concat(F.lit(f"{second}+"), -points)).when(points == 0, "EVEN")


def partisanship(df: DataFrame, keys: Sequence[str], period: str, share: str, weight: str, national: DataFrame | None = None) -> DataFrame:
    """Per key: mean lean, its share less the weighted mean share of the period; number of periods; label."""
    base = national if national is not None else df.groupBy(period).agg(weighted_mean(F.col(share), F.col(weight)).alias("_national"))
    leans = df.join(base, period).withColumn("lean", F.col(share) - F.col("_national"))
    return leans.groupBy(*keys).agg(F.avg("lean").alias("score"), F.count("lean").alias("n_periods")).withColumn("label", lean_label(F.col("score")))


def national_swing(df: DataFrame, period: str, share: str, weight: str) -> DataFrame:
    """Weighted mean share by period, and its change from the period before."""
    w = Window.orderBy(period)  # a row per period
    means = df.groupBy(period).agg(weighted_mean(F.col(share), F.col(weight)).alias("mean_share"))
    return means.withColumn("swing", F.col("mean_share") - F.lag("mean_share").over(w))


def swing_panel(df: DataFrame, keys: Sequence[str], period: str, share: str, weight: str) -> DataFrame:
    """Per key and period: own swing and the national swing, where the key has the period before."""
    earlier = df.select(*keys, (F.col(period) + 1).alias(period), F.col(share).alias("_before"))
    own = df.join(earlier, [*keys, period]).withColumn("own_swing", F.col(share) - F.col("_before"))
    return own.join(national_swing(df, period, share, weight).where("swing is not null"), period).select(*keys, period, "own_swing", F.col("swing").alias("national_swing"))


def slope_by(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Simple regression of y on x per key: n, slope, intercept, r2; one that x can't identify (no spread) has nulls and identified false."""
    fit = df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_sxy(y, x).alias("_sxy"), F.regr_syy(y, x).alias("_syy"), F.regr_avgx(y, x).alias("_x"), F.regr_avgy(y, x).alias("_y"))
    ok = F.col("_sxx") > 1e-15
    slope = F.when(ok, F.col("_sxy") / F.nullif("_sxx", F.lit(0.0)))
    return fit.select(
        *keys,
        "n",
        slope.alias("slope"),
        (F.col("_y") - slope * F.col("_x")).alias("intercept"),
        F.when(ok & (F.col("_syy") > 0), F.col("_sxy") * F.col("_sxy") / (F.nullif("_sxx", F.lit(0.0)) * F.nullif("_syy", F.lit(0.0)))).alias("r2"),
        F.coalesce(ok, F.lit(False)).alias("identified"),
    )


def top_per_group(df: DataFrame, keys: Sequence[str], parties: Sequence[str], party: str, amount: str, who: str) -> DataFrame:
    """Per key the largest filer and amount of each named party, and the smoothed log ratio of the first two parties."""
    pick = lambda p: F.max(F.when(F.col(party) == p, F.struct(F.col(amount).alias("a"), (-F.col(who)).alias("w"))))
    tops = df.groupBy(*keys).agg(*(pick(p).alias(f"_{k}") for k, p in enumerate(parties)))
    out = tops.select(*keys, *(x for k, p in enumerate(parties) for x in ((-F.col(f"_{k}.w")).alias(f"{p}_top"), F.col(f"_{k}.a").alias(f"{p}_amount"))))
    amount_of = lambda k: F.coalesce(F.col(f"{parties[k]}_amount"), F.lit(0.0))
    return out.withColumn("log_ratio", smoothed_log_ratio(amount_of(0), amount_of(1)))


def smoothed_log_ratio(a: Column, b: Column, prior: float = 1e4) -> Column:
    return F.ln((a + prior) / (b + prior))


def with_totals(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], total: str = "all") -> DataFrame:
    """Aggregates by the keys and over everything, the keys of the total row being ``total``: one pass by grouping sets."""
    out = df.rollup(*keys).agg(F.grouping_id().alias("_g"), *aggregates).where(F.col("_g").isin(0, 2 ** len(keys) - 1))
    named = [F.when(F.col("_g") == 0, F.col(k).cast("string")).otherwise(F.lit(total)).alias(k) for k in keys]
    return out.select(*named, *(c for c in out.columns if c not in (*keys, "_g")))


def split_scores(df: DataFrame, splits: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates overall and by each split on its own: (split, level, ...); grouping sets, so the rows are read once."""
    from functools import reduce

    view = df
    sets = [(), *((s,) for s in splits)]
    grouped = view.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, splits)).agg(*aggregates, *(F.grouping(s).alias(f"_g_{s}") for s in splits))
    name = reduce(lambda a, s: F.when(F.col(f"_g_{s}") == 0, F.lit(s)).otherwise(a), reversed(splits), F.lit("overall"))
    level = reduce(lambda a, s: F.when(F.col(f"_g_{s}") == 0, F.col(s).cast("string")).otherwise(a), reversed(splits), F.lit("all"))
    return grouped.select(name.alias("split"), level.alias("level"), *(c for c in grouped.columns if c not in splits and not c.startswith("_g_")))


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def dispersion(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Root mean square distance from the group's mean."""
    return df.groupBy(*keys).agg(F.stddev_pop(value).alias("dispersion"), F.count(value).alias("n"))


def region_swing(df: DataFrame, keys: Sequence[str], before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """Two-party share of each region before and after, its swing, and the excess over the swing of everything.

    ``before`` and ``after`` name the columns of the two parties' votes.
    """
    share = lambda c: F.sum(c[0]) / F.nullif(F.sum(c[0]) + F.sum(c[1]), F.lit(0.0))
    aggregates = [share(before).alias("share_before"), share(after).alias("share_after")]
    regions = df.groupBy(*keys).agg(*aggregates).withColumn("swing", F.col("share_after") - F.col("share_before"))
    total = df.agg(*aggregates).select((F.col("share_after") - F.col("share_before")).alias("_total"))
    return regions.crossJoin(F.broadcast(total)).withColumn("excess_swing", F.col("swing") - F.col("_total")).drop("_total")  # total is one row


def specials_summary(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """n, mean (weighted if asked), median, sample sd and standard error per key."""
    mean = weighted_mean(F.col(value), F.col(weight)) if weight else F.avg(value)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        mean.alias("mean"),
        F.percentile(value, 0.5).alias("median"),
        F.stddev_samp(value).alias("sd"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"),
    )


def label_precedence(df: DataFrame, keys: Sequence[str], party: str, order: Sequence[str]) -> DataFrame:
    """One label per key: the first in ``order`` that any of its rows has, else OTHER."""
    label = F.lit("OTHER")
    for p in reversed(order):
        label = F.when(F.bool_or(F.col(party) == p), p).otherwise(label)
    return df.groupBy(*keys).agg(label.alias("label"))


def suspect_states(df: DataFrame, keys: Sequence[str], first: str, second: str, total: str, least: float = 0.5) -> DataFrame:
    """Sums per key, and whether the two parties have less than ``least`` of all votes."""
    sums = df.groupBy(*keys).agg(F.sum(first).alias("first_votes"), F.sum(second).alias("second_votes"), F.sum(total).alias("total_votes"))
    two = F.col("first_votes") + F.col("second_votes")
    return sums.withColumn("two_party_suspect", F.coalesce(two / F.nullif(F.col("total_votes").cast("double"), F.lit(0.0)) < least, F.lit(True)))


def worst(df: DataFrame, error: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows of the largest absolute error."""
    return df.orderBy(F.abs(error).desc(), *tie).limit(k)


def with_override(df: DataFrame, overrides: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value`` replaced where a reviewed table names the row's keys (null as null), and whether it was."""
    condition = F.lit(True)
    for k in keys:
        condition &= F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = df.alias("l").join(overrides.alias("o"), condition, "left")
    return joined.select(*(F.col(f"l.{c}") for c in df.columns if c != value), F.coalesce(f"o.{value}", f"l.{value}").alias(value), F.col(f"o.{value}").isNotNull().alias("overridden"))


def closest(df: DataFrame, distance: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows that lie closest to a threshold, by their distance from it; Spark keeps k rows a partition."""
    return df.orderBy(F.abs(distance), *tie).limit(k)
