"""Least squares from sufficient statistics: one distributed aggregate, small algebra on its result.

Tables of any size shrink to a Gram matrix per group (at most ``MOST_GROUPS`` groups of a few columns); leave-one-out and
expanding fits are sums of these, and predictions are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_GROUPS = 100_000


@dataclass(frozen=True)
class Gram:
    """Sums over (1, features, target): n is the corner."""

    sums: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.sums + other.sums)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.sums - other.sums)

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])


@dataclass(frozen=True)
class Fit:
    features: tuple[str, ...]
    coefficients: np.ndarray
    sigma: float
    n: int

    def predict(self) -> Column:
        out = F.lit(float(self.coefficients[0]))
        for name, b in zip(self.features, self.coefficients[1:], strict=True):
            out = out + F.col(name) * float(b)
        return out


def grams(df: DataFrame, features: Sequence[str], target: str, by: str | None = None) -> dict:
    """The Gram of each value of ``by`` (of None without it), over rows in which all features and the target are known."""
    names = [*features, target]
    value = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    known = df.where(F.forall(F.array(*(F.col(c).cast("double") for c in names)), lambda x: x.isNotNull() & ~F.isnan(x)))
    cells = [F.sum(value[i] * value[j]).alias(f"_{i}_{j}") for i in range(len(value)) for j in range(i + 1)]
    grouped = known.groupBy(*([by] if by else [])).agg(*cells)
    rows = grouped.limit(MOST_GROUPS + 1).collect()  # a row per group
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    out = {}
    for r in rows:
        m = np.zeros((len(value), len(value)))
        for i in range(len(value)):
            for j in range(i + 1):
                m[i, j] = m[j, i] = r[f"_{i}_{j}"] or 0.0
        out[r[by] if by else None] = Gram(m)
    return out


def solve(gram: Gram, features: Sequence[str]) -> Fit:
    """Intercept and slopes by minimum-norm least squares on centred moments, so that deficient designs still have a fit; sigma has n - k degrees of freedom."""
    k = len(features)
    n = gram.n
    if n == 0:
        return Fit(tuple(features), np.zeros(k + 1), float("nan"), 0)
    mean = gram.sums[0, 1:] / n
    centred = gram.sums[1:, 1:] - n * np.outer(mean, mean)
    slopes = np.linalg.lstsq(centred[:k, :k], centred[:k, k], rcond=1e-12)[0] if k else np.zeros(0)
    rss = max(0.0, centred[k, k] - 2 * slopes @ centred[:k, k] + slopes @ centred[:k, :k] @ slopes)
    dof = n - k - 1
    return Fit(tuple(features), np.concatenate([[mean[k] - slopes @ mean[:k]], slopes]), float(np.sqrt(rss / dof)) if dof > 0 else float("nan"), int(n))


def _by_group(df: DataFrame, group: str, fits: dict) -> DataFrame:
    """Rows with pred and sigma of their group's fit; groups without one are left out."""
    rows = [(k, [float(x) for x in f.coefficients], f.sigma, f.n) for k, f in fits.items() if f.n > 0]
    kind = dict(df.dtypes)[group]
    table = df.sparkSession.createDataFrame(rows, f"_g {kind}, _b array<double>, sigma double, n_train long")
    features = next(iter(fits.values())).features if fits else ()
    pred = F.col("_b")[0]
    for i, name in enumerate(features):
        pred = pred + F.col("_b")[i + 1] * F.col(name)
    joined = df.join(F.broadcast(table), df[group] == F.col("_g"))  # a row per group, at most MOST_GROUPS
    return joined.withColumn("pred", pred).drop("_g", "_b")


def leave_one_out(df: DataFrame, features: Sequence[str], target: str, group: str) -> DataFrame:
    """Each row predicted by the fit of all other groups."""
    parts = grams(df, features, target, group)
    if not parts:
        return _by_group(df, group, {})
    total = sum(parts.values(), Gram(np.zeros((len(features) + 2,) * 2)))
    return _by_group(df, group, {g: solve(total - own, features) for g, own in parts.items()})


def fits_before(df: DataFrame, features: Sequence[str], target: str, period: str, least: int = 1) -> dict:
    """For each period that has ``least`` before it: the fit of all earlier periods, and the last of them."""
    parts = grams(df, features, target, period)
    total, fits, order = Gram(np.zeros((len(features) + 2,) * 2)), {}, sorted(parts)
    for k, p in enumerate(order):
        if k >= least:
            fits[p] = solve(total, features), order[k - 1] if k else None
        total = total + parts[p]
    return fits


def expanding(df: DataFrame, features: Sequence[str], target: str, period: str, least: int = 1) -> DataFrame:
    """Each row predicted by the fit of all earlier periods, from the period on that has ``least`` before it."""
    return _by_group(df, period, {p: fit for p, (fit, _) in fits_before(df, features, target, period, least).items()})


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def group_slopes(df: DataFrame, lead: str, controls: Sequence[str], target: str, group: str, draws: int = 500, ridge: float = 1e-5, seed: int = 23, min_groups: int = 2) -> DataFrame:
    """One row: the slope of ``lead`` from rows centred within groups, each group weighing alike, and the interval of a bootstrap of whole groups."""
    from . import bootstrap

    n_groups = df.where(F.forall(F.array(*(F.col(c).cast("double") for c in (lead, *controls, target))), lambda x: x.isNotNull() & ~F.isnan(x))).agg(F.count_distinct(group)).first()[0]
    return bootstrap.summary(bootstrap.slopes(df, lead, controls, target, group, draws, ridge, seed), n_groups, draws, min_groups)
