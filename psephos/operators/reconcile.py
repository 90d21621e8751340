"""Reconciliation of sums with reported totals, quarantine, and set operations on keys. Null keys match null keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_keys(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def unreconciled(rows: DataFrame, totals: DataFrame, race: str, votes: str, is_vote: str, total: str, absolute: float = 10, relative: float = 0.001) -> DataFrame:
    """Races whose votes match the reported total under neither convention, all rows or proper votes only.

    Races without a positive total are not failures. ``difference`` is signed, under the convention that came closer.
    """
    sums = rows.groupBy(race).agg(F.coalesce(F.sum(votes), F.lit(0)).alias("_all"), F.sum(F.when(F.col(is_vote), F.col(votes)).otherwise(0)).alias("_votes"))
    checked = sums.join(totals.groupBy(race).agg(F.max(total).alias("_t")).where("_t > 0"), race)
    gap = lambda c: F.abs(F.col(c) - F.col("_t"))
    failed = checked.where(F.least(gap("_all"), gap("_votes")) > F.greatest(F.lit(absolute), relative * F.col("_t")))
    difference = F.when(gap("_votes") < gap("_all"), F.col("_votes")).otherwise(F.col("_all")) - F.col("_t")
    out = failed.select(race, "_t", difference.alias("difference")).withColumn("pct_of_total", F.round(F.abs("difference") / F.col("_t") * 100, 3))
    reason = (
        F.when(F.abs("difference") <= absolute, "rounding")
        .when(F.col("pct_of_total") >= 40, "multiple_rounds")
        .when(F.col("difference") > 0, "above_total")
        .otherwise("below_total")
    )
    return out.withColumn("reason", reason).drop("_t")


def split(rows: DataFrame, bad: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not in ``bad``, and rows whose key is."""
    condition = same_keys(keys)
    return tuple(rows.alias("l").join(bad.alias("r"), condition, how) for how in ("left_anti", "left_semi"))


def refuse_repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that come once; a key given twice is dropped, not summed."""
    once = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in rows.columns if c not in keys))
    return once.where("_n = 1").select(*rows.columns)


def override(base: DataFrame, better: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``better``, and the rows of ``base`` whose key it does not have."""
    return split(base, better.select(*keys).distinct(), keys)[0].unionByName(better)


def set_differences(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are expected and not found (missing), or found and not expected (extra)."""
    a, b = (x.select(*keys).distinct() for x in (expected, found))
    return split(a, b, keys)[0].withColumn("side", F.lit("missing")).unionByName(split(b, a, keys)[0].withColumn("side", F.lit("extra")))


def shared_keys(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The keys that every table has, once each."""
    out = tables[0].select(*keys).distinct()
    for other in tables[1:]:
        out = out.intersect(other.select(*keys))
    return out


def outer_status(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with status left_only, right_only or both."""
    a, b = left.withColumn("_l", F.lit(True)).alias("l"), right.withColumn("_r", F.lit(True)).alias("r")
    both = a.join(b, same_keys(keys), "full_outer")
    status = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return both.select(
        *(F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys),
        *(F.col(f"l.{c}") for c in left.columns if c not in keys),
        *(F.col(f"r.{c}") for c in right.columns if c not in keys),
        status.alias("status"),
    )


def benchmark_check(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Each expected value beside the actual one and whether they agree; a missing one does not."""
    joined = expected.alias("r").join(actual.alias("l"), same_keys(keys), "left")
    return joined.select(
        *(F.col(f"r.{k}") for k in keys),
        F.col(f"r.{value}").alias("expected"),
        F.col(f"l.{value}").alias("actual"),
        F.coalesce(F.abs(F.col(f"l.{value}") - F.col(f"r.{value}")) <= tolerance, F.lit(False)).alias("passed"),
    )
