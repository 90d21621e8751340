"""Sealed forecasts: registered with a digest, and scored only if the rows that are scored are the ones that were sealed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import snapshots
from .panels import split_scores

#: Half width of the interval of 90 % of a normal distribution.
Z90 = 1.6448536269514722
#: What is sealed of a prediction, besides its key.
SEALED = ("share", "sigma", "p")


def registration(predictions: DataFrame, key: str, name: str, registered_on: str, values: Sequence[str] = SEALED) -> DataFrame:
    """One row: name, registered_on, columns, n and sha256 of the predictions' key and values. Raises, when run, if a key repeats."""
    rows = predictions.select(key, *values)
    once = rows.groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("_most"))
    found = snapshots.digest(rows, []).crossJoin(F.broadcast(once))  # one row each
    checked = F.when(F.col("_most") > 1, F.raise_error(F.lit("a key is sealed twice"))).otherwise(F.col("sha256"))
    return found.select(F.lit(name).alias("name"), F.lit(registered_on).cast("date").alias("registered_on"), F.array(*map(F.lit, (key, *values))).alias("columns"), "n", checked.alias("sha256"))


def verified(predictions: DataFrame, seal: DataFrame, key: str, values: Sequence[str] = SEALED) -> DataFrame:
    """The key and values of the predictions; raises, when run, unless their digest is the sealed one.

    The digest is computed from the very rows that go on, in the same run: a changed, missing or added row refuses it all.
    ``seal`` has one row.
    """
    rows = predictions.select(key, *values)
    now = snapshots.digest(rows, []).select(F.col("n").alias("_n"), F.col("sha256").alias("_now"))
    both = now.crossJoin(F.broadcast(seal.select(F.col("n").alias("_sealed_n"), F.col("sha256").alias("_sealed"))))  # one row each
    same = F.when(F.col("_now") == F.col("_sealed"), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("predictions differ from the sealed ones:"), F.col("_n").cast("string"), F.lit("rows, sealed"), F.col("_sealed_n").cast("string"))).cast("boolean"))
    return rows.crossJoin(F.broadcast(both.select(same.alias("_same")))).where("_same").drop("_same")


def scores(predictions: DataFrame, seal: DataFrame, actuals: DataFrame, key: str, splits: Sequence[str], as_of: str, groups: DataFrame | None = None, values: Sequence[str] = SEALED) -> DataFrame:
    """Errors of verified predictions (share, sigma, p) against certified results, overall and by split.

    ``actuals``: key, actual_share, actual_win, certified_on; contests that are not certified by ``as_of``, or before the
    forecast was registered, are not scored. ``groups`` has the key and the columns of ``splits``. Raises as ``verified``.
    """
    known = actuals.where(F.col("certified_on").cast("date") <= F.lit(as_of).cast("date")).crossJoin(F.broadcast(seal.select("registered_on"))).where(F.col("certified_on").cast("date") > F.col("registered_on"))
    scored = verified(predictions, seal, key, values).join(known.select(key, "actual_share", "actual_win"), key).where("actual_share is not null")
    if groups is not None:
        scored = scored.join(groups.select(key, *splits), key, "left")
    y, error = F.col("actual_win").cast("double"), F.col("share") - F.col("actual_share")
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return split_scores(
        scored,
        splits,
        [
            F.count("*").alias("n"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
            F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("log_score"),
            F.avg(((F.col("p") > 0.5) == F.col("actual_win")).cast("double")).alias("called"),
            F.avg((F.abs(error) <= Z90 * F.col("sigma")).cast("double")).alias("coverage_90"),
        ],
    )


def coverage(predictions: DataFrame, actuals: DataFrame, key: str, as_of: str) -> DataFrame:
    """(status, n): how many sealed contests are scored, not certified by the date, or have no result at all, and results that were not sealed."""
    status = F.when(F.col("_p").isNull(), "not_sealed").when(F.col("_a").isNull(), "no_result").when(F.coalesce(F.col("certified_on").cast("date") <= F.lit(as_of).cast("date"), F.lit(False)), "scored").otherwise("not_certified")
    both = predictions.select(key, F.lit(True).alias("_p")).join(actuals.select(key, "certified_on", F.lit(True).alias("_a")), key, "full_outer")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
