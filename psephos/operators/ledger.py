"""Dated observations of contests: certification episodes, replay as of a date, actual results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def certification(snapshots: DataFrame, keys: Sequence[str], observed: str, eligible: str, as_of: str | None = None) -> DataFrame:
    """The latest observation of each key, with the first date of its current run of eligible ones, null if it is not eligible.

    Later observations than ``as_of`` are not seen, so a replay gives what was known. Null keys are keys. One
    aggregate per key: what is needed is the last row, and the last ineligible date before it.
    """
    seen = snapshots.where(F.col(observed) <= F.lit(as_of).cast(dict(snapshots.dtypes)[observed])) if as_of else snapshots
    ok = F.coalesce(F.col(eligible), F.lit(False))
    others = [c for c in snapshots.columns if c not in (*keys, observed)]
    w = Window.partitionBy(*keys).orderBy(observed)
    marked = seen.withColumns({"_ok": ok, "_run": F.sum((~ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    run = Window.partitionBy(*keys, "_run")
    dated = marked.withColumn("certified_on", F.min(F.when(F.col("_ok"), F.col(observed))).over(run))
    last = dated.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(observed)))).where("_n = 1")
    return last.select(*keys, observed, *others, F.when(F.col("_ok"), F.col("certified_on")).alias("certified_on"))


def repeated_observations(snapshots: DataFrame, keys: Sequence[str], observed: str) -> DataFrame:
    """Keys that are observed twice on a date."""
    return snapshots.groupBy(*keys, observed).count().where("count > 1")


def actuals(ledger: DataFrame, first: str, second: str, other: str, winner: str, first_name: str) -> DataFrame:
    """Two-party share and win of the first party; raises where a third one may have won a certified contest and no winner is named."""
    two = F.col(first) + F.col(second)
    named = F.coalesce(F.upper(F.col(winner)), F.lit(""))
    unclear = (F.col(other) > 0) & (F.col(other) >= F.greatest(first, second)) & (named == "") & F.col("certified_on").isNotNull()
    win = F.when(named != "", named == first_name).otherwise(F.col(first) > F.col(second))
    checked = F.when(F.coalesce(unclear, F.lit(False)), F.raise_error(F.lit("a possible third-party winner needs an explicit winner")).cast("boolean")).otherwise(win)
    return ledger.withColumns({"actual_share": F.col(first) / F.nullif(two, F.lit(0)), "actual_win": checked})
