"""As-of, interval and validated joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import geometry


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, payload: Sequence[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """Each left row with ``payload`` of the latest right row of its key at or before its time (strict: before).

    Both sides are united and the last right payload is carried forward, so a key costs its rows and never their
    pairs. Keys that are null match nothing. Right rows of one time: the largest ``tie`` (else payload) wins.
    """
    carried = F.struct(F.col(on).alias("_at"), *payload)
    r = right.where(_known(by)).select(*by, on, F.lit(1 if strict else 0).alias("_side"), carried.alias("_p"), *([F.col(tie).alias("_tie")] if tie else []))
    own = F.struct(*[c for c in left.columns if c not in by])
    l_ = left.select(*by, on, F.lit(0 if strict else 1).alias("_side"), own.alias("_l"))
    both = l_.unionByName(r, allowMissingColumns=True)
    order = [F.col(on), F.col("_side"), *([F.col("_tie")] if tie else []), F.col("_p")]
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = both.withColumn("_p", F.last("_p", ignorenulls=True).over(window)).where("_l is not null")
    return kept.select(*by, "_l.*", *(F.col(f"_p.{c}").alias(c) for c in payload), F.col("_p._at").alias(f"matched_{on}"))


def _known(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).isNotNull()
    return out


def within_interval(points: DataFrame, intervals: DataFrame, by: Sequence[str], on: str, first: str, last: str, open_end: int = 9999) -> DataFrame:
    """Points with every interval of their key that covers them; a null end is open. A null key matches a null key."""
    p, i = points.alias("p"), intervals.alias("i")
    condition = F.col(f"p.{on}").between(F.coalesce(F.col(f"i.{first}"), F.lit(-open_end)), F.coalesce(F.col(f"i.{last}"), F.lit(open_end)))
    for k in by:
        condition &= F.col(f"p.{k}").eqNullSafe(F.col(f"i.{k}"))
    return p.join(i, condition).select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"i.{c}") for c in intervals.columns if c not in by))


def overlapping(intervals: DataFrame, by: Sequence[str], key: str, first: str, last: str, open_end: int = 9999) -> DataFrame:
    """Keys whose interval begins before an earlier one of its group ends: (by, key, first). One sort per group, no pairs."""
    ends = intervals.withColumns({"_a": F.coalesce(first, F.lit(-open_end)), "_b": F.coalesce(last, F.lit(open_end))})
    before = Window.partitionBy(*by).orderBy("_a", "_b", key).rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn("_reach", F.max("_b").over(before)).where("_reach >= _a").select(*by, key, first)


def shifted_self(df: DataFrame, keys: Sequence[str], period: str, step: int, values: Sequence[str], prefix: str = "prior_") -> DataFrame:
    """Each row with ``values`` of the row of the same keys ``step`` periods earlier; none: null."""
    earlier = df.select(*keys, (F.col(period) + step).alias(period), *(F.col(v).alias(prefix + v) for v in values))
    return df.join(earlier, [*keys, period], "left")


def validated(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", expect: str = "many_to_one") -> DataFrame:
    """Join that raises at run time if a key of a side that should be unique repeats; null keys match null keys.

    The check is a count over the key, part of the same job.
    """
    one_left, one_right = (side == "one" for side in expect.split("_to_"))

    def checked(df: DataFrame, unique: bool) -> DataFrame:
        if not unique:
            return df
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("_n", F.when(n > 1, F.raise_error(F.lit(f"keys {list(keys)} repeat in a join that expects {expect}"))).otherwise(n)).where("_n = 1").drop("_n")

    a, b = checked(left, one_left).alias("a"), checked(right, one_right).alias("b")
    condition = F.lit(True)
    for k in keys:
        condition &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, condition, how).select(*(F.col(f"a.{c}") for c in left.columns), *(F.col(f"b.{c}") for c in right.columns if c not in keys))


def attach_evidence(df: DataFrame, evidence: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``value`` where its key has exactly one row of evidence; status missing, ambiguous or attached."""
    found = evidence.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias(value))
    joined = df.join(found, list(keys), "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("attached")
    return joined.withColumns({value: F.when(F.col("_n") == 1, F.col(value)), "status": status}).drop("_n")


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str) -> DataFrame:
    """Each point with its polygon (of one ring, ``ring``; point columns x, y) and status placed, unplaced or overlap; see ``geometry``."""
    return geometry.points_in_shapes(points, polygons.withColumn("_shape", F.array(F.array("ring"))), point_id, polygon_id, "_shape")
