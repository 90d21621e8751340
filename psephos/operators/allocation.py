"""Proportional allocation of votes to areas, conserving what is placed, and transfers between plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_units(rows: DataFrame, unit: Sequence[str], area: str, votes: str) -> DataFrame:
    """Each unit with its area if its rows with positive votes name exactly one, and whether it is single, ambiguous or silent."""
    positive = F.when(F.col(votes) > 0, F.col(area))
    found = rows.groupBy(*unit).agg(F.countDistinct(positive).alias("n_areas"), F.min(positive).alias("_a"))
    status = F.when(F.col("n_areas") == 1, "single").when(F.col("n_areas") > 1, "ambiguous").otherwise("silent")
    return found.select(*unit, "n_areas", F.when(F.col("n_areas") == 1, F.col("_a")).alias(area), status.alias("status"))


def gap_filled(preferred: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``preferred`` and those of ``fallback`` whose keys it lacks, with ``weight_source``."""
    rest = fallback.join(preferred.select(*keys).distinct(), list(keys), "left_anti")
    return preferred.withColumn("weight_source", F.lit("preferred")).unionByName(rest.withColumn("weight_source", F.lit("fallback")))


def allocate(votes: DataFrame, weights: DataFrame, region: Sequence[str], area: str, value: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """Votes of each region spread over its areas by their share of the region's weight: (region, area, value), and the regions that have no weight."""
    total = F.sum(weight).over(Window.partitionBy(*region))
    fractions = weights.withColumn("_f", F.col(weight) / F.nullif(total, F.lit(0.0))).where("_f is not null").select(*region, area, "_f")
    joined = votes.join(fractions, list(region), "left")
    placed = joined.where("_f is not null").withColumn(value, F.col(value) * F.col("_f")).drop("_f")
    return placed, joined.where("_f is null").select(*votes.columns)


def baseline(direct: DataFrame, allocated: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Direct and allocated sums together, the allocated share, and a quality flag against the median size."""
    both = direct.select(*keys, *values, F.lit(0).alias("_a")).unionByName(allocated.select(*keys, *values, F.lit(1).alias("_a")))
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    sums = both.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values), (F.sum(F.when(F.col("_a") == 1, total)) / F.nullif(F.sum(total), F.lit(0.0))).alias("allocated_share"))
    sized = sums.withColumn("_t", total)
    median = sized.agg(F.percentile("_t", 0.5).alias("_m"))
    ratio = F.col("_t") / F.nullif("_m", F.lit(0.0))
    quality = F.when(ratio < 0.5, "low_total").when(F.coalesce("allocated_share", F.lit(0.0)) > 0.5, "mostly_allocated").otherwise("ok")
    out = sized.crossJoin(F.broadcast(median))  # one row
    return out.select(*keys, *values, F.coalesce("allocated_share", F.lit(0.0)).alias("allocated_share"), ratio.alias("size_ratio"), quality.alias("quality"))


def worst_of(flags: DataFrame, keys: Sequence[str], flag: str, order: Sequence[str]) -> DataFrame:
    """One flag per key, the first in ``order`` that it has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(flag))
    return flags.groupBy(*keys).agg(F.min(rank).alias("_r")).select(*keys, F.element_at(F.array(*map(F.lit, order)), F.col("_r").cast("int")).alias(flag))


def apportion(votes: DataFrame, blocks: DataFrame, unit: Sequence[str], region: Sequence[str], block: str, population: str, value: str) -> DataFrame:
    """Votes by block, in two passes: a unit's votes go to its blocks by population, evenly if none has any; votes of
    units without blocks go to the region's blocks by the votes that these got, by population if none got any.

    Returns (region, block, value, unplaced): regions without any block keep their votes as ``unplaced`` with a null block.
    """
    by_unit = Window.partitionBy(*region, *unit)
    share = F.when(F.sum(population).over(by_unit) > 0, F.col(population) / F.nullif(F.sum(population).over(by_unit), F.lit(0))).otherwise(1 / F.count("*").over(by_unit))
    shares = blocks.where(_all_known(unit)).select(*region, *unit, block, share.alias("_s"))
    joined = votes.join(shares, [*region, *unit], "left")
    first = joined.where("_s is not null").groupBy(*region, block).agg(F.sum(F.col(value) * F.col("_s")).alias("_v"))
    rest = joined.where("_s is null").groupBy(*region).agg(F.sum(value).alias("_rest"))
    every = blocks.groupBy(*region, block).agg(F.sum(population).alias("_p")).join(first, [*region, block], "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    whole = Window.partitionBy(*region)
    turnout = F.sum("_v").over(whole)
    people = F.sum("_p").over(whole)
    second = F.when(turnout > 0, F.col("_v") / F.nullif(turnout, F.lit(0.0))).when(people > 0, F.col("_p") / F.nullif(people, F.lit(0))).otherwise(1 / F.count("*").over(whole))
    sized = every.withColumn("_share", second).join(rest, list(region), "full_outer")
    added = F.col("_v") + F.coalesce("_rest", F.lit(0.0)) * F.col("_share")
    return sized.select(*region, block, F.coalesce(added, F.lit(0.0)).alias(value), F.when(F.col(block).isNull(), F.col("_rest")).otherwise(0.0).alias("unplaced"))


def _all_known(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).isNotNull()
    return out


def transfer(blocks: DataFrame, new: str, old: str, first: str, second: str, located: str) -> DataFrame:
    """Per new area: votes, share, the share of votes from blocks that are located, and of the old area that gives most; rows without an old area count in neither numerator."""
    total = F.col(first) + F.col(second)
    parts = blocks.groupBy(new, old).agg(F.sum(first).alias("a"), F.sum(second).alias("b"), F.sum(F.when(F.col(located), total)).alias("g"), F.sum(total).alias("t"))
    sums = parts.groupBy(new).agg(
        F.sum("a").alias("first_votes"),
        F.sum("b").alias("second_votes"),
        F.max(F.when(F.col(old).isNotNull(), F.col("t"))).alias("_most"),
        F.sum("g").alias("_g"),
        F.sum("t").alias("_t"),
        F.count_if(F.col(old).isNotNull()).alias("n_sources"),
    )
    over = lambda x: F.coalesce(x, F.lit(0.0)) / F.nullif("_t", F.lit(0.0))
    return sums.select(
        new, "first_votes", "second_votes", (F.col("first_votes") / F.nullif("_t", F.lit(0.0))).alias("share"), over(F.col("_most")).alias("largest_source_share"), over(F.col("_g")).alias("located_share"), "n_sources"
    )


def usable(placed_share: float, areas: DataFrame, expected: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """One row (usable, placed_share, missing): enough votes placed, and every expected area produced."""
    missing = expected.join(areas, key, "left_anti").agg(F.count("*").alias("missing"))
    return missing.select(((F.lit(placed_share) >= least) & (F.col("missing") == 0)).alias("usable"), F.lit(placed_share).alias("placed_share"), "missing")


def error_bands(df: DataFrame, share: str, error: str, edges: Sequence[float]) -> DataFrame:
    """n, mean and 90th percentile of absolute errors in bands of ``share`` (band k: edges[k-1] <= share < edges[k])."""
    band = sum(((F.col(share) >= e).cast("int") for e in edges[1:]), (F.col(share) >= edges[0]).cast("int"))
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.percentile(F.abs(error), 0.9).alias("p90"))
