"""Bootstrap of whole groups: replicates as rows.

Each group (an election cycle, say) shrinks to its centred Gram block over features and target, divided by its rows, so
groups weigh alike. A replicate draws as many groups as there are, with replacement; a draw is a hash of (seed,
replicate, slot), so the counts are the same on any cluster and in SQL. Draws are counted per replicate and group, joined
with the blocks and summed: a row of a few sums per replicate, solved for all replicates of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stored
from .simulation import uniform

#: Least information of the leading feature beside the controls.
IDENTIFIED = 1e-7


def _cells(names: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i + 1)]


def gram_blocks(df: DataFrame, features: Sequence[str], target: str, group: str) -> DataFrame:
    """A row per group, numbered from 0 in their order: _g, group, and c_i_j, the covariances of features and target within it."""
    names = [*features, target]
    value = {c: F.col(c).cast("double") for c in names}
    known = df.where(F.forall(F.array(*value.values()), lambda x: x.isNotNull() & ~F.isnan(x)) & F.col(group).isNotNull())
    cells = [F.covar_pop(value[names[i]], value[names[j]]).alias(f"c_{i}_{j}") for i, j in _cells(names)]
    blocks = known.groupBy(group).agg(*cells)  # a row per group
    return blocks.withColumn("_g", F.row_number().over(Window.orderBy(group)) - 1)


def group_counts(spark, n_groups: int, draws: int, seed: int) -> DataFrame:
    """(replicate, _g, n): how often each of ``draws`` replicates draws each of ``n_groups`` groups; replicate -1 has each once."""
    slots = spark.range(draws * n_groups).select(F.floor(F.col("id") / n_groups).alias("replicate"), (F.col("id") % n_groups).alias("slot"))
    u, _ = uniform(seed, "group", F.col("replicate"), F.col("slot"))
    drawn = slots.select("replicate", F.floor(u * n_groups).cast("int").alias("_g")).groupBy("replicate", "_g").agg(F.count("*").alias("n"))
    return drawn.unionByName(spark.range(n_groups).select(F.lit(-1).cast("bigint").alias("replicate"), F.col("id").cast("int").alias("_g"), F.lit(1).cast("bigint").alias("n")))


def slopes(df: DataFrame, lead: str, controls: Sequence[str], target: str, group: str, draws: int = 500, ridge: float = 1e-5, seed: int = 23) -> DataFrame:
    """(replicate, slope): the coefficient of ``lead`` beside the controls, which have a small ridge; -1 is the estimate itself.

    Null where a replicate does not identify it.
    """
    names, k = [lead, *controls, target], 1 + len(controls)
    blocks = stored(gram_blocks(df, [lead, *controls], target, group), "gram-blocks")
    counts = group_counts(df.sparkSession, max(1, blocks.count()), draws, seed)
    sums = counts.join(blocks, "_g").groupBy("replicate").agg(*(F.sum(F.col("n") * F.col(f"c_{i}_{j}")).alias(f"c_{i}_{j}") for i, j in _cells(names)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.zeros((len(batch), k + 1, k + 1))
            for i, j in _cells(names):
                m[:, i, j] = m[:, j, i] = batch.column(f"c_{i}_{j}").to_numpy(zero_copy_only=False)
            a = m[:, :k, :k] + np.diag([0.0] + [ridge] * (k - 1))
            rest = (a[:, :1, 1:] @ np.linalg.solve(a[:, 1:, 1:], a[:, 1:, :1]))[:, 0, 0] if k > 1 else np.zeros(len(batch))
            good = a[:, 0, 0] - rest >= IDENTIFIED
            found = np.full(len(batch), np.nan)
            found[good] = np.linalg.solve(a[good], m[good, :k, k:])[:, 0, 0]
            yield pa.record_batch({"replicate": batch.column("replicate"), "slope": pa.array(found, pa.float64(), mask=~good)})

    return sums.mapInArrow(solve, "replicate bigint, slope double")


def summary(found: DataFrame, n_groups: int, draws: int, min_groups: int = 2, least: float = 0.8) -> DataFrame:
    """One row: status, n_groups, slope, and the 5th and 95th percentile of the draws, centred on the estimate."""
    drawn = F.when(F.col("replicate") >= 0, F.col("slope"))
    one = found.agg(F.max(F.when(F.col("replicate") < 0, F.col("slope"))).alias("slope"), F.count(drawn).alias("n"), F.avg(drawn).alias("m"), F.percentile(drawn, 0.05).alias("a"), F.percentile(drawn, 0.95).alias("b"))
    status = F.when(F.lit(n_groups < min_groups), "insufficient_history").when(F.col("slope").isNull(), "unidentified").when(F.col("n") < least * draws, "bootstrap_failed").otherwise("estimated")
    known = lambda c: F.when(F.col("status") == "estimated", c)
    shift = F.col("slope") - F.col("m")
    return one.withColumn("status", status).select("status", F.lit(n_groups).cast("bigint").alias("n_groups"), known(F.col("slope")).alias("slope"), known(F.col("a") + shift).alias("low"), known(F.col("b") + shift).alias("high"))


def centred(found: DataFrame) -> DataFrame:
    """(number, slope): the identified draws, shifted so that their mean is the estimate, numbered from 0 by replicate."""
    drawn = found.where("replicate >= 0 and slope is not null")
    shift = found.agg(F.max(F.when(F.col("replicate") < 0, F.col("slope"))).alias("_e")).crossJoin(drawn.agg(F.avg("slope").alias("_m")))  # a row each
    number = F.row_number().over(Window.orderBy("replicate")) - 1  # a row per draw
    return drawn.crossJoin(shift).select(number.alias("number"), (F.col("slope") - F.col("_m") + F.col("_e")).alias("slope"))


def with_drawn_slope(draws: DataFrame, leans: DataFrame, unit: str, lean: str, slope_draws: DataFrame, seed: int = 7) -> DataFrame:
    """Simulated shares (sim, unit, share) moved by lean times one of the ``centred`` slopes per sim, picked by hash, in [0, 1]."""
    picks = draws.select("sim").distinct().crossJoin(slope_draws.agg(F.count("*").alias("_n")))  # one row on the right
    u, _ = uniform(seed + 1, "slope", F.col("sim"))
    slope = picks.select("sim", F.floor(u * F.col("_n")).cast("int").alias("number")).join(slope_draws, "number").select("sim", F.col("slope").alias("_slope"))
    moved = F.col("share") + F.col("_slope") * F.coalesce(F.col(lean), F.lit(0.0))
    return draws.join(leans.select(unit, lean), unit).join(slope, "sim").withColumn("share", F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).drop(lean, "_slope")
