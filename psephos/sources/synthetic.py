"""Synthetic returns that depend on seeds only: the same rows on any number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.simulation import normal, uniform


def returns(spark: SparkSession, states: int, districts: int, cycles: list[int], seed: int = 7) -> DataFrame:
    """Two major candidates and a third one per contest: (cycle, state, district, candidate, party, candidatevotes, totalvotes)."""
    contests = spark.range(states * districts).select((F.col("id") % states).cast("int").alias("state"), (F.floor(F.col("id") / states) + 1).cast("int").alias("district"))
    contests = contests.withColumn("cycle", F.explode(F.array(*map(F.lit, cycles))))
    names = (F.col("cycle"), F.col("state"), F.col("district"))
    share = F.least(F.greatest(0.5 + 0.12 * normal(seed, "state", F.col("state")) + 0.05 * normal(seed, "contest", *names), F.lit(0.02)), F.lit(0.98))
    turnout = F.floor(20_000 + 200_000 * uniform(seed, "turnout", *names)[0])
    third = F.floor(turnout * 0.04 * uniform(seed, "third", *names)[0])
    rows = contests.withColumns({"_t": turnout, "_x": third}).withColumn("_d", F.floor((F.col("_t") - F.col("_x")) * share))
    lines = F.array(
        F.struct(F.lit("D").alias("who"), F.lit("DEMOCRAT").alias("party"), F.col("_d").alias("candidatevotes")),
        F.struct(F.lit("R").alias("who"), F.lit("REPUBLICAN").alias("party"), (F.col("_t") - F.col("_x") - F.col("_d")).alias("candidatevotes")),
        F.struct(F.lit("T").alias("who"), F.lit("OTHER").alias("party"), F.col("_x").alias("candidatevotes")),
    )
    out = rows.withColumn("l", F.explode(lines))
    name = F.concat_ws(" ", F.lit("CANDIDATE"), "l.who", F.col("state").cast("string"), F.col("district").cast("string"))
    return out.select("cycle", "state", "district", name.alias("candidate"), "l.party", "l.candidatevotes", F.col("_t").alias("totalvotes"))


def polls(truth: DataFrame, share: str, per_contest: int, seed: int = 11) -> DataFrame:
    """``per_contest`` polls of each row of ``truth``: poll number, sample size and a share around the true one."""
    keys = [F.col(c) for c in truth.columns]
    rows = truth.withColumn("poll", F.explode(F.sequence(F.lit(1), F.lit(per_contest))))
    size = (400 + F.floor(1600 * uniform(seed, "size", *keys, F.col("poll"))[0])).cast("int")
    noise = normal(seed, "poll", *keys, F.col("poll"))
    sized = rows.withColumn("sample_size", size)
    return sized.withColumn("poll_share", F.least(F.greatest(F.col(share) + noise * F.sqrt(F.col(share) * (1 - F.col(share)) / F.col("sample_size")), F.lit(0.0)), F.lit(1.0)))
