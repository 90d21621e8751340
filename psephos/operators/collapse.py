"""From ballot lines to races: vote modes, party lines, shares, contest roll-ups.

All functions take and return DataFrames and name columns by arguments; each needs one shuffle on its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import observed


def is_general(stage: str, stages: Sequence[str], default: str = "gen") -> Column:
    """Whether a row is of one of the named stages; a null stage is ``default``."""
    return F.lower(F.trim(F.coalesce(F.col(stage), F.lit(default)))).isin([s.lower() for s in stages])


def write_general_stage(df: DataFrame, path: str, stage: str, stages: Sequence[str], default: str = "gen") -> dict:
    """Writes the rows of the named stages as Parquet; how many were written and dropped is counted in the same pass."""
    keep = is_general(stage, stages, default)
    return observed.written(df, path, {"kept": F.count_if(keep), "dropped_non_general": F.count_if(~keep)}, keep)


def unreported_to_null(votes: Column, sentinel: int = -1) -> Column:
    """Counts at or below the sentinel mean that nothing was reported."""
    return F.when(votes > sentinel, votes)


def collapse_modes(df: DataFrame, keys: Sequence[str], mode: str, votes: str, total: str = "total") -> DataFrame:
    """One row per key: the published total row where there is one, else the sum of the breakdown rows.

    A null mode is a total; several total rows of a key are summed. Null votes count as 0, a null key is a key.
    """
    is_total = F.lower(F.trim(F.coalesce(F.col(mode), F.lit(total)))) == total.lower()
    value = F.coalesce(F.col(votes), F.lit(0))
    sums = df.groupBy(*keys).agg(
        F.sum(F.when(is_total, value)).alias("_total"),
        F.sum(value).alias("_all"),
        F.count("*").alias("n_rows"),
    )
    return sums.select(*keys, F.coalesce("_total", "_all").alias(votes), "n_rows")


def collapse_party_lines(df: DataFrame, race: str, candidate: str, party: str, votes: str, majors: Sequence[str]) -> DataFrame:
    """One row per (race, candidate): summed votes, and the attributes of the major-party line, else of the largest line.

    Rows without a candidate are kept as they are. ``fusion_flag`` tells merged rows.
    """
    named = F.coalesce(F.col(candidate).cast("string") != "", F.lit(False))
    others = [c for c in df.columns if c not in (race, candidate, votes)]
    rank = F.struct(F.col(party).isin(list(majors)).cast("int").alias("m"), F.coalesce(F.col(votes), F.lit(-1)).alias("v"), *others)
    merged = (
        df.where(named)
        .groupBy(race, candidate)
        .agg(F.max(rank).alias("_best"), F.sum(votes).alias(votes), (F.count("*") > 1).alias("fusion_flag"))
        .select(race, candidate, *(F.col(f"_best.{c}").alias(c) for c in others), votes, "fusion_flag")
    )
    return merged.unionByName(df.where(~named).withColumn("fusion_flag", F.lit(False)))


def mask_unreported(df: DataFrame, race: str, total: str, votes: str) -> DataFrame:
    """Null votes in races of which no row has a total."""
    known = F.count(total).over(Window.partitionBy(race)) > 0
    return df.withColumn(votes, F.when(known, F.col(votes)))


def share_of_race(df: DataFrame, race: str, votes: str, name: str = "vote_share") -> DataFrame:
    """Votes over the race's votes; null where no votes were counted."""
    total = F.sum(votes).over(Window.partitionBy(race))
    return df.withColumn(name, F.when(total > 0, F.col(votes) / total))


def uncontested(df: DataFrame, race: str, candidate: str, votes: str, writein: str | None = None) -> DataFrame:
    """Each race with how many candidates, write-ins aside, got votes, and whether these are fewer than two."""
    counts = (F.col(votes) > 0) & (F.col(candidate).cast("string") != "")
    if writein:
        counts &= ~F.coalesce(F.col(writein), F.lit(False))
    return df.groupBy(race).agg(F.countDistinct(F.when(counts, F.col(candidate))).alias("n_contenders")).withColumn("uncontested_flag", F.col("n_contenders") < 2)


def roll_up_races(df: DataFrame, race: str, candidate: str, party: str, votes: str, first: str, second: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per race: winner, runner-up, margins, votes of the two parties and of others, two-party share.

    Null votes rank last; a race whose winner has none has null counts and shares. Ties go to the smaller candidate.
    The two best rows come from sorted aggregates, so a race needs no window over all of its rows.
    """
    order = F.struct((-F.coalesce(F.col(votes), F.lit(float("-inf")))).alias("o"), F.col(candidate).alias("c"), F.col(party).alias("p"), F.col(votes).alias("v"))
    rows = df.groupBy(race, *keep).agg(
        F.min(order).alias("a"),
        F.expr(f"array_sort(collect_list({_order_sql(candidate, party, votes)}))").alias("l"),
        F.count_if(F.col(votes) > 0).alias("n_candidates"),
        F.sum(votes).alias("t"),
        F.coalesce(F.sum(F.when(F.col(party) == first, F.col(votes))), F.lit(0)).alias("d"),
        F.coalesce(F.sum(F.when(F.col(party) == second, F.col(votes))), F.lit(0)).alias("r"),
    )
    b = F.try_element_at("l", F.lit(2))
    counted = F.col("a.v").isNotNull()
    of = lambda c: F.when(counted, c)
    runner_votes = F.when(counted, F.coalesce(b["v"], F.lit(0)))
    return rows.select(
        race,
        *keep,
        "n_candidates",
        of(F.col("t")).alias("total_votes"),
        F.col("a.c").alias("winner"),
        F.col("a.p").alias("winner_party"),
        F.col("a.v").alias("winner_votes"),
        b["c"].alias("runner_up"),
        b["p"].alias("runner_up_party"),
        runner_votes.alias("runner_up_votes"),
        of(F.col("a.v") - runner_votes).alias("margin_votes"),
        of((F.col("a.v") - runner_votes) / F.nullif("t", F.lit(0))).alias("margin_share"),
        of(F.col("d")).alias("first_votes"),
        of(F.col("r")).alias("second_votes"),
        of(F.col("t") - F.col("d") - F.col("r")).alias("other_votes"),
        of(F.col("d") / F.nullif(F.col("d") + F.col("r"), F.lit(0))).alias("two_party_share"),
    )


def _order_sql(candidate: str, party: str, votes: str) -> str:
    return f"named_struct('o', -coalesce({votes}, double('-Infinity')), 'c', {candidate}, 'p', {party}, 'v', {votes})"


def contest_buckets(df: DataFrame, keys: Sequence[str], party: str, votes: str, first: str, second: str) -> DataFrame:
    """Per contest the votes of two parties and all others, and the top candidate's party. Null keys are keys."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col(votes))), F.lit(0))
    is_other = ~F.coalesce(F.col(party).isin(first, second), F.lit(False))
    return df.groupBy(*keys).agg(
        part(F.col(party) == first).alias("first_votes"),
        part(F.col(party) == second).alias("second_votes"),
        part(is_other).alias("other_votes"),
        F.min(F.struct((-F.col(votes)).alias("v"), F.col(party).alias("p")))["p"].alias("winner_party"),
    )


def district_tally(df: DataFrame, keys: Sequence[str], precinct: str, party: str, votes: str, first: str, second: str) -> DataFrame:
    """Per district the votes of two parties and how many different precincts have rows there."""
    of = lambda p: F.sum(F.when(F.col(party) == p, F.col(votes)).otherwise(0.0))
    return df.groupBy(*keys).agg(of(first).alias("first_votes"), of(second).alias("second_votes"), F.countDistinct(precinct).alias("n_precincts"))


def pivot_parties(df: DataFrame, keys: Sequence[str], party: str, votes: str, parties: Sequence[str]) -> DataFrame:
    """A column of votes per named party, 0 where a key has none."""
    return df.groupBy(*keys).pivot(party, list(parties)).agg(F.sum(votes)).na.fill(0, list(parties))
