"""Quality gates: each is one pass over a table and gives rows (check_name, passed, n_bad)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(df: DataFrame, rules: Mapping[str, Column], unique: Sequence[str] | None = None, not_empty: bool = True) -> DataFrame:
    """A row per rule with how many rows break it; a null outcome breaks it. Also uniqueness of a key (nulls are values) and not_empty."""
    bad = {name: F.count_if(~F.coalesce(ok, F.lit(False))) for name, ok in rules.items()}
    one = df.agg(F.count("*").alias("_n"), *(c.alias(f"_{i}") for i, c in enumerate(bad.values())))
    rows = [F.struct(F.lit(name).alias("check_name"), (F.col(f"_{i}") == 0).alias("passed"), F.col(f"_{i}").cast("bigint").alias("n_bad")) for i, name in enumerate(bad)]
    if not_empty:
        rows.append(F.struct(F.lit("not_empty").alias("check_name"), (F.col("_n") > 0).alias("passed"), (F.col("_n") == 0).cast("bigint").alias("n_bad")))
    out = one.select(F.inline(F.array(*rows)))
    if unique:
        repeated = df.groupBy(*unique).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n_bad"))
        out = out.unionByName(repeated.select(F.lit("unique_key").alias("check_name"), (F.col("n_bad") == 0).alias("passed"), "n_bad"))
    return out


def depends_only_on(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each column how many keys have more than one value of it; null is a value."""
    several = [((F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))) > 1).cast("bigint").alias(c) for c in columns]
    one = df.groupBy(*keys).agg(*several).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(c) == 0).alias("passed"), F.col(c).alias("n_bad")) for c in columns))))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows that break any rule, with the names of the broken ones."""
    named = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return df.withColumn("broken", F.array_compact(named)).where(F.size("broken") > 0)


def require(checks: DataFrame, what: str) -> DataFrame:
    """``checks`` that raises, when it is run, on a check that has not passed."""
    message = F.concat(F.lit(f"{what}: "), F.col("check_name"), F.lit(" is broken by "), F.col("n_bad").cast("string"), F.lit(" rows"))
    return checks.withColumn("passed", F.when(F.col("passed"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def covered_once(intervals: DataFrame, keys: Sequence[str], periods: Sequence[int], first: str, last: str, open_end: int = 9999) -> DataFrame:
    """Keys and periods that not exactly one interval covers: (keys, period, n_plans)."""
    every = intervals.select(*keys).distinct().withColumn("period", F.explode(F.array(*map(F.lit, periods))))
    spans = intervals.where(F.col(first).isNotNull()).select(*keys, F.explode(F.array(*map(F.lit, periods))).alias("period"), first, last)
    live = spans.where(F.col("period").between(F.col(first), F.coalesce(F.col(last), F.lit(open_end)))).groupBy(*keys, "period").agg(F.count("*").alias("n_plans"))
    return every.join(live, [*keys, "period"], "left").withColumn("n_plans", F.coalesce("n_plans", F.lit(0))).where("n_plans <> 1")


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Columns that ``df`` lacks, added with their default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def conformed(df: DataFrame, names: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Columns renamed from their aliases; raises if a required one is missing."""
    out = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return out


#: Highest tier of a source that may be persisted.
MOST_TIER = 2


def persistable(df: DataFrame, tier: int, personal: Sequence[str] = ()) -> DataFrame:
    """``df`` without personal columns; raises if its tier is too private."""
    if tier > MOST_TIER:
        raise ValueError(f"tier {tier} may not be persisted")
    return df.drop(*personal)
