"""Matching names to a roster in tiers, with abstention: more than one hit in the deciding tier is no match."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.staging import stored

TIERS = ("token_set", "last_first", "last_initial", "surname_unique", "tokens_within")


def _placed(df: DataFrame, id_: str, name: str, pool: Sequence[str]) -> DataFrame:
    """id, p (the pool as one key, null as null) and name."""
    place = F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(pool))), {"ignoreNullFields": "false"})
    return df.select(F.col(id_).alias("id"), place.alias("p"), F.col(name).alias("name"))


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with the name's key, surname variants, first name and words."""
    c = F.col("name")
    parts = {"words": c, "before": F.substring_index(c, ",", 1), "after": F.substring_index(c, ",", -1)}
    taken = df.select(*df.columns, *(text.name_tokens(part).alias(n) for n, part in parts.items()))
    return taken.select(*df.columns, text.key_of(F.col("words")).alias("key"), text.variants_of(F.col("before")).alias("lasts"), F.try_element_at("after", F.lit(1)).alias("first"), "words")


def _met(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that never passes a side through the driver: stored files and columns left out make names look small to Spark."""
    return df.join(other.hint("merge"), list(on), how)


_NAME = ("p", "name")


def _least_most(hits: DataFrame, roster: DataFrame, on: list[str]) -> DataFrame:
    """(p, name, low, high): the least and the greatest roster id that a name meets by equal keys; equal ones mean a single hit."""
    ends = roster.groupBy(*on).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return _met(hits, ends, on).groupBy(*_NAME).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def tiered(names: DataFrame, roster: DataFrame, row_id: str, name: str, roster_id: str, roster_name: str, pool: Sequence[str]) -> DataFrame:
    """(row_id, roster_id, method) for each name against the roster entries of its pool (equal ``pool`` columns, null as null).

    The strictest tier with any hit decides; several hits there give method ``ambiguous_<tier>`` and no id. A tier is an
    equality join on its key with the roster's least and greatest id per key, so names that many entries share cost no
    pairs. Only the last tier, words within a longer name, compares entries: those that have the name's rarest word in
    the pool, for names that no tier before has decided. A pool's equal names are decided once, and are one roster entry
    with its least and greatest id.
    """
    asked = _placed(names, row_id, name, pool)
    listed = _placed(roster, roster_id, roster_name, pool).groupBy(*_NAME).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    # Names are taken apart once, whatever number of tiers looks at them.
    left, right = stored(_keyed(asked.select(*_NAME).distinct()), "name-keys"), stored(_keyed(listed), "roster-keys")
    spread = lambda df: df.withColumn("last", F.explode("lasts")).withColumn("initial", F.substring("first", 1, 1))
    a, b = spread(left), spread(right)
    with_first = a.where(F.coalesce(F.col("first"), F.lit("")) != "")
    tiers = [
        _least_most(left.where("key <> ''"), right, ["p", "key"]),
        _least_most(with_first, b, ["p", "last", "first"]),
        _least_most(with_first, b, ["p", "last", "initial"]),
        _least_most(a, b, ["p", "last"]),
    ]
    hits = functools.reduce(DataFrame.unionByName, (found.withColumn("tier", F.lit(k)) for k, found in enumerate(tiers)))
    decided = stored(hits.groupBy(*_NAME).agg(F.min(F.struct("tier", "low", "high")).alias("m")), "decided")
    word = right.select("p", F.explode(F.array_distinct("words")).alias("word"), "low", "high", "words")
    often = word.groupBy("p", "word").agg(F.count("*").alias("n"))
    longer = _met(left.select(*_NAME, F.array_distinct("words").alias("own")).where(F.size("own") >= 2), decided.select(*_NAME), _NAME, "left_anti")
    # A word that the pool does not have rules all its entries out.
    known = _met(longer.select(*_NAME, "own", F.explode("own").alias("word")), often, ["p", "word"])
    rarest = known.groupBy(*_NAME, "own").agg(F.min(F.struct("n", "word")).alias("m"), F.count("*").alias("known")).where(F.col("known") == F.size("own"))
    inside = _met(rarest.select(*_NAME, "own", F.col("m.word").alias("word")), word, ["p", "word"])
    within = inside.where(F.size(F.array_except("own", "words")) == 0).groupBy(*_NAME).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    every = decided.select(*_NAME, "m.*").unionByName(within.withColumn("tier", F.lit(len(TIERS) - 1)))
    method = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    single = F.col("low") == F.col("high")
    found = every.select(*_NAME, F.when(single, F.col("low")).alias("hit"), F.when(single, method).otherwise(F.concat(F.lit("ambiguous_"), method)).alias("method"))
    return _met(asked, found, _NAME, "left").select(F.col("id").alias(row_id), F.col("hit").alias(roster_id), F.coalesce("method", F.lit("none")).alias("method"))


def seat_then_state(names: DataFrame, roster: DataFrame, row_id: str, name: str, roster_id: str, roster_name: str, seat: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Match in the seat's pool; only where that finds nothing at all, in the state's. Not people: ``not_a_person``."""
    people = names.where(text.is_person(F.col(name)))
    narrow = stored(tiered(people, roster, row_id, name, roster_id, roster_name, seat), "seat-matches")
    rest = _met(people, narrow.where("method = 'none'").select(row_id), [row_id], "left_semi")
    wide = tiered(rest, roster, row_id, name, roster_id, roster_name, state).where(F.col(roster_id).isNotNull())
    wide = wide.select(row_id, F.col(roster_id).alias("_wide"), F.concat(F.lit("state_"), "method").alias("_method"))
    both = _met(narrow, wide, [row_id], "left").select(row_id, F.coalesce("_wide", roster_id).alias(roster_id), F.coalesce("_method", "method").alias("method"))
    return _met(names.select(row_id), both, [row_id], "left").withColumn("method", F.coalesce("method", F.lit("not_a_person")))


def resolved(matches: DataFrame, overrides: DataFrame, row_id: str, roster_id: str) -> tuple[DataFrame, DataFrame]:
    """Matches with reviewed overrides in place of them, and the rows that stay ambiguous."""
    joined = matches.join(overrides.select(row_id, F.col(roster_id).alias("_o")), row_id, "left")
    out = joined.select(row_id, F.coalesce("_o", roster_id).alias(roster_id), F.when(F.col("_o").isNotNull(), "reviewed").otherwise(F.col("method")).alias("method"))
    return out, out.where(F.col("method").startswith("ambiguous"))


def crosswalk(names: DataFrame, roster: DataFrame, covered: DataFrame, overrides: DataFrame, row_id: str, name: str, roster_id: str, roster_name: str, scope: Sequence[str], seat: Sequence[str], state: Sequence[str]) -> DataFrame:
    """(row_id, roster_id, method) for each ballot name: reviewed overrides first, then the tiers in the seat's and the state's pool.

    Entries that are no persons match nothing (``not_a_person``). Names of a ``scope`` (cycle and office, say) that
    ``covered`` does not list have no roster to miss: ``no_roster`` instead of ``none``.
    """
    matched, _ = resolved(seat_then_state(names, roster, row_id, name, roster_id, roster_name, seat, state), overrides, row_id, roster_id)
    known = names.select(row_id, *scope).join(covered.select(*scope).distinct().withColumn("_c", F.lit(True)), list(scope), "left").select(row_id, F.coalesce("_c", F.lit(False)).alias("_c"))
    method = F.when(~F.col("_c") & (F.col("method") == "none"), "no_roster").otherwise(F.col("method"))
    return matched.join(known, row_id).select(row_id, roster_id, method.alias("method"))


#: Stages that decide a race after its general election.
RUNOFFS = ("runoff", "gen runoff")


def person_winners(links: DataFrame, votes: DataFrame, race: str, name: str, roster_id: str, stage: str, count: str) -> DataFrame:
    """(race, name, roster_id, method, votes): the winner of each race among persons: the latest deciding stage, then votes, then the name.

    ``links`` (race, name, roster_id, method) is a crosswalk; the most votes of a race may be those of exhausted ballots or
    write-ins as a whole, which are no persons. All columns are of one row. Unknown votes come last.
    """
    people = links.where(text.is_person(F.col(name))).join(votes.select(race, name, stage, count), [race, name])
    rank = F.struct(F.lower(F.trim(stage)).isin(*RUNOFFS).cast("int").alias("r"), F.coalesce(F.col(count), F.lit(-1)).alias("v"))
    best = people.groupBy(race).agg(F.max(rank).alias("_m"))
    tied = people.join(best, race).where(rank == F.col("_m"))
    return tied.groupBy(race).agg(F.min_by(F.struct(name, roster_id, "method", F.col(count).alias("votes")), name).alias("w")).select(race, "w.*")
