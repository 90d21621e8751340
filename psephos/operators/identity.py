"""Two-sided identity: ballot names and roster entries are assigned to each other, or neither is.

Names and entries form a bipartite graph. Tiers of keys give its edges: two nodes of one pool with an equal key of a tier
are joined by it, reviewed pairs are joined or kept apart whatever their keys. In each round every node looks at its
strictest tier with any partner left; a pair in which each is the other's only partner there is fixed, and both leave the
graph. That can make others unique, so rounds go on until nothing changes, at most ``ROUNDS`` times. The rest abstains.

Edges are never made: a key's group is its two counts and least ids, and reviewed rejections within a group are taken off
its count. A round is three aggregates over the nodes that are left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.staging import stored

ROUNDS = 8


def _joined(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` by merging: both grow with the input, and stored keys are far larger than their files, so neither is broadcast."""
    return a.join(b.hint("merge"), on, how)


def _nodes(df: DataFrame, id_: str, pool: Sequence[str], tiers: Sequence[str]) -> DataFrame:
    """(id, tier, key) for each key that is there; null pools are equal, null and empty keys are none."""
    place = lambda t: F.to_json(F.struct(*(F.col(c).cast("string").alias(f"p{i}") for i, c in enumerate(pool)), F.col(t).cast("string").alias("k")), {"ignoreNullFields": "false"})
    keys = F.array(*(F.struct(F.lit(i).alias("tier"), F.when(F.coalesce(F.col(t).cast("string"), F.lit("")) != "", place(t)).alias("key")) for i, t in enumerate(tiers)))
    return df.select(F.col(id_).alias("id"), F.explode(keys).alias("n")).select("id", "n.tier", "n.key").where("key is not null")


def _shared(apart: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(l, r, tier, key) of the pairs (l, r) with an equal key in a tier; keeping others apart changes nothing."""
    left, right = a.select(F.col("id").alias("l"), "tier", "key"), b.select(F.col("id").alias("r"), "tier", "key")
    return _joined(_joined(apart, left, "l"), right, ["r", "tier", "key"]).select("l", "r", "tier", "key")


def _partners(own: DataFrame, other: DataFrame, kept_apart: DataFrame) -> DataFrame:
    """(id, tier, n, sole) of each node of ``own``: its strictest tier with a partner, how many it has there, and the partner if it is one.

    ``kept_apart`` has (id, not_id, tier, key) of pairs that share the key and are no partners. They are taken off the
    key's count; entries are looked at one by one only where that leaves a single one, so by one more than are taken off.
    """
    groups = other.groupBy("tier", "key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    lost = _joined(kept_apart, other.withColumnRenamed("id", "not_id"), ["not_id", "tier", "key"])
    gone = lost.groupBy("id", "tier", "key").agg(F.count("*").alias("lost"))
    last = _joined(gone, groups, ["tier", "key"]).where(F.col("n") - F.col("lost") == 1).select("id", "tier", "key")
    last = _joined(_joined(last, other.withColumnRenamed("id", "not_id"), ["tier", "key"]), lost.select("id", "not_id", "tier"), ["id", "not_id", "tier"], "left_anti")
    none = F.lit(None).cast(dict(other.dtypes)["id"])
    rows = _joined(own, groups, ["tier", "key"]).select("id", "tier", "n", F.lit(0).alias("lost"), "least", none.alias("last"))
    rows = rows.unionByName(gone.select("id", "tier", (-F.col("lost")).alias("n"), "lost", none.alias("least"), none.alias("last")))
    rows = rows.unionByName(last.select("id", "tier", F.lit(0).alias("n"), F.lit(0).alias("lost"), none.alias("least"), F.col("not_id").alias("last")))
    tiers = rows.repartition("id").groupBy("id", "tier").agg(F.sum("n").alias("n"), F.when(F.sum("lost") == 0, F.min("least")).otherwise(F.min("last")).alias("sole"))
    best = tiers.where("n > 0").groupBy("id").agg(F.min(F.struct("tier", "n", "sole")).alias("b"))
    return best.select("id", "b.tier", "b.n", F.when(F.col("b.n") == 1, F.col("b.sole")).alias("sole"))


def two_sided(left: DataFrame, right: DataFrame, left_id: str, right_id: str, pool: Sequence[str], tiers: Sequence[str], accepted: DataFrame | None = None, rejected: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Assigned pairs (left_id, right_id, method, round) and the names that abstain (left_id, reason, n).

    ``tiers`` are columns of both sides, strictest first; ``accepted`` and ``rejected`` are pairs of ids. Ids are unique
    per side. No id is assigned twice: accepted pairs that share an id are not taken (``conflicting_review``). Reasons:
    ``none`` (no partner left in any tier), ``ambiguous`` (n partners in the strictest tier), ``contested`` (the only
    partner has others), ``rounds`` (the bound was reached while pairs were still found).
    """
    spark = left.sparkSession
    kinds = dict(left.dtypes)[left_id], dict(right.dtypes)[right_id]
    pairs = lambda df: df.select(F.col(left_id).alias("l"), F.col(right_id).alias("r")).distinct() if df is not None else spark.createDataFrame([], f"l {kinds[0]}, r {kinds[1]}")
    said = pairs(accepted)
    once = lambda c: said.groupBy(c).count().where("count = 1").select(c)
    known = _joined(_joined(said, left.select(F.col(left_id).alias("l")), "l", "left_semi"), right.select(F.col(right_id).alias("r")), "r", "left_semi")
    taken = stored(_joined(_joined(known, once("l"), "l"), once("r"), "r").select("l", "r", F.lit("reviewed").alias("method"), F.lit(0).alias("round")), "assigned")
    clash = stored(_joined(said, taken, "l", "left_anti").select("l").distinct(), "conflicts")
    a = stored(_joined(_joined(_nodes(left, left_id, pool, tiers), taken, F.col("id") == F.col("l"), "left_anti"), clash, F.col("id") == F.col("l"), "left_anti"), "names")
    b = stored(_joined(_nodes(right, right_id, pool, tiers), taken, F.col("id") == F.col("r"), "left_anti"), "entries")
    apart = stored(_shared(pairs(rejected), a, b), "rejected-pairs")
    of_left, of_right = apart.withColumnsRenamed({"l": "id", "r": "not_id"}), apart.withColumnsRenamed({"r": "id", "l": "not_id"})
    found, changed = [taken], True
    method = F.element_at(F.array(*map(F.lit, tiers)), F.col("tier") + 1)
    for k in range(1, rounds + 1):
        own = _partners(a, b, of_left)
        back = _partners(b, a, of_right)
        mutual = _joined(own.where("sole is not null").select(F.col("id").alias("l"), F.col("sole").alias("r"), "tier"), back.where("sole is not null").select(F.col("id").alias("r"), F.col("sole").alias("l")), ["l", "r"])
        fixed = stored(mutual.select("l", "r", method.alias("method"), F.lit(k).alias("round")), "assigned")
        changed = not fixed.isEmpty()
        if not changed:
            break
        found.append(fixed)
        a = stored(_joined(a, fixed, F.col("id") == F.col("l"), "left_anti"), "names")
        b = stored(_joined(b, fixed, F.col("id") == F.col("r"), "left_anti"), "entries")
    assigned = found[0]
    for more in found[1:]:
        assigned = assigned.unionByName(more)
    rest = _joined(left.select(F.col(left_id).alias("id")), assigned, F.col("id") == F.col("l"), "left_anti")
    seen = _partners(a, b, of_left)
    left_over = _joined(_joined(rest, seen, "id", "left"), clash.select(F.col("l").alias("id"), F.lit(True).alias("_clash")), "id", "left")
    reason = F.when(F.col("_clash"), "conflicting_review").when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("rounds" if changed and rounds else "contested")
    names = [F.col("l").alias(left_id), F.col("r").alias(right_id), "method", "round"]
    return assigned.select(*names), left_over.select(F.col("id").alias(left_id), reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("n"))


def name_keys(df: DataFrame, name: str) -> DataFrame:
    """``df`` with _full (surname and first name) and _initial (surname and first letter) of a name in either order."""
    tail = F.size(text.name_tokens(F.regexp_extract(name, ",(.*)$", 1))) > 0
    words = text.name_tokens(F.col(name))
    last = F.when(tail, text.key_of(text.name_tokens(F.substring_index(name, ",", 1)))).otherwise(F.try_element_at(words, F.lit(-1)))
    first = F.when(tail, F.try_element_at(text.name_tokens(F.regexp_extract(name, ",(.*)$", 1)), F.lit(1))).when(F.size(words) > 1, words[0])
    return df.withColumns({"_last": last, "_full": F.concat_ws("|", last, first), "_initial": F.concat_ws("|", last, F.substring(first, 1, 1))})


def ballot_evidence(candidates: DataFrame, roster: DataFrame, reviews: DataFrame, as_of: str, parties: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Whether the holder of each seat is on its ballot: a row per race that is settled, and the open ones with their reasons.

    ``candidates``: state, office, district, candidate, party, partial (whether the list may lack names); ``roster``: state,
    office, district, holder, party, a row per seat; ``reviews``: state, office, candidate, holder, same_person (``True`` or
    ``False`` in words), retrieved_on. A candidate is a holder of the state and office with the same surname and first name,
    or by review. Reviews after ``as_of`` don't count. ``parties`` names the two columns of nominees by party.

    Open are races with a candidate that shares surname and initial with a holder but not the first name, that abstains,
    that share the absent holder's surname unreviewed, or whose partial list lacks the holder; and races without exactly
    one seat in the roster. Raises, when run, for two reviews of one pair and other words than True and False.
    """
    where = ["state", "office"]
    number = F.coalesce(F.col("district").cast("int"), F.lit(0))
    names = name_keys(candidates.withColumn("district", number), "candidate").withColumn("_c", F.sha2(F.concat_ws("\u0001", *where, F.col("district").cast("string"), "candidate"), 256)).dropDuplicates(["_c"])
    holders = name_keys(roster.withColumn("district", number), "holder").withColumn("_h", F.sha2(F.concat_ws("\u0001", *where, F.col("district").cast("string"), F.coalesce("holder", F.lit(""))), 256))
    dated = reviews.where(F.col("retrieved_on").cast("date") <= F.lit(as_of).cast("date"))
    checked = dated.groupBy(*where, "candidate", "holder").agg(F.count("*").alias("_n"), F.min(F.col("same_person").cast("string")).alias("same"))
    bad = F.when(F.col("_n") > 1, "duplicate candidate identity review").when(~F.col("same").isin("True", "False"), "identity same_person must be True or False")
    checked = checked.withColumn("same", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("same")))
    joined = stored(checked.join(names.select(*where, "candidate", "_c"), [*where, "candidate"]).join(holders.select(*where, "holder", "_h"), [*where, "holder"]).select("_c", "_h", "same"), "identity-reviews")
    assigned, abstained = two_sided(names, holders, "_c", "_h", where, ["_full"], joined.where("same = 'True'"), joined.where("same = 'False'"))
    assigned = stored(assigned, "identities")
    # Surname and initial of a holder that is not ruled out, but no assignment.
    apart = joined.where("same = 'False'")
    loose = names.join(assigned, "_c", "left_anti").join(holders.select(*where, "_initial", "_h"), [*where, "_initial"]).join(apart, ["_c", "_h"], "left_anti").select("_c").distinct()
    several = abstained.where("reason <> 'none'").select("_c", F.lit("several holders or candidates of this name").alias("why"))
    why = loose.join(several, "_c", "left_anti").select("_c", F.lit("surname and initial agree but first names differ").alias("why")).unionByName(several)
    open_names = stored(names.join(why, "_c").select(*where, "district", "candidate", "why"), "open-identities")

    race = [*where, "district"]
    seats = holders.groupBy(*race).agg(F.count("*").alias("_seats"), F.first("holder").alias("incumbent"), F.first("_last").alias("_incumbent_last"), F.first("_h").alias("_seat"))
    on_ballot = names.join(assigned, "_c", "left").join(holders.select("_h", F.col("party").alias("_held_by")), "_h", "left").join(joined.select("_c").distinct().withColumn("_reviewed", F.lit(True)), "_c", "left").join(seats, race, "left")
    settled = on_ballot.groupBy(*race).agg(
        F.max("_seats").alias("_seats"),
        F.coalesce(F.nullif(F.max("incumbent"), F.lit("")), F.lit("VACANT")).alias("incumbent"),
        F.coalesce(F.max(F.col("_h") == F.col("_seat")), F.lit(False)).alias("incumbent_running"),
        F.coalesce(F.max("partial"), F.lit(False)).alias("_partial"),
        F.coalesce(F.max((F.col("_last") == F.col("_incumbent_last")) & F.col("_reviewed").isNull()), F.lit(False)).alias("_namesake"),
        *(F.array_join(F.array_sort(F.collect_list(F.when(F.col("party") == p, F.col("candidate")))), " | ").alias(f"{short}_nominee") for p, short in parties.items()),
        *(F.coalesce(F.max(F.col("_held_by") == p), F.lit(False)).cast("int").alias(f"ballot_incumbent_{short}") for p, short in parties.items()),
    )
    unsure = open_names.groupBy(*race).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "candidate", "why"))), "; ").alias("_open"))
    absent = ~F.col("incumbent_running")
    reason = (
        F.when(F.coalesce(F.col("_seats"), F.lit(0)) != 1, "no unique current seat")
        .when(F.col("_open").isNotNull(), F.col("_open"))
        .when(F.col("_partial") & absent, "a partial list cannot prove absence")
        .when(F.col("_namesake") & absent, "same surname but unresolved first name")
    )
    marked = stored(settled.join(unsure, race, "left").withColumn("reason", reason), "ballot-races")
    columns = [*race, "incumbent", "incumbent_running", *(f"{s}_nominee" for s in parties.values()), *(f"ballot_incumbent_{s}" for s in parties.values())]
    return marked.where("reason is null").select(*columns, F.when(F.col("_partial"), "ballot presence only").otherwise("complete ballot").alias("evidence")), marked.where("reason is not null").select(*race, "reason")
