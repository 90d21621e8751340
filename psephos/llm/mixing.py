"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order given by MD5 hashes of id and text, form a stream that is cut in blocks of ``block`` characters. The
i-th block of a source of weight w is released at floor(i / w) and due at ceil((i + 1) / w). Each slot goes to the
released block with the earliest deadline (ties: the shorter way to the source's next release, then the name). With
weights that add up to 1, every source is then within one block of its share at every time.

The period is the exact denominator of the weights as they are written (0.1 is 1/10; n equal weights: n slots), so the
schedule repeats without error and only one period is computed; one that is longer than its phase is computed up to the
phase's end only. When a source has no blocks left, the next phase mixes the others by their weights, and those that
are behind come first among equals. The bound of one block holds in each phase; sources of equal weight are never
more than one block apart while both last. The table of phases has a row per source and phase; that of turns has a row
per slot of each period, at most one per block of the mix (about 15,000 a GB of characters) where periods are longer
than their phases. All else is joins: a source's block number gives its phase, its round and its slot.

Equal weights need no plan: the windows of all n sources that are left open and close together, every n slots, so the
i-th blocks of all sources that have one stand together in round i. With the sources in falling order of their blocks,
those of round i are a prefix, and a block's slot is the number of blocks in earlier rounds plus its source's place.
That number bends where a source ends; there are fewer than sqrt(2 * blocks) such bends, so they are broadcast, and
any number of sources is mixed without a row per source on the driver. Sources without a target weight are mixed like
this after the planned ones. The plan's size is bounded by the weights that the caller writes down: a phase per weight.

A stream position is a prefix sum in two steps: characters before a document's chunk, then within the chunk. A chunk is
a hash range of about ``CHUNK`` documents of a source, so a source with a third of all rows is many chunks.

Cases: null source is a source of its own, weighing like the others; null text has no characters and shares the
block of its neighbours; sources without a target weight, or with weight 0, follow after all others by equal weights;
repeated rows stay; an empty table gives an empty mix; a document longer than a block takes its source's next slots too.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import named, stored

BLOCK, CHUNK = 65_536, 8192
#: Sources of equally many blocks are ranked in parts, by so many hexadecimal digits of their names' hashes.
PART_DIGITS = 3
#: Turns that are broadcast; a longer table is joined as Spark sees fit.
MOST_TURNS = 100_000


def exact_slots(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Slots of each source in the shortest period that meets the weights exactly, weights being the decimals that are written."""
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    total = sum(parts.values())
    period = math.lcm(*((w / total).denominator for w in parts.values()))
    return {s: int(w / total * period) for s, w in parts.items()}


def slot_order(slots: Mapping[str | None, int], rank: Mapping[str | None, int] | None = None) -> Iterator[str | None]:
    """The slots of one period in turn: in each the released block of the earliest deadline (last ties: rank, then name)."""
    period, rank = sum(slots.values()), rank or {}
    # The window of block i of a source with n slots: released at floor(i * period / n), due at ceil((i + 1) * period / n).
    window = lambda s, i: (i * period // slots[s], -(-(i + 1) * period // slots[s]))
    waiting = [(0, rank.get(s, 0), s is None, s or "", s, 0) for s, n in slots.items() if n]
    heapq.heapify(waiting)
    ready: list = []
    t = 0
    while t < period:
        while waiting and waiting[0][0] <= t:
            _, place, no, name, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, i)[1], window(s, i + 1)[0], place, no, name, s, i))
        _, _, place, no, name, s, i = heapq.heappop(ready)
        yield s
        if i + 1 < slots[s]:
            heapq.heappush(waiting, (window(s, i + 1)[0], place, no, name, s, i + 1))
        t += 1


def pfair(slots: Mapping[str | None, int]) -> list[str | None]:
    """One period: in each slot the released block of the earliest deadline."""
    return list(slot_order(slots))


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> list[tuple]:
    """The plan: for each phase, source and turn in a period: (source, first block, blocks, per, turn, start slot, period, slot).

    A phase ends with the block that empties a source; its last period may be cut there.
    """
    left, used, start, plan = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    lag: dict[str | None, Fraction] = {}
    while left:
        wanted = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        slots = exact_slots(wanted)
        whole = sum(slots.values())
        place_of = {x: k for k, x in enumerate(sorted({lag.get(s, 0) for s in wanted}, reverse=True))}
        turns = slot_order(slots, {s: place_of[lag.get(s, 0)] for s in wanted})
        # No phase is longer than the blocks left, so neither is the part of a period that it needs.
        order = list(islice(turns, min(whole, sum(left[s] for s in wanted))))
        places: dict[str | None, list[int]] = {s: [] for s in wanted}
        for k, s in enumerate(order):
            places[s].append(k)
        if len(order) < whole:
            end = min(places[s][left[s] - 1] for s in wanted if len(places[s]) >= left[s]) + 1
        else:
            end = min((left[s] - 1) // slots[s] * whole + places[s][(left[s] - 1) % slots[s]] for s in wanted) + 1
        for s in wanted:
            n = end // len(order) * len(places[s]) + sum(p < end % len(order) for p in places[s])
            plan += [(s, used[s], n, len(places[s]), k, start, len(order), p) for k, p in enumerate(places[s][:n])]
            lag[s] = lag.get(s, 0) + Fraction(slots[s] * end, whole) - n
            used[s] += n
            left[s] -= n
        start += end
        left = {s: n for s, n in left.items() if n}
    return plan


PHASE_SCHEMA = "source string, first_block bigint, n_blocks bigint, per bigint, start_slot bigint, period bigint"
TURN_SCHEMA = "source string, first_block bigint, turn bigint, place bigint"


def streams(docs: DataFrame, seed: int, names: list[str]) -> DataFrame:
    """The rows as structs r with s (the source, never null: "n", or "s" and its name), start (characters of the source before the row) and characters.

    Only s, start and these names exist beside r, so any names may stand in it.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = docs.select(
        F.struct(*map(named, names)).alias("r"),
        key.alias("s"),
        F.col("doc_id").alias("id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("characters"),
        F.md5(F.concat_ws("|", F.lit(seed), "doc_id", "text").cast("binary")).alias("order"),
    )
    # Sources may be many, so Spark decides how this is joined.
    chunks = rows.groupBy("s").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK)).cast("bigint").alias("chunks"))
    # The first 32 bits of the order, as a number below 2**32, cut in equal ranges.
    upper = F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint")
    rows = rows.join(stored(chunks, "chunks"), "s").withColumn("chunk", F.shiftright(upper * F.col("chunks"), 32)).drop("chunks")
    totals = rows.groupBy("s", "chunk").agg(F.sum("characters").alias("sum"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("s", "chunk", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("chunk_start"))
    within = Window.partitionBy("s", "chunk").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("characters").over(within), F.lit(0)))
    # The rows keep the partitioning of the window.
    return placed.join(stored(starts, "chunk-starts"), ["s", "chunk"]).select("r", "s", (F.col("chunk_start") + F.col("inside")).alias("start"), "characters")


def _key(source: str | None) -> str:
    return "n" if source is None else f"s{source}"


def _round_robin(rows: DataFrame, totals: DataFrame, first_slot: int) -> DataFrame:
    """Slots of ``rows`` (s, b) by equal weights among the sources of ``totals`` (s, blocks)."""
    bends = totals.groupBy("blocks").agg(F.count("*").alias("n")).orderBy("blocks").toArrow()  # fewer than sqrt(2 * all blocks)
    ends, n = (bends[c].to_numpy().astype(np.int64) for c in ("blocks", "n"))
    live = n.sum() - np.concatenate([[0], np.cumsum(n)])  # sources that are left behind each bend
    ends = np.concatenate([[0], ends])
    earlier = first_slot + np.concatenate([[0], np.cumsum(np.diff(ends) * live[:-1])])
    sent = rows.sparkSession.sparkContext.broadcast((ends, earlier, live))

    @F.pandas_udf("bigint")
    def before(b: pd.Series) -> pd.Series:
        ends, earlier, live = sent.value
        k = np.searchsorted(ends, b.to_numpy(), "right") - 1
        return pd.Series(earlier[k] + (b.to_numpy() - ends[k]) * live[k])

    # Ranks without one task for all sources: places among those of equal blocks, behind all that have more.
    ahead = F.sum("n").over(Window.orderBy(F.desc("blocks")).rowsBetween(Window.unboundedPreceding, -1))
    counts = totals.groupBy("blocks", F.substring(F.md5(F.col("s").cast("binary")), 1, PART_DIGITS).alias("part")).agg(F.count("*").alias("n"))
    parts = counts.withColumn("in_parts", F.coalesce(F.sum("n").over(Window.partitionBy("blocks").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    heads = totals.groupBy("blocks").agg(F.count("*").alias("n")).select("blocks", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    part = totals.withColumn("part", F.substring(F.md5(F.col("s").cast("binary")), 1, PART_DIGITS))
    inside = part.withColumn("inside", F.row_number().over(Window.partitionBy("blocks", "part").orderBy("s")) - 1)
    ranked = inside.join(parts, ["blocks", "part"]).join(heads, "blocks").select("s", (F.col("ahead") + F.col("in_parts") + F.col("inside")).alias("rank"))
    return rows.join(stored(ranked, "source-ranks"), "s").withColumn("slot", before("b") + F.col("rank"))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with block (of the source), slot (place of that block in the mix) and offset (characters of the block before the row).

    ``weights`` by source; None weighs all sources alike. The order of the mix is (slot, offset, doc_id).
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("block", "slot", "offset")]
    rows = streams(docs, seed, names)
    characters = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    sums = docs.select(key.alias("s"), characters.alias("n")).groupBy("s").agg(F.sum("n").alias("n"))
    totals = stored(sums.select("s", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("bigint").alias("blocks")), "source-blocks")
    # A document without characters at a source's end belongs to its last block.
    rows = rows.join(totals, "s").withColumn("b", F.least(F.floor(F.col("start") / block).cast("bigint"), F.col("blocks") - 1)).drop("blocks")
    wanted = {_key(s): w for s, w in (weights or {}).items() if w > 0}
    if not wanted:
        found = _round_robin(rows, totals, 0)
    else:
        named = F.col("s").isin(list(wanted))
        blocks = dict(totals.where(named).collect())  # a row per weight at most
        plan = phases(blocks, {s: wanted[s] for s in blocks})
        phase_table = spark.createDataFrame(list({p[:4] + p[5:7]: None for p in plan}), PHASE_SCHEMA).withColumnRenamed("source", "s")
        turn_table = spark.createDataFrame([(p[0], p[1], p[4], p[7]) for p in plan], TURN_SCHEMA).withColumnRenamed("source", "s")
        inside = F.col("b") - F.col("first_block")
        phased = rows.where(named).join(phase_table, "s").where((inside >= 0) & (inside < F.col("n_blocks"))).withColumn("turn", inside % F.col("per"))
        small = len(plan) <= MOST_TURNS
        planned = phased.join(F.broadcast(turn_table) if small else turn_table, ["s", "first_block", "turn"])
        slot = F.col("start_slot") + F.floor(inside / F.col("per")).cast("bigint") * F.col("period") + F.col("place")
        found = planned.withColumn("slot", slot).select("r", "s", "start", "b", "slot")
        others = _round_robin(rows.where(~named), totals.where(~named), sum(blocks.values()))
        found = found.unionByName(others.select("r", "s", "start", "b", "slot"))
    return found.select("r.*", F.col("b").alias("block"), "slot", (F.col("start") - F.col("b") * block).cast("bigint").alias("offset"))


#: Written target weights of the sources that the tables name; sources that are not among them follow by equal weights.
TARGETS = {f"src{k}": 1 + k % 4 for k in range(20)}

#: A common multiple of all sums of ``TARGETS`` that can be left, so that lags are whole numbers.
_WHOLE = math.lcm(*range(1, sum(TARGETS.values()) + 1))

#: ``mixed`` of all documents by ``TARGETS``, slot by slot: st has each source's weight, blocks left and given (in all and
#: in this phase), and lag; x is the released block of the earliest deadline.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, source, coalesce('s' || source, 'n') AS s, md5(concat_ws('|', 0, doc_id, text)) AS o, coalesce(length(text), 0) AS n FROM documents),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY s ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
w AS (SELECT unnest([{", ".join(f"'s{s}'" for s in TARGETS)}]) AS s, unnest([{", ".join(map(str, TARGETS.values()))}]) AS w),
t AS (SELECT d.s, any_value(w) AS w, greatest(1, CAST(ceil(sum(n) / {BLOCK}) AS BIGINT)) AS blocks FROM d LEFT JOIN w ON w.s = d.s GROUP BY d.s),
e AS (
    SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS t, list({{'s': s, 'w': CAST(w AS BIGINT), 'rest': blocks, 'used': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT), 'lag': CAST(0 AS HUGEINT)}} ORDER BY s) AS st, '' AS s, CAST(0 AS BIGINT) AS block FROM t WHERE w > 0
    UNION ALL
    SELECT slot + 1, CASE WHEN x.rest = 1 THEN 0 ELSE t + 1 END, list_transform(st, lambda k: {{'s': k.s, 'w': k.w, 'rest': k.rest - (k.s = x.s)::BIGINT, 'used': k.used + (k.s = x.s)::BIGINT,
            'i': CASE WHEN x.rest = 1 THEN 0 ELSE k.i + (k.s = x.s)::BIGINT END,
            'lag': CASE WHEN x.rest = 1 AND k.rest > 0 THEN k.lag + {_WHOLE}::HUGEINT // total * k.w * (t + 1) - {_WHOLE}::HUGEINT * (k.i + (k.s = x.s)::BIGINT) ELSE k.lag END}}), x.s, x.used
    FROM (SELECT slot, t, st, total, list_sort(list_transform(list_filter(st, lambda k: k.rest > 0 AND k.i * total // k.w <= t),
            lambda k: {{'due': ((k.i + 1) * total + k.w - 1) // k.w, 'again': (k.i + 1) * total // k.w, 'behind': -k.lag, 's': k.s, 'used': k.used, 'rest': k.rest}}))[1] AS x
        FROM (SELECT slot, t, st, CAST(list_sum(list_transform(st, lambda k: CASE WHEN k.rest > 0 THEN k.w ELSE 0 END)) AS BIGINT) AS total FROM e) WHERE total > 0)
),
r AS (SELECT s, blocks, row_number() OVER (ORDER BY blocks DESC, substr(md5(s), 1, {PART_DIGITS}), s) - 1 AS rank FROM t WHERE w IS NULL),
b AS (SELECT p.*, t.w, least(CAST(floor(start / {BLOCK}) AS BIGINT), blocks - 1) AS block FROM p JOIN t ON p.s = t.s),
f AS (SELECT block, (SELECT coalesce(CAST(sum(blocks) AS BIGINT), 0) FROM t WHERE w > 0) + (SELECT CAST(sum(least(r.blocks, k.block)) AS BIGINT) FROM r) AS earlier FROM (SELECT DISTINCT block FROM b WHERE w IS NULL) k)
SELECT doc_id, text, source, b.block, CAST(coalesce(e.slot, earlier + rank) AS BIGINT) AS slot, CAST(start - b.block * {BLOCK} AS BIGINT) AS "offset"
FROM b LEFT JOIN e ON e.s = b.s AND e.block = b.block AND e.slot >= 0 LEFT JOIN r ON r.s = b.s LEFT JOIN f ON f.block = b.block AND b.w IS NULL
"""
