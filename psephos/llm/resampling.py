"""Target-distribution importance resampling in two Arrow passes.

Features of a text are its runs of 1 to 3 consecutive words; their buckets are CRC-32 values modulo ``BUCKETS``. The first
pass makes one vector of bucket counts per partition with ``np.bincount``, and ``treeReduce`` merges the vectors of the
corpus and of the target. From both come the buckets' gains, log ratios of smoothed shares in thousandths. The second
pass gathers the gains, which are broadcast (``BUCKETS`` numbers), and sums them per document with ``np.bincount``
weights. A document's score is its weight and Gumbel noise from a hash of its id, so the highest scores are a draw
without replacement in proportion to the weights' exponentials. Scores are ranked over ranges: each range is sorted by
itself and starts at the number of rows in the ranges before it.

CRC-32 is linear over bits, so the CRCs of all runs come from those of words: a state moves over the next word by a
table of that many zero bytes and the word's own value, without building a run's string.

Cases: a null text has no words; a text without words has weight 0; a text shorter than a run lacks it; documents with
fewer than ``LEAST_WORDS`` words are never drawn, but count in the buckets; repeated rows count, are weighed alike and
are ranked one behind the other; a null doc_id is hashed as an empty one and comes first among ties; an empty table or
target gives gains of the smoothing alone, and no rows; other columns are ignored. Long texts are worked on in blocks
of ``BLOCK_WORDS`` words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored
from .words import ALNUM, LOWER, owners, runs, slices, word_bounds

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
BLOCK_WORDS = 1 << 17
#: Rows that are ranked in one task.
RANGE_ROWS = 1_000_000

_ONES = np.uint32(0xFFFFFFFF)
#: Words of up to so many bytes are worked on in tables.
_SHORT = 32


def _step_table() -> np.ndarray:
    """What a byte does to the state: the CRC-32 polynomial, lowest bit first."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_STEP = _step_table()


def _step(state: np.ndarray, byte: int) -> np.ndarray:
    return _STEP[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8))


def _moved(state: np.ndarray, table: np.ndarray, at: np.ndarray | int = 0) -> np.ndarray:
    """The state behind the zero bytes that ``table`` stands for, read by the four bytes of the state."""
    out = table[at + (state & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ table[at + (256 * k + ((state >> np.uint32(8 * k)) & np.uint32(255)))]
    return out


def _zero_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of 0 to ``_SHORT`` zero bytes, one behind the other, and of 1, 2, 4, ... zero bytes."""
    one = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    steps = [one]
    for _ in range(_SHORT):
        steps.append(_step(steps[-1], 0))
    powers = [steps[1]]
    for _ in range(40):
        powers.append(_moved(powers[-1], powers[-1]))
    return np.concatenate(steps), powers


_ZEROS, _POWERS = _zero_tables()
#: What a byte of a word adds to the word's value, by the number of bytes behind it.
_ADDS = np.stack([_step(_ZEROS[1024 * k : 1024 * k + 256], 0) for k in range(_SHORT)])


def shifted(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC states behind ``n`` zero bytes each."""
    out = _moved(state, _ZEROS, np.minimum(n, _SHORT) << 10)
    far = np.flatnonzero(n > _SHORT)
    if len(far):
        moved, left = state[far], n[far]
        for k in range(int(left.max()).bit_length()):
            now = (left >> k & 1).astype(bool)
            moved[now] = _moved(moved[now], _POWERS[k])
        out[far] = moved
    return out


def word_values(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The words' CRC states from a state of zero."""
    n = stops - starts
    short = np.minimum(n, _SHORT)
    at = np.repeat(starts, short) + runs(short)
    behind = np.repeat(starts + short - 1, short) - at
    cuts = np.cumsum(short) - short
    out = np.bitwise_xor.reduceat(_ADDS[behind, data[at]], cuts) if len(n) else np.zeros(0, np.uint32)
    for k in np.flatnonzero(n > _SHORT).tolist():
        out[k] = zlib.crc32(data[starts[k] : stops[k]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def run_buckets(values: np.ndarray, n: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 and 3 words: their buckets, and the index of their last words. ``n``: bytes of the words."""
    state = shifted(np.full(len(n), _ONES), n) ^ values
    yield ((state ^ _ONES) % np.uint32(buckets)).astype(np.int64), np.arange(len(n))
    for more in (1, 2):
        state = shifted(_step(state[:-1], 0x20), n[more:]) ^ values[more:]
        inside = np.flatnonzero(doc[more:] == doc[:-more]) if len(doc) > more else np.zeros(0, np.int64)
        yield ((state[inside] ^ _ONES) % np.uint32(buckets)).astype(np.int64), inside + more


def text_runs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[np.ndarray, np.ndarray]] | Iterator]]:
    """Parts of the batches with the number of words of each text and an iterator over (buckets, text of each run)."""
    for part, data, ends in slices(batches):
        data = LOWER[data]
        starts, stops, first = word_bounds(data, ends, ALNUM)
        doc = owners(first)

        def found(data=data, starts=starts, stops=stops, doc=doc):
            for at in range(0, len(starts), BLOCK_WORDS):
                low = max(0, at - 2)  # runs that end in this block begin up to two words before it
                own = slice(low, at + BLOCK_WORDS)
                values = word_values(data, starts[own], stops[own])
                for bucket, last in run_buckets(values, stops[own] - starts[own], doc[own], buckets):
                    new = last >= at - low
                    yield bucket[new], doc[own][last[new]]

        yield part, np.diff(first), found()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has: a vector per partition, merged by treeReduce."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, found in text_runs(batches, buckets):
            for bucket, _ in found:
                total += np.bincount(bucket, minlength=buckets)
        yield pa.record_batch({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = texts.select("text").mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of B buckets, in doubles."""
    most, wanted = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = ((target + 1.0) * most) / ((corpus + 1.0) * wanted)
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """For each row: doc_id, n_words, n_features, weight."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value.astype(np.float64)
        for part, n_words, found in text_runs(batches, len(gain)):
            weight = np.zeros(len(part))
            for bucket, doc in found:
                weight += np.bincount(doc, gain[bucket], len(part))
            n_features = sum(np.maximum(n_words - k, 0) for k in range(3))
            counts = {"n_words": n_words, "n_features": n_features, "weight": weight.astype(np.int64)}
            yield pa.record_batch({"doc_id": part.column("doc_id")} | {c: pa.array(x, pa.int64()) for c, x in counts.items()})

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int):
    """floor(-1000 * ln(-ln((h + 0.5) / 2**32))), h being the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(rows: DataFrame, order: list, number: str) -> DataFrame:
    """The rows with their number from 1 in ``order`` (column, ascending), which tells all rows apart or equal ones."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    sort = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    dealt = stored(rows.repartitionByRange(n, *sort).withColumn("_range", F.spark_partition_id()), "score-ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*sort))
    return dealt.withColumn(number, place).join(stored(before, "range-starts"), "_range").withColumn(number, F.col("_before") + F.col(number)).drop("_range", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """For each row: doc_id, n_words, n_features, weight, score, and rank among those drawn, null for others.

    Drawn are floor(percent * N / 100) of the N rows with ``least_words`` words or more. ``docs`` need doc_id and text,
    ``target`` needs text.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(seed)).withColumn("_place", F.monotonically_increasing_id())
    scored = stored(scored.withColumn("_open", F.col("n_words") >= least_words), "scored")
    drawn = percent * scored.where("_open").count() // 100
    places = ranked(scored, [("_open", False), ("score", False), ("doc_id", True), ("_place", True)], "_number")
    rank = F.when(F.col("_open") & (F.col("_number") <= drawn), F.col("_number")).cast("bigint")
    return places.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
