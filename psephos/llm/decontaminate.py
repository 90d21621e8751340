"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a row per document holds, for each term of the benchmark's vocabulary, the
sorted positions at which the document has it. It is stored in the shared folder, counted once for the terms'
frequencies, and searched in one pass: the list of a phrase's rarest term, moved by the term's offset in the phrase,
is intersected with the lists of the next rarer terms until all terms are met (exact phrase), or the terms are looked
up within a stretch of words around the rarest one (proximity). Neither pass shuffles postings: the rows of a document
stay together, so a term or passage found in a third of all documents costs each task only its own share.

Benchmarks go to the tasks in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast has a fixed bound; more
blocks mean more searches of the same size.

Words are compared by 64-bit hashes; a false match needs all words of a window to collide in place.

Cases: null text has no words; an item or document without words matches nothing; an item of fewer words than the
window is one window; items of null id are left out; items of one id count as one item that has the windows of all its
rows, in however many blocks they stand; repeated rows of documents give repeated results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .words import ALNUM, LOWER, owners, runs, slices, word_bounds, word_hashes

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Postings that a search holds at once.
SLICE_POSTINGS = 1_000_000
_POSITION_BITS = np.int64(40)

INDEX_SCHEMA = "doc_id bigint, text_hash bigint, n_words bigint, term array<int>, position array<int>"
MATCH_SCHEMA = "doc_id bigint, text_hash bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def text_hashes(texts: Iterable[str | None]) -> list[np.ndarray]:
    """The word hashes of a few texts."""
    out = []
    for _, data, ends in slices(iter([pa.record_batch({"text": pa.array(list(texts), pa.string())})])):
        data = LOWER[data]
        starts, stops, first = word_bounds(data, ends, ALNUM)
        hashes = word_hashes(data, starts, stops)
        out += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The benchmark's items as (id, word hashes), in blocks of about ``block_words`` words."""
    block, size = [], 0
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator()
    for key, value in rows:
        words = text_hashes([value])[0]
        if len(words):
            block.append((key, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def phrases_of(block: list[tuple[str, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows as rows of word hashes, short ones marked by their length, the item of each, and the items' ids (each once)."""
    rows, lengths, owner = [], [], []
    ids = {key: k for k, key in enumerate(dict.fromkeys(key for key, _ in block))}
    for key, words in block:
        n = min(window, len(words))
        view = np.zeros((len(words) - n + 1, window), np.uint64)
        view[:, :n] = np.lib.stride_tricks.sliding_window_view(words, n)
        rows.append(view)
        lengths.append(np.full(len(view), n))
        owner.append(np.full(len(view), ids[key]))
    if not rows:
        return np.zeros((0, window), np.uint64), np.zeros((0, 2), np.int64), []
    return np.concatenate(rows), np.column_stack([np.concatenate(lengths), np.concatenate(owner)]), list(ids)


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """A row per document: doc_id, n_words, and parallel arrays (term, position), sorted, of the given terms.

    ``terms`` are sorted word hashes; a term is named by its place among them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for part, data, ends in slices(batches):
            data = LOWER[data]
            starts, stops, first = word_bounds(data, ends, ALNUM)
            doc, place = owners(first), runs(np.diff(first))
            if len(terms) and len(starts):
                hashes = word_hashes(data, starts, stops)
                term = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                known = np.flatnonzero(terms[term] == hashes)
            else:
                term, known = doc, np.zeros(0, np.int64)
            term, doc, place = term[known], doc[known], place[known]
            order = np.argsort(doc * max(1, len(terms)) + term, kind="stable")
            cuts = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32())
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "text_hash": part.column("text_hash"),
                    "n_words": pa.array(np.diff(first), pa.int64()),
                    "term": pa.ListArray.from_arrays(cuts, pa.array(term[order], pa.int32())),
                    "position": pa.ListArray.from_arrays(cuts, pa.array(place[order], pa.int32())),
                }
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(index, INDEX_SCHEMA)


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often the documents have each term of the index."""
    counts = np.zeros(n_terms, np.int64)
    for term, n in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # at most a row per term of the block
        counts[term] = n
    return counts


def _lists(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the index with their first places and sorted keys (term, place); places of two documents lie ``gap`` apart."""
    for batch in batches:
        cuts = np.concatenate([[0], np.cumsum(np.diff(batch.column("term").offsets.to_numpy(zero_copy_only=False)))])
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SLICE_POSTINGS, "right")) - 1)
            part = batch.slice(at, to - at)
            n = part.column("n_words").to_numpy()
            base = gap + np.cumsum(n + gap) - (n + gap)
            term, place = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "position"))
            keys = np.sort((term << _POSITION_BITS) | (np.repeat(base, np.diff(cuts[at : to + 1])) + place))
            yield part, n, base, keys
            at = to


def _anchored(keys: np.ndarray, term: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (phrase, start) that the lists of the phrases' rarest terms allow."""
    low, high = (np.searchsorted(keys, (term + k) << _POSITION_BITS) for k in (0, 1))
    n = high - low
    phrase = np.repeat(np.arange(len(term)), n)
    places = keys[np.repeat(low, n) + runs(n)] & ((np.int64(1) << _POSITION_BITS) - 1)
    return phrase, places - offset[phrase]


def _exact(keys: np.ndarray, terms: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of exact phrases: the offset-adjusted lists, intersected from the rarest term on."""
    phrase, start = _anchored(keys, terms[:, 0], offsets[:, 0])
    for rank in range(1, terms.shape[1]):
        wanted = (terms[phrase, rank] << _POSITION_BITS) | (start + offsets[phrase, rank])
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        kept = (keys[at] == wanted) | (lengths[phrase] <= rank)
        phrase, start = phrase[kept], start[kept]
    return phrase, start


def _near(keys: np.ndarray, terms: np.ndarray, lengths: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of stretches of ``within`` words that hold all terms of a phrase in any order; they end at no rarest term twice."""
    phrase, place = _anchored(keys, terms[:, 0], np.zeros(len(terms), np.int64))
    found = []
    for back in range(within):
        start = place - back
        good = np.ones(len(phrase), bool)
        for rank in range(1, terms.shape[1]):
            low = (terms[phrase, rank] << _POSITION_BITS) | start
            at = np.searchsorted(keys, low)
            good &= (lengths[phrase] <= rank) | ((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] < low + within))
        found.append((phrase[good], start[good]))
        phrase, place = phrase[~good], place[~good]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(index: DataFrame, terms: np.ndarray, phrases: np.ndarray, facts: np.ndarray, ids: list[str], counts: np.ndarray, within: int | None = None) -> DataFrame:
    """A row per document of the index: the merged word spans that phrases occur in, and the items they are of.

    ``within`` None: exact phrases; else all terms of a phrase in any order within so many words.
    """
    width = phrases.shape[1]
    lengths, owner = facts[:, 0], facts[:, 1]
    inside = np.arange(width) < lengths[:, None]
    term = np.searchsorted(terms, phrases) if len(terms) else np.zeros(phrases.shape, np.int64)
    term = np.where(inside, term, 0).astype(np.int64)
    frequency = np.where(inside, counts[term] if len(counts) else 0, np.iinfo(np.int64).max)
    possible = (frequency > 0).all(axis=1)
    term, frequency, lengths, owner = term[possible], frequency[possible], lengths[possible], owner[possible]
    order = np.argsort(frequency, axis=1, kind="stable")
    sent = index.sparkSession.sparkContext.broadcast((np.take_along_axis(term, order, 1), order.astype(np.int64), lengths, owner, ids))
    reach = max(width, within or 0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, offsets, lengths, owner, ids = sent.value
        names = np.array(ids, object)
        for part, n, base, keys in _lists(batches, reach):
            if len(keys) and len(terms):
                phrase, start = _exact(keys, terms, offsets, lengths) if within is None else _near(keys, terms, lengths, within)
            else:
                phrase = start = np.zeros(0, np.int64)
            doc = np.searchsorted(base, start + (reach if within else 0), "right") - 1
            doc = np.clip(doc, 0, len(part) - 1)
            first = np.maximum(start - base[doc], 0)
            last = np.minimum(start - base[doc] + (lengths[phrase] if within is None else within), n[doc])
            order = np.lexsort((first, doc))
            doc, first, last, item = doc[order], first[order], last[order], owner[phrase[order]]
            # A span goes on while it touches what came before in its document.
            reached = np.maximum.accumulate(doc * (np.int64(1) << _POSITION_BITS) + last) if len(doc) else doc
            fresh = np.ones(len(doc), bool)
            fresh[1:] = doc[1:] * (np.int64(1) << _POSITION_BITS) + first[1:] > reached[:-1]
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(doc)) - 1 if len(doc) else heads
            span_end = (reached[tails] & ((np.int64(1) << _POSITION_BITS) - 1)).astype(np.int32) if len(doc) else np.zeros(0, np.int32)
            spans = pa.StructArray.from_arrays([pa.array(first[heads].astype(np.int32)), pa.array(span_end)], names=["start", "end"])
            pairs = np.unique(doc * np.int64(max(1, len(ids))) + item) if len(doc) else np.zeros(0, np.int64)
            pair_doc, pair_item = pairs // max(1, len(ids)), pairs % max(1, len(ids))
            edges = np.arange(len(part) + 1)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "text_hash": part.column("text_hash"),
                    "n_words": part.column("n_words"),
                    "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[heads], edges), pa.int32()), spans),
                    "items": pa.ListArray.from_arrays(pa.array(np.searchsorted(pair_doc, edges), pa.int32()), pa.array(names[pair_item], pa.string())),
                }
            )

    return index.mapInArrow(find, MATCH_SCHEMA)


def matches(docs: DataFrame, items: DataFrame, *, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, within: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each document: doc_id, text_hash (xxhash64), n_words, spans (merged, in words) and the items that match it, by id.

    ``within`` None asks for exact windows of ``window`` item words, else for proximity matches. ``docs`` need doc_id
    and text.
    """
    found = []
    for block in item_blocks(items, item_id, item_text, block_words):
        phrases, facts, ids = phrases_of(block, window)
        terms = np.unique(np.concatenate([words for _, words in block])) if block else np.zeros(0, np.uint64)
        index = stored(build_index(docs, terms), "positional-index")
        found.append(search(index, terms, phrases, facts, ids, term_counts(index, len(terms)), within))
    if len(found) == 1:
        return found[0]
    # Rows of one id and text have one result in each block: they are merged once and repeated at the end.
    key = ["doc_id", "text_hash", "n_words"]
    once = [one.groupBy(key).agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count("*").alias("copies")) for one in found]
    every = functools.reduce(DataFrame.unionByName, once)
    merged = every.groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("copies").alias("copies"))
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")
    return merged.select(*key, merged_spans("spans").alias("spans"), "items", again).drop("copy")


def merged_spans(column: str):
    """Sorted spans without overlaps or touching ends."""
    return F.expr(
        f"""aggregate(array_sort({column}), cast(array() as array<struct<start:int,end:int>>),
            (a, s) -> if(size(a) > 0 and element_at(a, -1).end >= s.start,
                concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, s.end) as end))),
                concat(a, array(s))))"""
    )


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``matches`` with n_hit, the number of words in spans, and contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]).cast("bigint"))
    return matches(docs, items, **options).withColumn("n_hit", hit).withColumn("contaminated", F.col("n_hit") > 0)
