"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark; windows that repeat merge to
maximal removal intervals.

Documents are dealt into blocks of some megabytes by the hash of their row. A block rolls two hashes of all its windows
and sends each distinct window once: the second hash says to which range, the first, of 64 bits, is what is sent, so a
passage that a third of all documents share costs at most one entry per block, never one per occurrence. A range counts
in how many blocks each of its hashes is found and answers every block with one bit per hash. The block then rolls its
windows again: a window repeats if its hash occurs twice in the block or its bit is set. Windows of different words are
taken for one only if both their range and 64 bits agree: among n windows and r ranges, which grow with n, that is
expected n * n / r / 2**65 times (0.00001 at 0.5 GB, about one at 100 TB), and within one block n * n / 2**65 times.

Cases: null or blank text has no words and stays empty; fewer words than the window: nothing is removed; repeated rows
remove each other's windows (all copies, as a repeat is judged on the input); words are cut at ASCII white space and
kept unchanged; other columns are ignored. Rows of null doc_id are documents as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACED, mix, owners, slices, window_hashes, word_bounds, word_hashes

WIDTH = 35
#: Bytes of text in a block, and in the texts whose windows meet in one hash range.
BLOCK_BYTES = 8 << 20

ENTRY_SCHEMA = "range int, block bigint, hashes binary"
ANSWER_SCHEMA = "block bigint, range int, found int, bits binary"
RESULT_SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, text string"


def blocked(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The rows with their block, and how many blocks there are."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block: Column = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    return docs.select("doc_id", "text", block.alias("block")), n


_SECOND = np.uint64(0xA0761D6478BD642F)


def _windows(texts: pa.Table, width: int, n_ranges: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a block with the index of each text's first word, and the windows' hashes, first words and ranges."""
    for part, data, ends in slices(iter(texts.to_batches())):
        starts, stops, first = word_bounds(data, ends, SPACED)
        words = word_hashes(data, starts, stops)
        hashes, at = window_hashes(words, first, width)
        second, _ = window_hashes(mix(words ^ _SECOND), first, width)
        yield part, first, hashes, at, (((second >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int32)


def _dealt(hashes: np.ndarray, ranges: np.ndarray, n_ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes by range and value, how often each occurs, and where each range begins (one more at the end)."""
    found, at, times = np.unique(hashes, return_index=True, return_counts=True)
    order = np.argsort(ranges[at], kind="stable")
    return found[order], times[order], np.searchsorted(ranges[at][order], np.arange(n_ranges + 1))


def _intervals(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the maximal runs of covered words."""
    doc = owners(first)
    edge = np.ones(len(covered) + 1, bool)
    edge[1:-1] = (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1])
    cuts = np.flatnonzero(edge)
    heads, tails = cuts[:-1], cuts[1:]
    kept = covered[heads] if len(covered) else np.zeros(0, bool)
    heads, tails = heads[kept] if len(heads) else heads, tails[kept] if len(tails) else tails
    return doc[heads], heads - first[doc[heads]], tails - first[doc[heads]]


def repeated_substrings(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, removed (intervals in words) and text (the kept words, by one space)."""
    rows, n_blocks = blocked(docs, block_bytes)
    n_ranges = n_blocks

    def send(key: tuple, texts: pa.Table) -> pa.Table:
        hashes, ranges = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for _, _, h, _, r in _windows(texts, width, n_ranges):
            h, own = np.unique(h, return_index=True)
            hashes.append(h), ranges.append(r[own])
        hashes, _, at = _dealt(np.concatenate(hashes), np.concatenate(ranges), n_ranges)
        full = np.flatnonzero(np.diff(at))
        return pa.table(
            {
                "range": pa.array(full, pa.int32()),
                "block": pa.array(np.full(len(full), key[0].as_py()), pa.int64()),
                "hashes": pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()),
            }
        )

    def count(key: tuple, entries: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in entries["hashes"].to_pylist()]
        hashes, times = np.unique(np.concatenate(lists), return_counts=True)
        again = hashes[times > 1]
        bits = [np.isin(x, again, assume_unique=True) for x in lists]
        answered = [k for k, x in enumerate(bits) if x.any()]
        return pa.table(
            {
                "block": entries["block"].take(pa.array(answered, pa.int64())).combine_chunks(),
                "range": pa.array([key[0].as_py()] * len(answered), pa.int32()),
                "found": pa.array([len(bits[k]) for k in answered], pa.int32()),
                "bits": pa.array([np.packbits(bits[k]).tobytes() for k in answered], pa.binary()),
            }
        )

    def cut(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = list(_windows(texts, width, n_ranges))
        every = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _, _ in parts)])
        hashes, times, at = _dealt(every, np.concatenate([np.zeros(0, np.int32), *(r for *_, r in parts)]), n_ranges)
        again = times > 1
        for k, n, bits in zip(*(answers[c].to_pylist() for c in ("range", "found", "bits")), strict=True):
            again[at[k] : at[k + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        again = np.sort(hashes[again])
        out = [pa.table({f.name: pa.array([], f.type) for f in _RESULT})]
        for part, first, h, starts, _ in parts:
            hit = starts[again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h] if len(again) else starts[:0]
            steps = np.zeros(first[-1] + 1, np.int32)
            steps[hit] += 1
            np.subtract.at(steps, hit + width, 1)
            covered = np.cumsum(steps)[:-1] > 0
            doc, start, end = _intervals(covered, first)
            before = np.concatenate([[0], np.cumsum(covered)])
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
            kept = []
            for k, text in enumerate(part.column("text").to_pylist()):
                words = (text or "").encode().split()
                if before[first[k + 1]] > before[first[k]]:
                    words = [w for w, gone in zip(words, covered[first[k] : first[k + 1]].tolist(), strict=True) if not gone]
                kept.append(b" ".join(words).decode())
            out.append(
                pa.table(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(np.diff(first), pa.int64()),
                        "n_removed": pa.array(before[first[1:]] - before[first[:-1]], pa.int64()),
                        "removed": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32()), spans),
                        "text": pa.array(kept, pa.string()),
                    },
                    schema=_RESULT,
                )
            )
        return pa.concat_tables(out)

    answers = rows.groupBy("block").applyInArrow(send, ENTRY_SCHEMA).groupBy("range").applyInArrow(count, ANSWER_SCHEMA)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, RESULT_SCHEMA)


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("text", pa.string()),
    ]
)
