"""Vectorised words of Arrow text columns: boundaries and 64-bit hashes by numpy, without a Python object per word.

Both word definitions in use here look at ASCII characters only, so they hold byte by byte in UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19

_BYTES = np.arange(256)
#: Words end at ASCII white space.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words are runs of digits, small letters and all that is not ASCII (texts are lower-cased first).
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: A-Z to a-z, all else unchanged.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_ODD = np.uint64(0x9E3779B97F4A7C17)
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 64)
        for name, base in (("up", _ODD), ("down", np.uint64(pow(int(_ODD), -1, 2**64)))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"][:n], _tables["down"][:n]


def release() -> None:
    """Give freed memory back: Spark keeps Python workers for later tasks, and theirs counts as the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about ``limit`` bytes of text, each with its bytes and their offsets (null: empty)."""
    for batch in batches:
        column = batch.column(text).fill_null("")
        wide = pa.types.is_large_string(column.type)
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to
    release()


def word_bounds(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words as byte offsets, and the index of each text's first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    starts_at = inside[1:] & ~inside[:-1]
    ends_at = inside[:-1] & ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    touching = cuts[inside[cuts] & inside[cuts + 1]]
    starts_at[touching] = True
    ends_at[touching] = True
    starts = np.flatnonzero(starts_at[:-1])
    return starts, np.flatnonzero(ends_at), np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``width`` words that lie in one text, and the index of their first words."""
    n = len(words)
    up, down = powers(max(n, 1) + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    starts = window_starts(first, width)
    return mix((sums[starts + width] - sums[starts]) * down[starts]), starts


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(first[:-1] - before, counts)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
