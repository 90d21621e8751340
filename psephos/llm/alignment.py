"""Cross-tokenizer alignment by byte-owner arrays.

A text is encoded by two tokenizers, A (byte-level) and B (pieces with byte fallback), that both spell out the same bytes:
one space and the text. ``np.repeat`` of token indices over their byte lengths gives each byte its owner in A and in B.
Consecutive distinct pairs of owners are the overlaps of tokens; where both owners change at once, both tokenizations are
cut, and the tokens between two cuts are a group. The last tokens of a group end together: they are its link.

Texts are encoded in segments, cut at single spaces between two other characters (near characters whose encoding may be
that of a space none is cut). There a token of A begins for sure (its pre-tokenisation gives the space to what follows)
and one of B (no piece has a space behind another character), so segments have the tokens of the whole text, every cut
between segments is a cut of both, and each different segment is encoded once among some megabytes of text. Long texts
pass in parts: a task holds some segments at a time and the links of its documents.

Links are stored per document and counted in Spark: each task counts its own pairs of ids before anything is shuffled.
The counts, with a mark on the highest of each B id, return to the documents in blocks of at most ``BLOCK_PAIRS`` pairs,
one pass over the stored links for each block, so what is broadcast has a fixed bound whatever the corpus.

Cases: null and empty texts, and texts that A or B do not spell out exactly, have no tokens, zeros and an empty digest;
strings of special tokens are plain text; repeated rows count and are returned again; null doc_id is kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import short_batches, stored
from .words import release, runs, slices

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose different segments are encoded together, and that are aligned together; a longer segment is taken alone.
ENCODE, ALIGN = 1 << 22, 1 << 18
#: Segments that pass the tokenizers at once.
ENCODE_SEGMENTS = 1 << 12
#: Pairs of ids that are broadcast at once (17 bytes each), and links that a task counts or looks up at once.
BLOCK_PAIRS, COUNT_LINKS = 2_000_000, 1_000_000

class Spelling:
    """The bytes of all tokens of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.pool[np.repeat(self.start[ids], n) + runs(n)]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        for path in (path_a, path_b):
            if not os.path.exists(path):
                raise FileNotFoundError(f"{path}: every executor needs this vocabulary file; name its place by a parameter")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        tokens = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            tokens[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_a = Spelling(tokens)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = Spelling([bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        # Decimal ids, each followed by a separator.
        self.digits = Spelling([b"%d," % k for k in range(max(len(tokens), len(pieces)))])

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of texts that begin with a space; A encodes them as they are, B adds the space itself."""
        return [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)], self.b.encode([s[1:] for s in segments], num_threads=1)

    def flat(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B the ids of all segments one behind the other, and where those of each begin (one more at the end)."""
        ids, sizes = ([], []), ([], [])
        for k in range(0, len(segments), ENCODE_SEGMENTS):  # the tokenizers' own objects are far larger than ids
            for side, lists in enumerate(self.encoded(segments[k : k + ENCODE_SEGMENTS])):
                sizes[side].append(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids[side].append(np.fromiter(itertools.chain.from_iterable(lists), np.int64, sizes[side][-1].sum()))
        none = [np.zeros(0, np.int64)]
        return [(np.concatenate(none + i), np.cumsum(np.concatenate([[0], *n], dtype=np.int64))) for i, n in zip(ids, sizes, strict=True)]


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts, each non-empty one behind a space; where their segments begin (one more at the end), and the first segment of each text."""
    n = np.diff(ends)
    full = n > 0
    room = np.full(len(data) + np.count_nonzero(full) + 1, 0x20, np.uint8)
    firsts = (ends[:-1] + np.cumsum(full) - 1)[full]
    for i, j, k in zip(ends[:-1][full].tolist(), ends[1:][full].tolist(), firsts.tolist(), strict=True):
        room[k + 1 : k + 1 + j - i] = data[i:j]
    at = np.flatnonzero(room[:-1] == 0x20)
    at = at[at > 0]
    # Characters of two bytes from C3, of three from E4 and of four are no spaces.
    near = lambda k: room[np.maximum(at - k, 0)]
    plain = lambda b: (b > 0x20) & (b < 0x80)
    lead = lambda b, low, high: (b >= low) & (b <= high)
    before = plain(near(1)) | (near(1) >= 0x80) & (lead(near(2), 0xC3, 0xDF) | (near(2) >= 0x80) & (near(2) < 0xC0) & (lead(near(3), 0xE4, 0xEF) | (near(3) >= 0x80) & (near(3) < 0xC0) & (near(4) >= 0xF0)))
    behind = room[at + 1]
    cuts = at[before & (plain(behind) | lead(behind, 0xC3, 0xDF) | (behind >= 0xE4))]
    begins = np.zeros(len(room) - 1, bool)
    begins[firsts] = begins[cuts] = True
    starts = np.flatnonzero(begins)
    where = np.concatenate([[0], np.cumsum(full)])
    return room[:-1], np.append(starts, len(room) - 1), np.append(np.searchsorted(starts, firsts), len(starts))[where]


class Aligned(NamedTuple):
    """Tokens of some segments (``a_first``, ``b_first``: where those of each segment begin) and how they meet."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    #: Token indices of overlapping tokens, in order of bytes.
    over_a: np.ndarray
    over_b: np.ndarray
    #: Last tokens of each group, and where the groups of each segment begin.
    last_a: np.ndarray
    last_b: np.ndarray
    g_first: np.ndarray


def aligned(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """``length_*``: bytes of each token; both sides must have as many bytes in each segment."""
    owner_a, owner_b = np.repeat(np.arange(len(a)), length_a), np.repeat(np.arange(len(b)), length_b)
    ends = np.ones((2, len(owner_a)), bool)  # whether a token of A or B ends with this byte
    ends[0, :-1] = owner_a[1:] != owner_a[:-1]
    ends[1, :-1] = owner_b[1:] != owner_b[:-1]
    over, cuts = np.flatnonzero(ends.any(axis=0)), np.flatnonzero(ends.all(axis=0))
    bytes_first = np.concatenate([[0], np.cumsum(length_a)])[a_first]
    return Aligned(a, b, a_first, b_first, owner_a[over], owner_b[over], owner_a[cuts], owner_b[cuts], np.searchsorted(cuts, bytes_first))


def group_text(x: Aligned, digits: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` for each group, as bytes, and where those of each segment begin."""
    groups = np.arange(len(x.last_a))
    of_a, of_b = np.repeat(groups, np.diff(x.last_a, prepend=-1)), np.repeat(groups, np.diff(x.last_b, prepend=-1))
    place_a = np.arange(len(x.a)) + np.concatenate([[0], x.last_b + 1])[of_a]
    place_b = np.arange(len(x.b)) + (x.last_a + 1)[of_b]
    ids = np.empty(len(x.a) + len(x.b), np.int64)
    ids[place_a], ids[place_b] = x.a, x.b
    text, ends = digits.joined(ids), np.cumsum(digits.length[ids])
    text[ends[place_a[x.last_a]] - 1] = ord("|")
    text[ends[place_b[x.last_b]] - 1] = ord(";")
    return text, np.concatenate([[0], ends])[x.a_first + x.b_first]


class Encoded:
    """The tokens of the different segments of some texts, ``good`` where both tokenizers spell the segment out, and which segment stands where."""

    def __init__(self, pair: Pair, data: np.ndarray, starts: np.ndarray):
        self.pair = pair
        found = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        different = found.dictionary.to_pylist()
        self.which = found.indices.to_numpy()
        wanted = [x.encode() for x in different]
        self.good = np.ones(len(different), bool)
        self.sides = []
        for (ids, first), spelling in zip(pair.flat(different), (pair.bytes_a, pair.bytes_b), strict=True):
            spelled = spelling.joined(ids).tobytes()
            at = np.concatenate([[0], np.cumsum(spelling.length[ids])])[first].tolist()
            self.good &= np.array([spelled[i:j] == w for i, j, w in zip(at[:-1], at[1:], wanted, strict=True)], bool)
            self.sides.append((ids, first))

    def aligned(self, low: int, high: int) -> tuple[Aligned, np.ndarray]:
        """The alignment of the segments from ``low`` to ``high``, and which of them are good; the others have no tokens."""
        which = self.which[low:high]
        good = self.good[which]
        tokens, firsts = [], []
        for ids, first in self.sides:
            n = np.where(good, first[which + 1] - first[which], 0)
            tokens.append(ids[np.repeat(first[which], n) + runs(n)])
            firsts.append(np.concatenate([[0], np.cumsum(n)]))
        return aligned(*tokens, *firsts, *(x.length[ids] for x, ids in zip((self.pair.bytes_a, self.pair.bytes_b), tokens, strict=True))), good


def _alignments(pair: Pair, data: np.ndarray, ends: np.ndarray, encode: int = ENCODE) -> Iterator[tuple[np.ndarray, Aligned, np.ndarray]]:
    """For some segments at a time, in order: the text of each, their alignment, and which are good."""
    room, starts, first = segments(data, ends)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + encode, "right")) - 1)
        part = starts[at : to + 1]
        some = Encoded(pair, room[part[0] : part[-1]], part - part[0])
        low = 0
        while low < to - at:
            high = max(low + 1, int(np.searchsorted(part, part[low] + min(ALIGN, encode), "right")) - 1)
            yield doc[at + low : at + high], *some.aligned(low, high)
            low = high
        at = to


class _Document:
    """What is kept of a document while its segments pass."""

    def __init__(self):
        self.good, self.n_a, self.n_b, self.n_groups, self.digest, self.links = True, 0, 0, 0, None, []

    def add(self, good: bool, n_a: int, n_b: int, n_groups: int, text: np.ndarray, links: np.ndarray) -> None:
        if not (self.good and good):
            self.good, self.links = False, []
            return
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(text[:-1])
        self.links.append(links)

    def row(self) -> tuple:
        if not self.good or self.digest is None:
            return 0, 0, 0, "", np.zeros((2, 0), np.int32)
        return self.n_a, self.n_b, self.n_groups, self.digest.hexdigest(), np.concatenate(self.links, axis=1)


LINK_SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, link_a array<int>, link_b array<int>"


def links(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, encode: int = ENCODE) -> DataFrame:
    """For each row: doc_id, n_a, n_b, n_groups, groups_sha256, and the ids of its links as link_a and link_b."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(tokenizer_a, tokenizer_b)
        for part, data, ends in slices(batches, limit=encode):
            found = [_Document() for _ in range(len(part))]
            for docs, x, good in _alignments(pair, data, ends, encode):
                text, text_first = group_text(x, pair.digits)
                ids = np.stack([x.a[x.last_a], x.b[x.last_b]]).astype(np.int32)
                # Segments of one document lie side by side.
                edges = np.flatnonzero(np.diff(docs, prepend=-1, append=-1)) if len(docs) else docs
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    a, b, g, t = ((first[i], first[j]) for first in (x.a_first, x.b_first, x.g_first, text_first))
                    found[docs[i]].add(good[i:j].all(), a[1] - a[0], b[1] - b[0], g[1] - g[0], text[t[0] : t[1]], ids[:, g[0] : g[1]])
            n_a, n_b, n_groups, digest, pairs = zip(*(d.row() for d in found), strict=True)
            cuts = pa.array(np.concatenate([[0], np.cumsum([p.shape[1] for p in pairs])]), pa.int32())
            every = np.concatenate(pairs, axis=1)
            counts = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups}
            yield pa.record_batch(
                {"doc_id": part.column("doc_id")}
                | {name: pa.array(n, pa.int64()) for name, n in counts.items()}
                | {"groups_sha256": pa.array(digest, pa.string())}
                | {name: pa.ListArray.from_arrays(cuts, pa.array(ids)) for name, ids in zip(("link_a", "link_b"), every, strict=True)}
            )
            release()

    return docs.select("doc_id", "text").mapInArrow(align, LINK_SCHEMA)


def alignments(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """For each row: doc_id, the token ids a and b, overlaps (token indices), and groups (behind each group's last tokens).

    Texts that the tokenizers do not spell out have empty lists.
    """
    spans = "array<struct<a:int,b:int>>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(tokenizer_a, tokenizer_b)
        for part, data, ends in slices(batches):
            for k in range(len(part)):
                found = list(_alignments(pair, data[ends[k] : ends[k + 1]], np.array([0, ends[k + 1] - ends[k]])))
                if not all(good.all() for *_, good in found):
                    found = []
                sizes = np.cumsum([(0, 0), *((len(x.a), len(x.b)) for _, x, _ in found)], axis=0)[:-1]
                joined = lambda arrays: np.concatenate([np.zeros(0, np.int64), *arrays])
                lists = lambda name, more=0: [joined(getattr(x, f"{name}_{side}") + s[k] + more for (_, x, _), s in zip(found, sizes, strict=False)) for k, side in enumerate("ab")]
                struct = lambda ab: pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in ab], names=["a", "b"])
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").slice(k, 1),
                        "a": one(pa.array(joined(x.a for _, x, _ in found), pa.int32())),
                        "b": one(pa.array(joined(x.b for _, x, _ in found), pa.int32())),
                        "overlaps": one(struct(lists("over"))),
                        "groups": one(struct(lists("last", 1))),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(align, f"doc_id bigint, a array<int>, b array<int>, overlaps {spans}, groups {spans}")


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links each pair of ids has, and whether no other pair of its B id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"a": pa.array(pairs >> 32, pa.int32()), "b": pa.array(pairs & 0xFFFFFFFF, pa.int32()), "n": pa.array(n, pa.int64())})

        for _, keys, _ in _parts(batches):
            held.append(keys)
            size += len(keys)
            if size >= COUNT_LINKS:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()
        release()

    counts = stored(found.select("link_a", "link_b").mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")), "link-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``COUNT_LINKS`` links with these as keys, and where those of each row begin (one more at the end)."""
    for batch in batches:
        cuts = batch.column("link_a").offsets.to_numpy().astype(np.int64)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + COUNT_LINKS, "right")) - 1)
            part = batch.slice(at, to - at)
            a, b = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("link_a", "link_b"))
            yield part, a << 32 | b, cuts[at : to + 1] - cuts[at]
            at = to


def link_support(docs: DataFrame, block_pairs: int = BLOCK_PAIRS, **options) -> DataFrame:
    """For each row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module)."""
    spark = docs.sparkSession
    found = stored(links(docs, **options).withColumn("row", F.monotonically_increasing_id()), "token-links")
    with short_batches(spark):
        counts = stored(pair_counts(found), "pair-counts")
    n_blocks = max(1, -(-counts.count() // block_pairs))
    block = F.pmod(F.xxhash64("a", "b"), F.lit(n_blocks))
    facts = ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")

    def looked_up(k: int) -> DataFrame:
        rows = counts.where(block == k).toArrow()
        a, b, n, best = (rows.column(c).to_numpy() for c in ("a", "b", "n", "best"))
        keys = a.astype(np.int64) << 32 | b
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], n[order], best[order]))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = sent.value
            for part, wanted, cuts in _parts(batches):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = keys[at] == wanted
                    sums = [np.concatenate([[0], np.cumsum(np.where(hit, x[at], 0))]) for x in (best, n)]
                else:
                    sums = [np.zeros(len(wanted) + 1, np.int64)] * 2
                n_links, n_best, count_sum = np.diff(cuts), *(x[cuts[1:]] - x[cuts[:-1]] for x in sums)
                more = {"n_links": n_links, "n_best": n_best, "count_sum": count_sum}
                yield pa.record_batch({c: part.column(c) for c in facts} | {c: pa.array(x, pa.int64()) for c, x in more.items()})
            release()

        kept = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in facts)
        return found.select(*facts, "link_a", "link_b").mapInArrow(look, f"{kept}, n_links bigint, n_best bigint, count_sum bigint")

    parts = [looked_up(k) for k in range(n_blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    with short_batches(spark):
        every = stored(every, "link-sums")
    if n_blocks > 1:
        every = every.groupBy(*facts).agg(F.first("n_links").alias("n_links"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return every.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
