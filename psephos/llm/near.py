"""Exact n-gram Jaccard join with set-relation skipping, and the classes of documents that its links make.

A document's set holds its distinct shingles of ``K`` lower-cased words. First, sets that have more shingles to
themselves than a similar set may lack are left out, told by their first shingles by hash, and equal sets by all but
one. The others are ordered by one global order, from shingles that few of these sets have to those that many have, by
exact counts in steps of powers of two. The first part of each set, long enough that two sets over the threshold must
share a shingle of it, goes to an inverted index dealt by shingle. Lists of one document are never made.

* Index-level skipping: an entry knows its set's size and the shingle's position in it, so a pair is dropped where what
  is left behind the positions can't reach the threshold; lists are cut in blocks by (size, position), whose extremes
  drop whole blocks of partners. The indexed part of a set is longer by ``SHARED`` - 1 shingles than the least that finds
  all pairs, so a pair must share that many more. Chance meetings of documents are no candidates: they share what many
  have, and that comes last, however large the corpus.
* Answer-level skipping: equal sets share one set of answers, and a set that is linked with a similar set takes over
  that set's class: pairs are compared only while their sets are in different classes. Small clusters of candidates
  meet in one task each; the sets of large ones are first joined along spanning pairs, then dealt in tiles of one class
  each, and only tiles of different classes and of sizes that may link meet, each pair of tiles a task of its own.

All candidates are verified by their whole sets. No text is sent to be counted: a task sends the hashes of its sets and
gets back those that others have too.

Cases: null or blank text, no words: empty set, linked with nothing; fewer than ``K`` words: one shingle of the whole
sequence; rows of one doc_id are one document with several sets, each with its own n_shingles; a null doc_id gets a
null component and links nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import short_batches, split_by, stored
from .words import LOWER, SPACED, mix, powers, release, runs, slices, word_bounds, word_hashes

K = 5
#: Jaccard similarity as a fraction.
NUM, DEN = 3, 4
#: Shingles that a task gathers before it sends them on.
GATHER = 1 << 19
#: Bytes of text whose index entries meet in one range of hashes.
RANGE_BYTES = 16 << 20
#: Lists up to this length are compared pair by pair at once, longer ones along their order first.
SHORT = 24
BLOCK = 64
#: Shingles that two similar sets share in the indexed parts at least (all of them, if these are fewer).
SHARED = 12
#: Lists up to this length are spanned by possible pairs, still longer ones by neighbours in size.
SPANNED = 4096
#: Documents and shingles of a cluster that is compared in one place, and of a tile of a larger one.
MEMBERS, HELD = 128, 1 << 17

_FRESH = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, ends: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted."""
    data = LOWER[data]
    starts, stops, first = word_bounds(data, ends, SPACED)
    words = word_hashes(data, starts, stops)
    n = np.diff(first)
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    count = np.where(n >= k, n - k + 1, n > 0)
    at = np.repeat(first[:-1], count) + runs(count)
    width = np.repeat(np.minimum(n, k), count)
    hashes = mix((sums[at + width] - sums[at]) * down[at] + width.astype(np.uint64) * _FRESH)
    doc = np.repeat(np.arange(len(n)), count)
    edge = np.concatenate([[0], np.cumsum(count)]).tolist()
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        hashes[i:j].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def sizes(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles and a 128-bit fingerprint (f, g) of the set; null for empty sets."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in slices(batches):
            doc, hashes = shingles(data, ends, k)
            n = np.bincount(doc, minlength=len(part))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)]) for h in (hashes, mix(hashes ^ _FRESH))]
            edge = np.concatenate([[0], np.cumsum(n)])
            f, g = ((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "f": pa.array(f, mask=n == 0), "g": pa.array(g, mask=n == 0)})

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id bigint, n_shingles bigint, f bigint, g bigint")


def _gathered(batches: Iterator[pa.RecordBatch], k: int, limit: int = GATHER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, and (index of doc_id, hash) of about ``limit`` shingles at a time; equal sets within are given once."""
    ids, owner, hashes, size, texts = [], [], [], 0, 0

    def flush():
        doc, h = np.concatenate(owner), np.concatenate(hashes)
        n = np.bincount(doc, minlength=texts)
        edge = np.concatenate([[0], np.cumsum(n)])
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (h, mix(h ^ _FRESH))]
        prints = np.stack([s[edge[1:]] - s[edge[:-1]] for s in sums] + [n.astype(np.uint64)])
        _, first = np.unique(prints, axis=1, return_index=True)
        keep = np.zeros(texts, bool)
        keep[first] = True
        return np.concatenate(ids), doc[keep[doc]], h[keep[doc]]

    for part, data, ends in slices(batches):
        doc, h = shingles(data, ends, k)
        ids.append(part.column("doc_id").to_numpy(zero_copy_only=False))
        owner.append(doc + texts)
        hashes.append(h)
        size, texts = size + len(h), texts + len(part)
        if size >= limit:
            yield flush()
            ids, owner, hashes, size, texts = [], [], [], 0, 0
    if texts:
        yield flush()


def _spare(n):
    """How many of its shingles a set may lack in a similar one."""
    return n - -(-NUM * n // DEN)


def _looked_at(n):
    """How many of a set's shingles, in the order of their hashes, tell whether it can be similar to any other."""
    return np.minimum(n, _spare(n) + SHARED + n // 8)


def _cells(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _joined(cells: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind)


def shared_entries(docs: DataFrame, n_ranges: int, k: int = K, whole: bool = True) -> DataFrame:
    """The entries of shingles that more than one set has, for each block of sets that was sent; sets and sizes stand in one row of a block.

    Entries meet by hash, and each gets a rank by how many there are of its shingle, in steps of powers of two (0: one).
    Not ``whole``: of each set only the first shingles by hash, and 32 bits of a hash besides its range, so some
    shingles may be taken for shared that aren't.
    """
    cuts = np.array([-(-i * 2**64 // n_ranges) for i in range(1, n_ranges)], np.uint64)
    kind = np.uint64 if whole else np.uint32

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, (ids, doc, hashes) in enumerate(_gathered(batches, k)):
            n = np.bincount(doc, minlength=len(ids))
            if not whole:
                first = runs(n) < _looked_at(n)[doc]
                doc, hashes = doc[first], hashes[first]
            order = np.argsort(hashes)
            doc, hashes = doc[order].astype(np.min_scalar_type(len(ids))), hashes[order]
            edge = np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])
            full = np.flatnonzero(np.diff(edge))
            hashes = hashes.astype(kind)
            once = lambda v, m=len(full): pa.array([v.tobytes(), *[b""] * (m - 1)][:m], pa.binary())
            cells = {c: pa.array([v[edge[j] : edge[j + 1]].tobytes() for j in full], pa.binary()) for c, v in (("hashes", hashes), ("owners", doc))}
            yield pa.record_batch({"range": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), task << 32 | i), pa.int64())} | cells | {"ids": once(ids.astype(np.int64)), "sizes": once(n.astype(np.int32))})

    def count(rows: pa.Table) -> pa.Table:
        cells = rows["hashes"].to_pylist()
        edge = _cells([len(x) // np.dtype(kind).itemsize for x in cells])
        hashes = _joined(cells, kind)
        order = np.argsort(hashes)
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = hashes[order][1:] != hashes[order][:-1]
        times = np.diff(np.flatnonzero(new))
        ranks = np.empty(len(order), np.uint8)
        ranks[order] = np.repeat(np.frexp(times - 1)[1], times)
        out = {"hashes": [], "owners": [], "ranks": []}
        for i, owners in enumerate(rows["owners"].to_pylist()):
            here = slice(edge[i], edge[i + 1])
            many = ranks[here] > 0
            out["hashes"].append(hashes[here][many].tobytes() if whole else b"")
            out["owners"].append(np.frombuffer(owners, f"u{len(owners) // len(many)}")[many].astype(np.uint32).tobytes())
            out["ranks"].append(ranks[here][many].tobytes())
        table = pa.table({"block": rows["block"]} | {c: pa.array(v, pa.binary()) for c, v in out.items()} | {"ids": rows["ids"], "sizes": rows["sizes"]})
        return table.filter(pa.array([bool(r or i) for r, i in zip(out["ranks"], rows["ids"].to_pylist(), strict=True)], pa.bool_()))

    entries = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(send, "range int, block bigint, hashes binary, owners binary, ids binary, sizes binary")
    return entries.groupBy("range").applyInArrow(count, "block bigint, hashes binary, owners binary, ranks binary, ids binary, sizes binary")


def _block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids and sizes of a block's sets, and the owners of its entries."""
    return tuple(_joined(rows[c].to_pylist(), t) for c, t in (("ids", np.int64), ("sizes", np.int32), ("owners", np.uint32)))


def promising(docs: DataFrame, n_ranges: int, k: int = K) -> DataFrame:
    """doc_id of every set that may be similar to another one; of equal sets that a task gathers at once, one is named.

    A set that has more shingles to itself than it may lack in a similar one is not; those looked at are enough to tell.
    """

    def settle(rows: pa.Table) -> pa.Table:
        ids, n, owners = _block(rows)
        n = n.astype(np.int64)
        shared = np.bincount(owners, minlength=len(ids))
        return pa.table({"doc_id": pa.array(ids[(n > 0) & (shared >= _looked_at(n) - _spare(n))])})

    return shared_entries(docs, n_ranges, k, False).groupBy("block").applyInArrow(settle, "doc_id bigint")


LIST_SCHEMA = "token bigint, docs array<bigint>, sizes array<int>, places array<int>"


def index_lists(docs: DataFrame, n_ranges: int, k: int = K) -> DataFrame:
    """The inverted index of the sets' first parts: a list per shingle that more than one set has there, by size and position."""
    cuts = np.array([-(-i * 2**64 // n_ranges) for i in range(1, n_ranges)], np.uint64)

    def send(rows: pa.Table) -> pa.Table:
        ids, n, doc = _block(rows)
        n = n.astype(np.int64)
        hashes, ranks = (_joined(rows[c].to_pylist(), t) for c, t in (("hashes", np.uint64), ("ranks", np.uint8)))
        order = np.lexsort((hashes, ranks, doc))
        doc, hashes = doc[order], hashes[order]
        shared = np.bincount(doc, minlength=len(ids))
        place = (n - shared)[doc] + runs(shared)  # shingles of one set come first
        head = place < (_spare(n) + SHARED)[doc]
        doc, hashes, place = doc[head], hashes[head], place[head]
        order = np.argsort(hashes)
        doc, hashes, place = doc[order], hashes[order], place[order]
        edge = np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])
        full = np.flatnonzero(np.diff(edge))
        columns = {"hashes": hashes, "docs": ids[doc], "sizes": n[doc].astype(np.int32), "places": place.astype(np.int32)}
        return pa.table({"range": pa.array(full, pa.int32())} | {c: pa.array([v[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary()) for c, v in columns.items()})

    def gather(rows: pa.Table) -> pa.Table:
        kinds = {"hashes": np.uint64, "docs": np.int64, "sizes": np.int32, "places": np.int32}
        hashes, ids, size, place = (np.concatenate([np.frombuffer(x, t) for x in rows[c].to_pylist()]) for c, t in kinds.items())
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = hashes[order][1:] != hashes[order][:-1]
        edge = np.flatnonzero(new)
        shared = np.repeat(np.diff(edge) > 1, np.diff(edge))
        order = order[shared]
        hashes, ids, size, place = hashes[order], ids[order], size[order], place[order]
        order = np.lexsort((ids, place, size, hashes))
        hashes, ids, size, place = hashes[order], ids[order], size[order], place[order]
        new = np.ones(len(hashes) + 1, bool)
        new[1:-1] = hashes[1:] != hashes[:-1]
        edge = np.flatnonzero(new) if len(hashes) else np.zeros(1, np.int64)
        as_list = lambda v, t: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(v, t))
        return pa.table({"token": pa.array(hashes[edge[:-1]].view(np.int64)), "docs": as_list(ids, pa.int64()), "sizes": as_list(size, pa.int32()), "places": as_list(place, pa.int32())})

    entries = shared_entries(docs, n_ranges, k).groupBy("block").applyInArrow(send, "range int, hashes binary, docs binary, sizes binary, places binary")
    return entries.groupBy("range").applyInArrow(gather, LIST_SCHEMA)


def _possible(n1, p1, n2, p2, before=0):
    """Whether two sets that share the shingle at these places may reach the threshold, if they share at most ``before`` earlier ones."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (DEN * small >= NUM * large) & ((NUM + DEN) * (before + np.minimum(n1 - p1, n2 - p2)) >= NUM * (n1 + n2))


def spanning(size: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Possible pairs of one list that join all entries which any chain of possible pairs joins, and how many blocks were skipped.

    The list is in the order of size and place. An entry looks only at blocks with waiting entries whose extremes of
    size, and of what is left behind the place, allow a partner.
    """
    heads = np.arange(0, len(size), BLOCK)
    least, largest, left = np.minimum.reduceat(size, heads), np.maximum.reduceat(size, heads), np.maximum.reduceat(size - place, heads)
    waiting, in_block = np.ones(len(size), bool), np.diff(np.append(heads, len(size)))
    a, b, skipped = [], [], 0
    for root in range(len(size)):
        if not waiting[root]:
            continue
        waiting[root] = False
        in_block[root // BLOCK] -= 1
        found = [root]
        while found:
            x = found.pop()
            fits = (DEN * size[x] >= NUM * least) & (DEN * largest >= NUM * size[x])
            fits &= (NUM + DEN) * (SHARED - 1 + np.minimum(size[x] - place[x], left)) >= NUM * (size[x] + least)
            skipped += np.count_nonzero((in_block > 0) & ~fits)
            for k in np.flatnonzero((in_block > 0) & fits):
                new = heads[k] + np.flatnonzero(waiting[heads[k] : heads[k] + BLOCK])
                new = new[_possible(size[x], place[x], size[new], place[new], SHARED - 1)]
                waiting[new] = False
                in_block[k] -= len(new)
                found += new.tolist()
                a.append(np.full(len(new), x)), b.append(new)
    return a, b, int(skipped)


def first_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b, long): the possible ones of short lists, and so many of long lists that all their possible pairs hang together by them.

    A similar pair shares ``SHARED`` shingles of the indexed parts. Either one of them is in a long list, then the first
    of those has fewer than ``SHARED`` before it; or all are in short lists and can be counted there.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.diff(batch.column("docs").offsets.to_numpy())
            first = np.cumsum(length) - length
            ids, size, place = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("docs", "sizes", "places"))
            at, lengths = runs(length), np.repeat(length, length)
            a, b = [], []
            for step in range(1, SHORT):
                x = np.flatnonzero((lengths <= SHORT) & (at < lengths - step))
                x = x[DEN * size[x] >= NUM * size[x + step]]
                a.append(x), b.append(x + step)
            n_short = sum(map(len, a))
            for i in np.flatnonzero((length > SHORT) & (length <= SPANNED)):
                part = slice(first[i], first[i] + length[i])
                x, y, _ = spanning(size[part], place[part])
                a += [v + first[i] for v in x]
                b += [v + first[i] for v in y]
            x = np.flatnonzero((lengths > SPANNED) & (at < lengths - 1))
            x = x[DEN * size[x] >= NUM * size[x + 1]]
            a.append(x), b.append(x + 1)
            a, b = np.concatenate(a), np.concatenate(b)
            short = np.arange(len(a)) < n_short
            pairs, of = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1, return_inverse=True)
            of, n = of.ravel(), pairs.shape[1]
            both = size[a] + size[b]
            needed = np.zeros(n, np.int64)
            np.maximum.at(needed, of, np.minimum(SHARED, -(-NUM * both // (NUM + DEN))))
            any_of = lambda flag, of=of, n=n: np.bincount(of, flag.astype(float), n)
            columns = {
                "a": pa.array(pairs[0], pa.int64()),
                "b": pa.array(pairs[1], pa.int64()),
                "shared": pa.array(any_of(short).astype(np.int64)),
                "needed": pa.array(needed),
                "possible": pa.array(any_of(short & _possible(size[a], place[a], size[b], place[b])) > 0),
                "long": pa.array(any_of(~short) > 0),
            }
            yield pa.record_batch(columns).filter(pa.array(pairs[0] != pairs[1]))

    found = lists.mapInArrow(pair, "a bigint, b bigint, shared bigint, needed bigint, possible boolean, long boolean").groupBy("a", "b")
    sums = found.agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed"), F.bool_or("possible").alias("possible"), F.bool_or("long").alias("long"))
    return sums.where("long or (possible and shared >= needed)").select("a", "b", "long")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int = K) -> DataFrame:
    """The rows of ``wanted`` (doc_id and more) with the sets of their documents, as bytes."""
    names = [c for c in wanted.columns if c != "doc_id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in slices(batches):
            doc, hashes = shingles(data, ends, k)
            edge = np.searchsorted(doc, np.arange(len(part) + 1))
            sets = pa.array([hashes[edge[i] : edge[i + 1]].tobytes() for i in range(len(part))], pa.binary())
            yield pa.record_batch({c: part.column(c) for c in ("doc_id", *names)} | {"hashes": sets})

    more = "".join(f", {c} {t}" for c, t in wanted.dtypes if c != "doc_id")
    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(whole, f"doc_id bigint{more}, hashes binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or DEN * len(x) < NUM * len(y):
        return False
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return DEN * both >= NUM * (len(x) + len(y) - both)


def verified(docs: DataFrame, pairs: DataFrame, k: int = K) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold; each pair is checked by itself, wherever its sets meet."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))

    sets = stored(whole_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), k), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
    return both.mapInArrow(compare, "a bigint, b bigint")


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _close(docs: list[int], of: dict[int, list[np.ndarray]], parent: dict[int, int]) -> None:
    """Join the classes of a cluster that any pair links: smallest classes first, each set once against all others.

    The overlaps of a set with all others are counted from the lists of its shingles. The last class is not looked at,
    nor are sets within a class compared: they have the answers of their class.
    """
    piece = np.repeat(np.arange(sum(len(of[d]) for d in docs)), [len(h) for d in docs for h in of[d]])
    sizes = np.bincount(piece)
    doc_of = np.array([i for i, d in enumerate(docs) for _ in of[d]])
    tokens, token = np.unique(np.concatenate([h for d in docs for h in of[d]]), return_inverse=True)
    order = np.argsort(token, kind="stable")
    lists, edge = piece[order], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens)))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    done = np.zeros(len(docs), bool)
    while True:
        classes: dict[int, list[int]] = {}
        for i, d in enumerate(docs):
            classes.setdefault(_root(parent, d), []).append(i)
        waiting = sorted((len(m), r) for r, m in classes.items() if not done[m].all())
        if not waiting or (len(waiting) == 1 and waiting[0][0] == max(map(len, classes.values()))):
            return
        members = classes[waiting[0][1]]
        for i in members:
            if done[i]:
                continue
            done[i] = True
            for p in np.flatnonzero(doc_of == i):
                own = token[starts[p] : starts[p + 1]]
                found = lists[np.repeat(edge[own], edge[own + 1] - edge[own]) + runs(edge[own + 1] - edge[own])]
                both = np.bincount(found, minlength=len(sizes))
                for j in np.unique(doc_of[(both > 0) & (DEN * both >= NUM * (sizes + len(own) - both))]):
                    x, y = _root(parent, docs[i]), _root(parent, docs[j])
                    parent[max(x, y)] = min(x, y)


def tile_members(inside: DataFrame, members: int, held: int) -> DataFrame:
    """(tiles, side, node, n, label): the rows of ``inside`` (component, node, n, label) in each pair of tiles that must meet.

    Sets of one cluster and class with as many as ``members`` rows have tiles of their own; others share tiles. Sizes are
    dealt in steps of the threshold, so a set links only within its step and with the next. Tiles of one class don't meet.
    """
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(DEN / NUM))).cast("int")
    large = stored(inside.groupBy("component", "label").count().where(F.col("count") >= members).select("component", "label", F.lit(True).alias("pure")), "large-classes")
    dealt = inside.join(large, ["component", "label"], "left").withColumn("kind", F.when(F.col("pure"), F.col("label"))).withColumn("step", step).drop("pure")
    key = ["component", "step", "kind"]
    count = dealt.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / held)).cast("int").alias("n_tiles"))
    count = stored(count, "tiles")
    tiles = count.select("component", "step", "kind", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("tile"))
    tiles = tiles.withColumn("id", F.xxhash64("component", "step", "kind", "tile"))
    x, y = tiles.withColumn("to", F.explode(F.array("step", F.col("step") + 1))).alias("x"), tiles.alias("y")
    meet = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.to") == F.col("y.step")))
    pure = F.coalesce(F.col("x.kind") == F.col("y.kind"), F.lit(False))
    meet = meet.where(~pure & ((F.col("x.step") < F.col("y.step")) | (F.col("x.id") <= F.col("y.id"))))
    meet = meet.select(F.xxhash64("x.id", "y.id").alias("tiles"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    sides = meet.select("tiles", F.lit(0).alias("side"), F.col("a").alias("id")).unionByName(meet.where("a <> b").select("tiles", F.lit(1).alias("side"), F.col("b").alias("id")))
    c = count.select(*(F.col(k).alias(f"_{k}") for k in key), "n_tiles")
    on = (F.col("component") == F.col("_component")) & (F.col("step") == F.col("_step")) & F.col("kind").eqNullSafe(F.col("_kind"))
    placed = dealt.join(c, on).withColumn("id", F.xxhash64("component", "step", "kind", F.pmod(F.xxhash64("node"), F.col("n_tiles")).cast("int")))
    return placed.join(stored(sides, "tile-pairs"), "id").select("tiles", "side", "node", "n", "label")


def tile_links(rows: pa.Table) -> pa.Table:
    """Links (a, b) between the sets of two tiles, or of one, that join all their classes which any link joins.

    ``rows``: side, node, label, hashes. A set's overlaps with all others are counted from the lists of their shingles;
    sets that are in one class by then are not looked at.
    """
    side, node = (rows[c].to_numpy() for c in ("side", "node"))
    label = rows["label"].to_pylist()
    sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist()]
    parent = {x: x for x in label}
    second = np.flatnonzero(side == 1)
    first = np.flatnonzero(side == 0)
    others = second if len(second) else first
    a, b, open_classes = [], [], len(parent)
    if len(others) and open_classes > 1:
        sizes = np.array([len(sets[j]) for j in others])
        tokens, token = np.unique(np.concatenate([sets[j] for j in others]), return_inverse=True)
        lists = np.repeat(np.arange(len(others)), sizes)[np.argsort(token, kind="stable")]
        edge = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens)))])
        for i in first:
            if open_classes == 1:
                break
            root = _root(parent, label[i])
            away = np.array([_root(parent, label[j]) != root for j in others])
            if not away.any():
                continue
            at = np.minimum(np.searchsorted(tokens, sets[i]), len(tokens) - 1)
            own = at[tokens[at] == sets[i]]
            n = edge[own + 1] - edge[own]
            both = np.bincount(lists[np.repeat(edge[own], n) + runs(n)], minlength=len(others))
            for k in np.flatnonzero(away & (both > 0) & (DEN * both >= NUM * (sizes + len(sets[i]) - both))):
                x, y = _root(parent, label[i]), _root(parent, label[others[k]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    open_classes -= 1
                    a.append(node[i]), b.append(node[others[k]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def classified(docs: DataFrame, pairs: DataFrame, measured: DataFrame, k: int = K, members: int = MEMBERS, held: int = HELD) -> DataFrame:
    """(node, component) of the documents that links join, from ``pairs`` (a, b, long) of first documents of equal sets.

    Pairs hang together in clusters, which no link leaves. Small clusters meet in bins, each set once, and a pair is
    compared only while its two sets are in different classes: a set takes over the answers of a set that it is linked
    with. In clusters of more than ``members`` documents or ``held`` shingles, pairs are verified one by one, and then
    all sets of different classes in tiles, so no task holds more than two tiles.
    """
    clusters = stored(components(pairs), "clusters")
    size = measured.groupBy("doc_id").agg(F.sum("n_shingles").alias("n"))
    weighed = clusters.join(size.withColumnRenamed("doc_id", "node"), "node").groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    weighed = stored(weighed.withColumn("large", (F.col("docs") > members) | (F.col("n") > held)), "clusters")
    total, large = weighed.agg(F.sum(F.when(~F.col("large"), F.col("n"))), F.count_if("large")).first()
    bins = max(1, -(-(total or 0) // max(1, held // 4)))
    small = weighed.where(~F.col("large")).select("component", F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"))
    binned = clusters.join(small, "component")
    sets = whole_sets(docs, binned.select(F.col("node").alias("doc_id"), "component", "bin"), k)
    open_pairs = pairs.join(binned.select(F.col("node").alias("a"), "bin"), "a").select("bin", "a", "b", "long")

    def link(key: tuple, sets: pa.Table, pairs: pa.Table) -> pa.Table:
        of: dict[int, list[np.ndarray]] = {}
        cluster: dict[int, list[int]] = {}
        for doc, c, hashes in zip(*(sets[n].to_pylist() for n in ("doc_id", "component", "hashes")), strict=True):
            if doc not in of:
                cluster.setdefault(c, []).append(doc)
            of.setdefault(doc, []).append(np.frombuffer(hashes, np.uint64))
        home = {doc: c for c, docs in cluster.items() for doc in docs}
        parent = {doc: doc for doc in of}
        several = set()
        for a, b, long in zip(*(pairs[n].to_pylist() for n in ("a", "b", "long")), strict=True):
            x, y = _root(parent, a), _root(parent, b)
            if x != y and any(similar(p, q) for p in of[a] for q in of[b]):
                parent[max(x, y)] = min(x, y)
            if long:
                several.add(home[a])
        for c in several:
            _close(cluster[c], of, parent)
        nodes = list(parent)
        of.clear()
        release()
        return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array([_root(parent, doc) for doc in nodes], pa.int64())})

    found = sets.groupBy("bin").cogroup(open_pairs.groupBy("bin")).applyInArrow(link, "node bigint, component bigint")
    if not large:
        return stored(found, "classes")
    inside = stored(clusters.join(weighed.where("large"), "component").select("node"), "large")
    links = stored(verified(docs, stored(pairs.join(inside.withColumnRenamed("node", "a"), "a", "left_semi").select("a", "b"), "pairs"), k), "links")
    labels = inside.join(components(links).withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sized = measured.where("n_shingles > 0").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n")).distinct()
    large_clusters = clusters.join(weighed.where("large").select("component"), "component")
    dealt = stored(tile_members(large_clusters.join(labels, "node").join(sized, "node"), members, held), "tile-members")
    whole = whole_sets(docs, dealt.select(F.col("node").alias("doc_id")).distinct(), k).select(F.col("doc_id").alias("node"), (F.octet_length("hashes") / 8).cast("bigint").alias("n"), "hashes")
    more = dealt.join(stored(whole, "tile-sets"), ["node", "n"]).groupBy("tiles").applyInArrow(tile_links, "a bigint, b bigint")
    return stored(found.unionByName(components(links.unionByName(stored(more, "tile-links")))), "classes")


def near_duplicates(docs: DataFrame, k: int = K, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    with short_batches(docs.sparkSession, 1024):  # rows of whole sets and lists
        return _near_duplicates(docs, k, range_bytes)


def _near_duplicates(docs: DataFrame, k: int, range_bytes: int) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    measured = stored(sizes(docs, k), "set-sizes")
    known = measured.where("doc_id is not null and f is not null").select("doc_id", "f", "g", "n_shingles").distinct()
    # Apart from the join, so that Spark may split a set that very many documents have.
    equal = stored(known.groupBy("f", "g", "n_shingles").agg(F.min("doc_id").alias("first")), "first-documents")
    same = stored(known.join(equal, ["f", "g", "n_shingles"]).select("doc_id", "first"), "equal-sets")
    # A doc_id of several different texts stands for all of them: it stays apart as a node and is joined at the end.
    several = stored(same.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several-texts")
    single = same.join(several, "doc_id", "left_anti")
    lowest = stored(single.groupBy("first").agg(F.min("doc_id").alias("single")), "first-documents")
    # The first document of equal sets is one of a single text, if there is any.
    copies = single.join(lowest, "first").where(F.col("doc_id") != F.col("single")).select("doc_id", F.col("single").alias("first"))
    # Only sets that may be similar to others go on, each by its first document, so texts are dealt out once.
    found = promising(docs, max(1, -(-size // range_bytes)), k).distinct()
    # A first document of several texts goes besides the single one, as it may be the first of several sets.
    firsts = same.join(stored(found, "promising-sets"), "doc_id", "left_semi").select("first").distinct().join(lowest, "first", "left")
    firsts = stored(firsts.select(F.explode(F.array("first", "single")).alias("doc_id")).where("doc_id is not null").distinct(), "first-documents")
    some = split_by(docs.select("doc_id", "text"), F.col("doc_id"), firsts).where("_maybe").drop("_maybe")
    docs = stored(some.join(firsts, "doc_id", "left_semi"), "first-texts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pairs = stored(first_pairs(index_lists(docs, max(1, -(-size // range_bytes)), k)), "pairs")
    classes = classified(docs, pairs, measured, k)
    classes = classes.unionByName(copies.join(classes.withColumnRenamed("node", "first"), "first", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "first").alias("component")))
    if not several.isEmpty():
        ends = same.join(several, "doc_id").join(lowest, "first", "left").select(F.col("doc_id").alias("a"), F.coalesce("single", "first").alias("b"))
        classes = components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(ends))
    return (
        measured.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
