"""Exact top-k search by tiled matrix products.

Vectors are quantised and packed: candidates into shards, queries into blocks, a row of bytes each. Shards and blocks
are dealt to a grid of cells, so each shard is copied once per column of the grid and each block once per row; the
grid's sides are chosen for the fewest bytes. In a cell, each pair of a block and a shard is one tile, a matrix product
in which every query's best k are selected. Per-query top lists are merged in a tree: a fixed fan-in of lists per step,
so no step sees more than ``FAN_IN * k`` entries of a query.

Only tiles and top lists exist: pairs are never rows. Products of integers below 2**53 are exact in float64; tiles
whose bounds are larger are multiplied as Python integers, of any size.

Cases: vectors that are null or hold a null, NaN or infinity take no part; only vectors of one length are compared;
an empty vector scores 0 against other empty ones; a row is never its own candidate, other rows of its vec_id are;
ties go to the smaller vec_id; scores beyond 64 bits are ranked by their exact values and shown as the nearest 64-bit
number; repeated query rows give repeated results, told apart by nothing; null ids take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

K, SCALE = 10, 1024
#: Vectors of a shard and of a query block.
SHARD, BLOCK = 4096, 1024
#: Tiles of a cell of the grid.
TILES = 16
#: Top lists that meet in one step of the merge.
FAN_IN = 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part; row tells rows apart."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    taking_part = F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull()
    return vectors.select("vec_id", "embedding").where(taking_part).select("vec_id", "embedding", F.monotonically_increasing_id().alias("row"))


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int16 or int64, or Python integers where 64 bits may not hold them."""
    most = np.abs(x).max(initial=0.0)
    if most < 2**52 / scale:
        whole = np.floor(x * scale).astype(np.int64)
        return whole.astype(np.int16) if most < 2**15 / scale - 1 else whole
    return np.array([math.floor(Fraction(e) * scale) if abs(e) >= 2**52 / scale else math.floor(e * scale) for e in x.ravel().tolist()], object).reshape(x.shape)


def packed(rows: DataFrame, name: str, group: Column, most: int, scale: int) -> DataFrame:
    """A row per (dimension, group) and ``most`` vectors: ids, row numbers and components as bytes, by id.

    Components are whole numbers of 2 or 8 bytes (the width), or doubles as they came (width 0) where those don't do.
    """

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = key[0].as_py()
        for batch in batches:
            ids, row = (batch.column(c).to_numpy() for c in ("vec_id", "row"))
            x = batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(len(ids), size)
            # Vectors with very large components are packed apart, so they don't slow the others down.
            large = np.abs(x).max(axis=1, initial=0.0) >= 2**52 / scale
            for part in (np.flatnonzero(~large), np.flatnonzero(large)):
                for at in range(0, len(part), most):
                    mine = part[at : at + most]
                    mine = mine[np.argsort(ids[mine], kind="stable")]
                    v = quantised(x[mine], scale)
                    wide = v.dtype == object
                    yield pa.record_batch(
                        {
                            "size": pa.array([size], pa.int32()),
                            "group": pa.array([key[1].as_py()], pa.int32()),
                            **{f"{name}_{c}": pa.array([b.tobytes()], pa.binary()) for c, b in (("ids", ids[mine]), ("rows", row[mine]), ("v", x[mine] if wide else v))},
                            f"{name}_width": pa.array([0 if wide else v.itemsize], pa.int32()),
                        }
                    )

    schema = f"size int, group int, {name}_ids binary, {name}_rows binary, {name}_v binary, {name}_width int"
    return rows.withColumn("size", F.size("embedding")).withColumn("group", group.cast("int")).groupBy("size", "group").applyInArrow(pack, schema)


def _matrix(data: bytes, width: int, n: int, size: int, scale: int) -> np.ndarray:
    if not width:
        return quantised(np.frombuffer(data, np.float64).reshape(n, size), scale)
    return np.frombuffer(data, np.int16 if width == 2 else np.int64).reshape(n, size)


def _most(v: np.ndarray) -> int:
    return max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0


def tile(q: np.ndarray, q_rows: np.ndarray, v: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's best k of a shard; candidates are in the order of their ids."""
    if _most(q) * _most(v) * max(1, q.shape[1]) < 2**53:
        score = (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    else:
        score = q.astype(object) @ v.astype(object).T if q.shape[1] else np.zeros((len(q), len(v)), object)
        if _most(score) < 2**63:
            score = score.astype(np.int64)
    own = q_rows[:, None] == rows[None, :]
    # Stable order by falling score leaves ties in the order of ids; what is certainly below the k-th best is left out first.
    n = min(k + 1, len(rows))
    out_q, out_v = [], []
    kth = np.partition(score, len(rows) - n, axis=1)[:, len(rows) - n]
    for i in range(len(q)):
        at = np.flatnonzero(score[i] >= kth[i])
        at = at[~own[i, at]]
        # ~x = -1 - x falls as x rises and never overflows.
        at = at[np.argsort(-1 - score[i, at], kind="stable")][:k]
        out_q.append(np.full(len(at), i))
        out_v.append(at)
    i, j = np.concatenate(out_q), np.concatenate(out_v)
    return i, j, score[i, j]


def sortable(score: int) -> tuple[int, int, bytes]:
    """(score in 64 bits, length, digits): tuples that are in the order of whole numbers of any size.

    Within 64 bits length is 0; beyond, it is the number of bytes with the number's sign, and digits are these bytes
    (a negative number's are complemented).
    """
    if -(2**63) <= score < 2**63:
        return score, 0, b""
    n = (abs(score).bit_length() + 7) // 8
    digits = abs(score).to_bytes(n, "big")
    return (2**63 - 1, n, digits) if score > 0 else (-(2**63), -n, bytes(255 - b for b in digits))


def grid(n_shards: int, n_blocks: int, shard: int, block: int, cells: int) -> tuple[int, int]:
    """(rows, columns) of about ``cells`` cells, for the fewest copies: a shard goes to each column, a block to each row."""
    cells = max(1, min(cells, n_shards * n_blocks))
    rows = min(n_shards, max(1, -(-cells // n_blocks), round(math.sqrt(cells * n_shards * shard / (n_blocks * block)))))
    return rows, min(n_blocks, -(-cells // rows))


TOP_SCHEMA = "query_row bigint, query_id bigint, part int, vec_id bigint, row bigint, score bigint, length int, digits binary"


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK, tiles: int = TILES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best other rows by the integer inner product."""
    rows = stored(usable(vectors), "vectors")
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    n_shards, n_blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    cells = max(-(-n_shards * n_blocks // tiles), vectors.sparkSession.sparkContext.defaultParallelism)
    height, width = grid(n_shards, n_blocks, shard, block, cells)
    spread = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts))
    cell = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    blocks = packed(queries, "q", spread(n_blocks, 1), block, scale)
    blocks = blocks.select("*", (F.col("group") % width).alias("column"), cell("line", height)).drop("group")
    shards = packed(rows, "s", spread(n_shards, 2), shard, scale)
    shards = shards.select("*", (F.col("group") % height).alias("line"), cell("column", width))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_rows, ids, own = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "q_rows", "s_ids", "s_rows"))
                q, v = _matrix(r["q_v"], r["q_width"], len(q_ids), r["size"], scale), _matrix(r["s_v"], r["s_width"], len(ids), r["size"], scale)
                i, j, score = tile(q, q_rows, v, own, k)
                exact = [sortable(x) for x in score] if score.dtype == object else None
                yield pa.record_batch(
                    {
                        "query_row": pa.array(q_rows[i]),
                        "query_id": pa.array(q_ids[i]),
                        "part": pa.array(np.full(len(i), r["group"]), pa.int32()),
                        "vec_id": pa.array(ids[j]),
                        "row": pa.array(own[j]),
                        "score": pa.array([x[0] for x in exact] if exact is not None else score, pa.int64()),
                        "length": pa.array([x[1] for x in exact] if exact is not None else np.zeros(len(i)), pa.int32()),
                        "digits": pa.array([x[2] for x in exact] if exact is not None else [b""] * len(i), pa.binary()),
                    }
                )

    tops = blocks.join(shards, ["size", "line", "column"]).mapInArrow(best, TOP_SCHEMA)
    groups = n_shards
    while True:
        tops = tops.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        groups = -(-groups // FAN_IN)
        order = Window.partitionBy("query_row", "part").orderBy(F.desc("length"), F.desc("digits"), F.desc("score"), "vec_id", "row")
        tops = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if groups <= 1:
            return tops.select("query_id", "rank", "vec_id", "score")
