"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


#: Edges that one task may finish, some 50 MB of Python objects.
FEW = 1 << 18


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars around the smallest nodes: the same classes with less way to go."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pa.record_batch({"a": pa.array(nodes, pa.int64()), "b": pa.array([root(x) for x in nodes], pa.int64())})


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = list(batches)
    if every:
        yield from _contracted(iter([pa.concat_batches(every)]))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node that can be reached.

    Minima are aggregated before the shuffle, and the joins on a node may be split by Spark, so a node with very many
    edges does not land in one task. Nulls and loops are left out. Each round is written to the shared folder. Once no
    more than ``FEW`` edges are left, which is counted before each round, one task makes the last step.
    """
    now = stored(edges.where("a <> b").select("a", "b").mapInArrow(_contracted, "a bigint, b bigint").distinct(), "edges")
    before = None
    while (state := now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != before and state[0]:
        before = state
        if state[0] <= FEW:
            now = stored(now.repartition(1).mapInArrow(_finished, "a bigint, b bigint"), "edges")
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(lowest, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Each edge now points down; every node hands its lower neighbours and itself to the lowest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(kept.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
