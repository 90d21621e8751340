"""Composed builds: staged tables that depend on each other, rebuilt only where something they are made from has changed.

A step names its inputs, tables or other steps. Its key is a checksum of its version and of the keys of its inputs; a
table's key is a digest of its rows (``snapshots.digest``), whatever files they lie in. A step whose key is published is
not run. Else its rows are written and checked in one pass (``observed.gated``) and published under the key only if its
gate passes; steps behind a failed gate are not run either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources import snapshots
from ..sources.staging import exists
from . import observed


@dataclass(frozen=True)
class Step:
    """``make`` gets the inputs in their order. ``version`` changes with the step's meaning; ``rules`` are its gate."""

    name: str
    inputs: Sequence[str]
    make: Callable[..., DataFrame]
    rules: Mapping[str, Column] = field(default_factory=dict)
    version: str = "1"
    not_empty: bool = True


@dataclass(frozen=True)
class Outcome:
    """What became of a step: status is reused, published, refused (its gate failed) or blocked (an input is not there)."""

    name: str
    status: str
    key: str | None = None
    path: str | None = None
    checks: tuple[tuple[str, bool, int], ...] = ()


def ordered(steps: Sequence[Step], tables: Sequence[str]) -> list[Step]:
    """The steps behind their inputs; raises on names that are missing, twice there or in a circle."""
    by_name = {s.name: s for s in steps}
    if len(by_name) < len(steps) or set(by_name) & set(tables):
        raise ValueError("names of steps and tables must differ")
    out, done = [], set(tables)
    while len(out) < len(steps):
        ready = [s for s in steps if s.name not in done and all(i in done for i in s.inputs)]
        if not ready:
            raise ValueError(f"missing or circular inputs of {sorted(set(by_name) - done)}")
        out += ready
        done |= {s.name for s in ready}
    return out


def table_key(df: DataFrame) -> str:
    """A checksum of the rows and columns of a table: the same for any order, files and partitions."""
    kinds = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    found = snapshots.digest(df, []).first()  # one row
    return hashlib.sha256(f"{kinds}|{found.n}|{found.sha256}".encode()).hexdigest()


def build(spark: SparkSession, root: str, steps: Sequence[Step], tables: Mapping[str, DataFrame]) -> dict[str, Outcome]:
    """Runs what has changed; published tables lie at ``root``/name/key."""
    used = {i for s in steps for i in s.inputs} & set(tables)
    keys = {name: table_key(tables[name]) for name in sorted(used)}
    rows, outcomes = dict(tables), {}
    for step in ordered(steps, list(tables)):
        if any(i in outcomes and outcomes[i].path is None for i in step.inputs):
            outcomes[step.name] = Outcome(step.name, "blocked")
            continue
        key = hashlib.sha256("|".join([step.name, step.version, *(f"{i}={keys[i]}" for i in step.inputs)]).encode()).hexdigest()
        path = f"{root.rstrip('/')}/{step.name}/{key}"
        if exists(spark, path):
            outcomes[step.name] = Outcome(step.name, "reused", key, path)
        else:
            checks = tuple(observed.gated(step.make(*(rows[i] for i in step.inputs)), path, step.rules, step.not_empty))
            good = all(passed for _, passed, _ in checks)
            outcomes[step.name] = Outcome(step.name, "published" if good else "refused", key, path if good else None, checks)
            if not good:
                continue
        keys[step.name] = key
        rows[step.name] = spark.read.parquet(path)
    return outcomes
