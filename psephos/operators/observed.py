"""Writes that count as they go: metrics and gates in the pass that writes, by observation."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.staging import moved


def written(df: DataFrame, path: str, metrics: Mapping[str, Column], keep: Column | None = None) -> dict:
    """Writes the rows of ``df`` that ``keep`` holds for as Parquet, and returns the metrics (aggregates) of all its rows.

    One job reads ``df`` once: the metrics are accumulated by the tasks that write.
    """
    seen = Observation()
    rows = df.observe(seen, *(c.alias(name) for name, c in metrics.items()))
    (rows.where(keep) if keep is not None else rows).write.mode("errorifexists").parquet(path)
    return dict(seen.get)


def gated(df: DataFrame, path: str, rules: Mapping[str, Column], not_empty: bool = True) -> list[tuple[str, bool, int]]:
    """Writes ``df`` and publishes it at ``path`` only if no row breaks a rule; the gate as (check, passed, n_bad).

    A null outcome breaks a rule. The rows are counted as they are written to a place beside ``path``, which is moved there
    after the last check, so no reader sees a table whose gate has not passed; one that fails stays where it is.
    """
    beside = f"{path.rstrip('/')}.unchecked-{uuid.uuid4().hex}"
    bad = {f"_{i}": F.count_if(~F.coalesce(ok, F.lit(False))) for i, ok in enumerate(rules.values())}
    counts = written(df, beside, {"_n": F.count(F.lit(1)), **bad})
    found = [(name, counts[f"_{i}"] == 0, counts[f"_{i}"]) for i, name in enumerate(rules)]
    if not_empty:
        found.append(("not_empty", counts["_n"] > 0, int(counts["_n"] == 0)))
    if all(passed for _, passed, _ in found):
        moved(df.sparkSession, beside, path)
    return found
