"""The latest observation per key as keyed state: change rows only, event-time timers, expiry.

``streams.latest_per_key`` gives every key again with every batch; here a key is heard of only when something changes. Its
state is one observation. An observation replaces it if it is greater by (time, values), nulls first, so late and
repeated observations change nothing unless they would win in a batch over all rows, and the order of arrival within the
lateness does not matter. When the watermark passes the observation's time and the expiry, the key's state is dropped and
an ``expired`` row says so, so the store holds only keys seen within expiry and lateness.

Calls between Spark and Python cost far more than rows. So state and timer belong to groups of keys by hash, not to single
keys: a batch reads and writes a group once, and the group's timer stands at the first expiry among its keys.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_AT = "_observed_us"


_GROUP = "_group"
_NAN = float("nan")
#: Groups of keys unless the caller knows better, and keys that a group may well hold.
GROUPS, GROUP_KEYS = 1024, 500


def _utc(values: Sequence) -> tuple:
    """Times with their zone: Arrow gives them so, state without it in the local zone."""
    return tuple(v.astimezone(datetime.UTC) if isinstance(v, datetime.datetime) else v for v in values)


def _rank(values: Sequence) -> tuple:
    """Order of observations: nulls first, as in Spark's maximum of structs."""
    return tuple((v is not None, v) for v in values)


def _same(v):
    """One hashable value for what Arrow and state give of equal key values."""
    if isinstance(v, (int, str)):
        return v
    if isinstance(v, float) and v != v:
        return _NAN
    if isinstance(v, Row):
        v = v.asDict()
    if isinstance(v, dict):
        return Row(**{k: _same(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return tuple(map(_same, v))
    return bytes(v) if isinstance(v, bytearray) else v


class Latest(StatefulProcessor):
    """Keeps one observation (microseconds, values) for each key of a group; state is a list per column."""

    def __init__(self, keys: Sequence[str], values: Sequence[str], state: T.StructType, expiry_ms: int):
        self.keys, self.values, self.schema, self.expiry_ms = list(keys), list(values), state, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)
        self.row = Row(*self.keys, _AT, *self.values, "change")

    def _held(self) -> dict[tuple, tuple]:
        rows, n = zip(*self.latest.get(), strict=True) if self.latest.exists() else (), len(self.keys)
        return {tuple(map(_same, _utc(row[:n]))): _utc(row[n:]) for row in rows}

    def _keep(self, held: dict[tuple, tuple]) -> None:
        if held:
            self.latest.update(tuple(map(list, zip(*((*key, *seen) for key, seen in held.items()), strict=True))))
        else:
            self.latest.clear()

    def _due(self, held: dict[tuple, tuple]) -> int | None:
        """When the group's first key expires; the group's only timer stands there."""
        return min(seen[0] for seen in held.values()) // 1000 + self.expiry_ms if held else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = 3 + len(self.keys)
        held, fresh = self._held(), {}
        for row in rows:
            name, seen = tuple(map(_same, _utc(row[3:n]))), (row[1], *_utc(row[n:]))
            best = fresh.get(name) or held.get(name)
            if best is None or seen[0] > best[0] or seen[0] == best[0] and _rank(seen) > _rank(best):
                fresh[name] = seen
        if not fresh:
            return
        after = held | fresh
        before_due, due = self._due(held), self._due(after)
        if before_due != due:
            if before_due is not None:
                self.handle.deleteTimer(before_due)
            self.handle.registerTimer(due)
        self._keep(after)
        for name, seen in fresh.items():
            before = held.get(name)
            yield self.row(*name, *seen, "new" if before is None else "corrected" if seen[0] == before[0] else "changed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Every key of the group that is due; the timer that fired is Spark's to delete."""
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        left = {name: seen for name, seen in held.items() if seen[0] // 1000 + self.expiry_ms > now}
        if left:
            self.handle.registerTimer(self._due(left))
        self._keep(left)
        for name, seen in held.items():
            if name not in left:
                yield self.row(*name, *seen, "expired")

    def close(self) -> None:
        pass


def latest_changes(stream: DataFrame, keys: Sequence[str], observed: str, values: Sequence[str], lateness: str = "7 days", expiry_days: float = 400, groups: int = GROUPS) -> DataFrame:
    """keys, observed, values and change (new, changed, corrected, expired), a row per change, for append or update mode.

    Rows of null time are left out. Needs RocksDB as state store; ``use_store`` sets it. ``groups`` must stay the same as
    long as a checkpoint is used; a batch reads and writes the state of each group that it has rows of, so there should be
    about a group for ``GROUP_KEYS`` keys.
    """
    rows = stream.where(F.col(observed).isNotNull()).withWatermark(observed, lateness)
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias(_GROUP)
    # The time itself goes along for the watermark, which leaves out late rows.
    taken = rows.select(group, F.unix_micros(F.col(observed)).alias(_AT), observed, *keys, *values)
    field = {f.name: f for f in taken.schema}
    names = (*keys, _AT, *values)
    state = T.StructType([T.StructField(c, T.ArrayType(field[c].dataType)) for c in names])
    out = T.StructType([*(T.StructField(c, field[c].dataType) for c in names), T.StructField("change", T.StringType())])
    changes = taken.groupBy(_GROUP).transformWithState(Latest(keys, values, state, int(expiry_days * 86_400_000)), out, "Update", "EventTime")
    return changes.select(*keys, F.timestamp_micros(_AT).cast(field[observed].dataType).alias(observed), *values, "change")


def use_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def standing(changes: DataFrame, keys: Sequence[str], observed: str, values: Sequence[str]) -> DataFrame:
    """What holds after all changes: the latest observation of each key, and whether the key has expired since.

    A key's change rows are in the order of their observations; its expiry is behind the observation that it closes.
    """
    last = F.max(F.struct(F.col(observed), *(F.col(v) for v in values), (F.col("change") == "expired").alias("expired")))
    return changes.groupBy(*keys).agg(last.alias("_m")).select(*keys, "_m.*")
