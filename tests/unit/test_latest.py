import datetime
import os

import pytest
from pyspark.sql import functions as F

from psephos.streaming import latest

SCHEMA = "seat string, seen timestamp, holder string"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    latest.use_store(spark)
    yield
    spark.conf.set(key, before)


def day(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)


class Ledger:
    """Batches of observations go through one checkpoint, a run for each, so every batch is also a restart."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.out = spark, str(folder), []

    def observe(self, *rows):
        name = f"{self.folder}/in/{len(os.listdir(f'{self.folder}/in')) if os.path.exists(f'{self.folder}/in') else 0:03}"
        self.spark.createDataFrame([(s, day(d), h) for s, d, h in rows], SCHEMA).coalesce(1).write.json(name)
        stream = self.spark.readStream.schema(SCHEMA).json(f"{self.folder}/in/*")
        changes = latest.latest_changes(stream, ["seat"], "seen", ["holder"], "10 days", 100)
        got = []
        run = changes.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        assert run.awaitTermination(300)
        self.out += got
        return sorted((r.seat, (r.seen - day(0)).days, r.holder, r.change) for r in got)

    def changes(self):
        return self.spark.createDataFrame([tuple(r) for r in self.out], SCHEMA + ", change string")


def test_changes_expiry_and_restart(spark, store, tmp_path):
    x = Ledger(spark, tmp_path)
    assert x.observe(("a", 0, "p"), ("b", 0, "q"), ("a", 2, "r"), ("a", 2, "r")) == [("a", 2, "r", "new"), ("b", 0, "q", "new")]
    # Repeated, late but within the lateness and losing, and a correction of the same moment.
    assert x.observe(("a", 2, "r"), ("a", 1, "z"), ("b", 0, "s")) == [("b", 0, "s", "corrected")]
    assert x.observe(("b", 5, "t"), ("c", 60, "u")) == [("b", 5, "t", "changed"), ("c", 60, "u", "new")]
    # The watermark is day 50: what is older is dropped, so the ledger keeps its row.
    assert x.observe(("a", 40, "late")) == []
    got = x.observe(("c", 120, "v"))
    assert [g for g in got if g[3] != "expired"] == [("c", 120, "v", "changed")] and {g[0] for g in got if g[3] == "expired"} == {"a", "b"}
    assert x.observe(("a", 121, "w")) == [("a", 121, "w", "new")]
    standing = {r.seat: (r.holder, r.expired) for r in latest.standing(x.changes(), ["seat"], "seen", ["holder"]).collect()}
    assert standing == {"a": ("w", False), "b": ("t", True), "c": ("v", False)}


def test_same_as_batch_in_any_order(spark, store, tmp_path):
    rows = [(f"s{k % 5}", (k * 7) % 9, None if k % 4 == 0 else f"h{k % 3}") for k in range(40)]
    x = Ledger(spark, tmp_path)
    for k in range(0, 40, 20):
        x.observe(*rows[k : k + 20])
    batch = spark.createDataFrame([(s, day(d), h) for s, d, h in rows], SCHEMA).groupBy("seat").agg(F.max(F.struct("seen", "holder")).alias("m")).select("seat", "m.*")
    found = latest.standing(x.changes(), ["seat"], "seen", ["holder"]).drop("expired")
    assert sorted(found.collect()) == sorted(batch.collect())
    assert x.changes().count() < 40


def test_state_belongs_to_groups_of_keys(spark, store, tmp_path):
    """5000 keys take up far fewer entries of state; each still expires by itself, at the watermark too."""
    n = 5000
    entries = []

    def observe(frame):
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
        changes = latest.latest_changes(stream, ["seat", "district"], "seen", ["holder"], "10 days", 100)
        write = lambda rows, k: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}")
        run = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert run.awaitTermination(300)
        entries.extend(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"])

    seat, district = F.concat(F.lit("s"), F.col("id")), F.when(F.col("id") % 2 == 0, F.col("id"))
    seen = lambda days: F.timestamp_seconds(F.lit(1767225600) + days * 86400)
    observe(spark.range(n).select(seat.alias("seat"), district.alias("district"), seen(F.col("id") % 50).alias("seen"), F.lit("p").alias("holder")))
    observe(spark.range(1).select(F.lit("last").alias("seat"), F.lit(None).cast("long").alias("district"), seen(F.lit(130)).alias("seen"), F.lit("q").alias("holder")))
    changes = spark.read.parquet(f"{tmp_path}/out/*")
    # The watermark is day 120, so what was seen by day 20 has expired.
    expired = changes.where("change = 'expired'").groupBy("seen").count().orderBy("seen").collect()
    assert [((r.seen - day(0)).days, r["count"]) for r in expired] == [(k, n // 50) for k in range(21)]
    standing = latest.standing(changes, ["seat", "district"], "seen", ["holder"])
    assert standing.count() == n + 1 and standing.where("expired").count() == 21 * n // 50
    assert max(entries) < n
