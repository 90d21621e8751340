"""Sinks and stores: write-once snapshots, immutable bundles, manifests with checksums, parser registry."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_once(df: DataFrame, root: str, day: date | str, key: str = "snapshot") -> str:
    """A Parquet partition ``key=day`` that must not exist yet; Spark's committer makes it appear as a whole."""
    path = f"{root.rstrip('/')}/{key}={day}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshots(spark: SparkSession, root: str, as_of: str | None = None, key: str = "snapshot") -> DataFrame:
    """All snapshots, or those up to ``as_of``; other partitions are not read."""
    df = spark.read.parquet(root)
    return df.where(F.col(key) <= F.lit(as_of).cast("date")) if as_of else df


def checksums(spark: SparkSession, path: str, source: str, day: str, tier: int, license_name: str) -> DataFrame:
    """A manifest row per file: id ``source__day``, path, size, sha256, tier and licence."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.lit(f"{source}__{day}").alias("manifest_id"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(tier).alias("tier"), F.lit(license_name).alias("license"))


def with_rows(manifest: DataFrame, path: str) -> DataFrame:
    """The manifest with n_rows, the lines of each file (text sources; a header counts)."""
    lines = manifest.sparkSession.read.option("recursiveFileLookup", True).text(path)
    counts = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))
    # Both readers name files by address, one of them with the scheme and two more slashes.
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = manifest.withColumn("_p", bare("path")).join(counts.select(bare("path").alias("_p"), "n_rows"), "_p", "left")
    return joined.drop("_p").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def write_mirrored(df: DataFrame, path: str) -> None:
    """The table as Parquet in ``path``/parquet and as CSV with a header in ``path``/csv; neither may exist yet."""
    df.write.mode("errorifexists").parquet(f"{path}/parquet")
    df.write.mode("errorifexists").option("header", True).csv(f"{path}/csv")


def write_report(rows: DataFrame, path: str) -> None:
    """A report's rows, one JSON object a line with nulls kept, in one file: reports are aggregates of few rows."""
    rows.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of two manifests that were added, removed or changed."""
    a, b = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full_outer").where("not (was <=> now)").select("path", status.alias("status"))


def write_bundle(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], root: str, run_id: str, facts: Mapping[str, object]) -> None:
    """An immutable bundle: each table with its declared columns only, then a manifest; a bundle without one is not complete."""
    for name, df in tables.items():
        df.select(*columns[name]).write.mode("errorifexists").parquet(f"{root}/{run_id}/{name}")
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({"run_id": run_id, "tables": {n: list(columns[n]) for n in tables}, **facts}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{root}/{run_id}/manifest")


def bundles(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, tier, manifest) of the complete bundles, newest id first."""
    found = spark.read.option("recursiveFileLookup", False).text(f"{root}/*/manifest").withColumn("run_id", F.get_json_object("value", "$.run_id"))
    return found.select("run_id", F.get_json_object("value", "$.tier").cast("int").alias("tier"), F.col("value").alias("manifest")).orderBy(F.desc("run_id"))


def bundle_table(spark: SparkSession, root: str, run_id: str, name: str, most_tier: int = 2) -> DataFrame:
    """A table of a bundle whose tier allows it."""
    known = bundles(spark, root).where(F.col("run_id") == run_id).first()
    if known is None:
        raise ValueError(f"no complete bundle {run_id}")
    if (known.tier or 0) > most_tier:
        raise ValueError(f"bundle {run_id} has tier {known.tier}")
    return spark.read.parquet(f"{root}/{run_id}/{name}")


def digest(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row (n, sha256): the digest of the rows' JSON hashes, the same for any order of rows and columns.

    Row hashes are added up as four numbers, so that no task sees all rows.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = df.select(*(part(k).alias(f"_{k}") for k in range(8))).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"_{k}"), F.lit(0)).cast("string").alias(f"_{k}") for k in range(8)))
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.col(f"_{k}") for k in range(8))), 256).alias("sha256"))


class Registry:
    """Parsers by name, each ``f(spark, path) -> DataFrame``; what they give is checked against a schema."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.parsers = list(columns), {}

    def register(self, name: str):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            if name in self.parsers:
                raise ValueError(f"{name} is registered already")
            self.parsers[name] = f
            return f

        return add

    def extract(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        df = self.parsers[name](spark, path)
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"{name}: missing columns {missing}")
        return df.select(*self.columns).withColumn("parser", F.lit(name))
