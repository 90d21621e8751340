"""Intermediate tables in the folder that driver and executors share: lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where nothing else is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="psephos-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder in its own file system, whatever Spark reads it by; raises if ``target`` is there or the rename fails."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(target)
    system = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(b) or not system.rename(a, b):
        raise FileExistsError(f"{target} is there already, or {source} can't be moved")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
