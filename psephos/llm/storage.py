"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where nothing else is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="psephos-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """The column of this name, whatever signs stand in it."""
    return F.col(f"`{name.replace('`', '``')}`")


#: Rows of long lists that are read, and that go to Python, at once.
BATCH_ROWS = 256


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Batches of so many rows, from Parquet and to Python, for what runs inside: a row may hold thousands of values."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


#: Words of the bit map that is broadcast to tell rows apart, 64 bits each.
WORDS = 1 << 18


def split_by(rows: DataFrame, id_: Column, ids: DataFrame) -> DataFrame:
    """``rows`` with _maybe: false where ``id_`` is none of ``ids``, of one column; true else, and for few other rows.

    What has to be joined by its id is less by that: the rows that are told apart here are not sorted or sent on. The
    bits stand for hashes, so many more ids than bits cost work only.
    """
    word = lambda c: F.xxhash64(c).bitwiseAND(F.lit(WORDS - 1))
    bit = lambda c: F.shiftright(F.xxhash64(c), 32).bitwiseAND(F.lit(63)).cast("int")
    of = F.col(ids.columns[0])
    bits = ids.select(word(of).alias("_word"), bit(of).alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    told = rows.withColumns({"_at": word(id_), "_bit": bit(id_)}).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    return told.withColumn("_maybe", F.expr("coalesce(shiftright(_bits, _bit) & 1L, 0L) = 1L")).drop("_at", "_bit", "_word", "_bits")
