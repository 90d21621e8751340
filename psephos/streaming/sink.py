"""Runs a stream over what is there to its end and gives its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..sources.staging import shared_dir


def finished(stream: DataFrame, mode: str, seconds: int = 1800) -> DataFrame:
    """The rows of a stream in append or complete mode once all input that is there has gone through it.

    Executors write the rows as Parquet, batch by batch; a batch that is run again replaces its rows. Raises TimeoutError
    where the stream has not ended in time, and the stream's own error where it failed.
    """
    spark, written = stream.sparkSession, set()
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, k: int) -> None:
        place = f"{folder}/rows/batch-{k if mode == 'append' else 0}"
        rows.write.mode("overwrite").parquet(place)
        written.add(place)

    run = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"the stream has not ended in {seconds} s")
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*sorted(written))


def appended(stream: DataFrame, path: str, checkpoint: str, seconds: int = 1800) -> None:
    """Runs a stream from its checkpoint over what is there; its rows come as Parquet into a folder per batch under ``path``.

    A batch that is run again replaces its folder. Errors are those of ``finished``.
    """
    write = lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/batch-{k}")
    run = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"the stream has not ended in {seconds} s")
