"""Documents through five stages: language, recurring lines, near copies, benchmark leaks, and the mix of sources.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
documents; the last adds block, slot and offset, the places in the mix. Stages don't rely on each other.

Cases, for every stage: null ids, texts, languages and sources, repeated rows, empty tables and further columns go
through; each stage says below which rows it takes out or changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import decontaminate, langid, lines, mixing, near
from psephos.llm.storage import named, split_by, stored


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``rejected`` names by doc_id and text_hash."""
    named = rejected.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    # The row's own columns are kept in one, so their names can't clash.
    rows = docs.select(F.struct("*").alias("r"))
    return rows.join(named, F.col("r.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("r.text") == F.col("h")), "left_anti").select("r.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and documents whose language is ambiguous go; lang stays as it was labelled."""
    found = langid.identify(docs.select("doc_id", "text", "lang"))
    return _without(docs, found.where((F.col("lang_pred") == langid.UNKNOWN) | F.col("ambiguous")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; every document stays, with n_chars of its new text."""
    found = lines.deduplicated(docs.select("doc_id", "text", F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("r")))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("r.n_chars"))}
    return found.select(*(changed.get(c, F.col("r").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links make, the document of the smallest doc_id stays; rows of one doc_id are one document, of which one row stays. Null ids stay."""
    columns = [named(c) for c in docs.columns]
    found = near.near_duplicates(docs.select("doc_id", "text"))
    removed = stored(found.where("component_id < doc_id").select(F.col("doc_id").alias("d")).distinct(), "removed")
    # Most rows are told apart by a bit map, so their texts are not sent on; the row's own columns are kept in one.
    told = split_by(docs.select(F.struct(*columns).alias("r")), F.col("r.doc_id"), removed)
    kept = told.where("not _maybe").select("r.*").unionByName(told.where("_maybe").join(removed, F.col("r.doc_id") == F.col("d"), "left_anti").select("r.*"))
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    # Rows have a hash and a number, so columns of any type go along and no group of rows is sorted.
    rows = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*columns).alias("r")).select("r", F.col("r.doc_id").alias("d"), F.xxhash64("r.text").alias("h"), F.monotonically_increasing_id().alias("i"))
    rows = stored(rows, "repeated-rows")
    first = rows.groupBy("d").agg(F.min(F.struct("h", "i"))["i"].alias("first"))
    once = rows.join(first, F.col("i") == F.col("first")).select("r.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their places in a mix of the sources by their target weights."""
    return mixing.mixed(docs, mixing.TARGETS)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
]

#: Language ID is learned and can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-").lower())
    return docs
