"""Delimited text: all-string reads with lineage, comments, headerless files, character sets, directories of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimiter(spark: SparkSession, path: str, candidates: str = ",\t;|") -> str:
    """The candidate that the first line has most often; raises if it has none, as the file would be one column."""
    first = spark.read.text(path).limit(1).collect()
    counts = {c: first[0].value.count(c) if first else 0 for c in candidates}
    best = max(candidates, key=lambda c: counts[c])
    if not counts[best]:
        raise ValueError(f"{path}: no delimiter in the first line")
    return best


def bronze(spark: SparkSession, path: str, source_id: str, snapshot_date: str, sep: str | None = None, encoding: str = "UTF-8", comment: str | None = None) -> DataFrame:
    """Every column as text, names in lower case, with source_id, snapshot_date, source_file and row_hash."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("sep", sep or delimiter(spark, path)).option("encoding", encoding)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    df = df.toDF(*(c.strip().lower() for c in df.columns))
    data = F.sha2(F.to_json(F.struct(*df.columns)), 256) if df.columns else F.lit(None)
    return df.withColumns({"source_id": F.lit(source_id), "snapshot_date": F.lit(snapshot_date), "source_file": F.input_file_name(), "row_hash": data})


def commented(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with lines of # on top."""
    reader = spark.read.option("header", True).option("comment", "#")
    return (reader.schema(schema) if schema else reader).csv(path)


def headerless(spark: SparkSession, path: str, names: Sequence[str], sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Named text columns of files without a header."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("sep", sep).option("encoding", encoding).schema(schema).csv(path)


#: The characters of Windows-1252 at the places where Latin-1 has control codes.
_LATIN_CONTROLS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
_WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def any_charset(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files in UTF-8, UTF-16 with a mark, or else Windows-1252."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    mark = F.hex(F.substring("content", 1, 2))
    utf16 = F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16"))
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
    text = F.coalesce(utf16, utf8, F.translate(F.decode("content", "ISO-8859-1"), _LATIN_CONTROLS, _WINDOWS))
    return raw.select("path", F.explode(F.split(text, r"\r\n|\n|\r")).alias("line"))


def files_of(spark: SparkSession, path: str, pattern: str, without: str = "(?i)readme|codebook|documentation|_copy") -> DataFrame:
    """(path, length, modificationTime) of the files below a directory that match ``pattern`` and are no documentation or copies."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return listed.select("path", "length", "modificationTime").where(~F.element_at(F.split("path", "/"), -1).rlike(without))


def path_value(key: str):
    """The value of ``key=value`` in the file's path."""
    return F.nullif(F.regexp_extract(F.input_file_name(), f"[/_]{key}=([^/.]+)", 1), F.lit(""))


def precincts(spark: SparkSession, path: str, offices: Mapping[str, str], stages: Sequence[str] = ("GEN",), sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Rows of precinct files for some offices (label to name) at some stages: state, county, precinct, office, district, candidate, party, mode and votes.

    The filters reach the scan; names of columns are looked up in any case. Rows without a stage are general ones.
    """
    rows = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    rows = rows.toDF(*(c.strip().lower() for c in rows.columns))
    named = {"state": "state_po", "county": "county_fips", "precinct": "precinct", "district": "district", "candidate": "candidate", "party": "party_simplified", "mode": "mode", "votes": "votes"}
    office = F.try_element_at(F.create_map(*(F.lit(x) for label, name in offices.items() for x in (label.upper(), name))), F.upper(F.trim("office")))
    stage = F.upper(F.trim(F.coalesce(F.col("stage") if "stage" in rows.columns else F.lit(None).cast("string"), F.lit("GEN"))))
    kept = rows.where(F.upper(F.trim("office")).isin([o.upper() for o in offices]) & stage.isin([s.upper() for s in stages]))
    value = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return kept.select(office.alias("office"), *((F.regexp_replace(value(c), ",", "").try_cast("bigint") if n == "votes" else F.trim(value(c))).alias(n) for n, c in named.items()))
