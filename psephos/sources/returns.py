"""Result files of several layouts, all brought to contest rows (state_po, office, district_num, dem, rep and other votes, winner's party)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import collapse
from . import delimited, documents
from .snapshots import Registry

COLUMNS = ["state_po", "office", "district_num", "dem_votes", "rep_votes", "other_votes", "winner_party"]
#: Titles of contests, with the district as the group.
TITLES = [
    ("us_house", r"(?i)(?:u\.?s\.?|united states) *(?:house|rep)[^0-9]*([0-9]+)?"),
    ("us_house", r"(?i)(?:representative in|member of) congress[^0-9]*([0-9]+)?"),
    ("us_house", r"(?i)congressional district[^0-9]*([0-9]+)"),
    ("us_senate", r"(?i)(?:u\.?s\.?|united states) *senat"),
    ("governor", r"(?i)^governor"),
    ("president", r"(?i)president"),
]
parsers = Registry(COLUMNS)


def contests(rows: DataFrame, state: Column, title: str, party: str, votes: str, titles: Sequence[tuple[str, str]] = tuple(TITLES)) -> DataFrame:
    """Rows (title, party label, votes) of any layout as contest rows; other contests are left out."""
    found = rows.withColumns({"_c": text.contest(F.col(title), titles), "_party": text.party(F.col(party)), "_votes": F.col(votes).try_cast("bigint"), "_state": state})
    named = found.where("_c.office is not null").select(F.col("_state").alias("state_po"), "_c.office", F.col("_c.district").alias("district_num"), F.col("_party").alias("party"), F.col("_votes").alias("votes"))
    out = collapse.contest_buckets(named, ["state_po", "office", "district_num"], "party", "votes", "DEMOCRAT", "REPUBLICAN")
    return out.withColumnsRenamed({"first_votes": "dem_votes", "second_votes": "rep_votes"}).select(*COLUMNS)


def wide(df: DataFrame, fixed: Sequence[str], total_label: str | None = None, label: str | None = None) -> DataFrame:
    """A column per candidate as rows (fixed..., candidate, votes); rows of a total are left out."""
    rows = df.where(F.upper(F.trim(label)) != total_label) if total_label and label else df
    names = [c for c in df.columns if c not in fixed]
    return rows.unpivot(list(fixed), names, "candidate", "votes").withColumn("votes", text.whole_number(F.col("votes")))


@parsers.register("election_xml")
def election_xml(spark: SparkSession, path: str) -> DataFrame:
    """Contest and Choice elements; the state is the two letters before the file's ending."""
    state = F.upper(F.regexp_extract(F.input_file_name(), r"([A-Za-z]{2})\.xml", 1))
    return contests(documents.xml_contests(spark, path), state, "contest", "party", "votes")


@parsers.register("tab_lines")
def tab_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated files with contest, choice_party, total_votes and state columns."""
    rows = delimited.bronze(spark, path, "tab_lines", "", "\t")
    return contests(rows.withColumn("_v", text.whole_number(F.col("total_votes"))), F.col("state"), "contest", "choice_party", "_v")


@parsers.register("semicolon_lines")
def semicolon_lines(spark: SparkSession, path: str) -> DataFrame:
    """Headerless semicolon files: state; office; party; votes."""
    rows = delimited.headerless(spark, path, ["state", "title", "party", "votes"])
    return contests(rows, F.col("state"), "title", "party", "votes")


@parsers.register("zip_tabs")
def zip_tabs(spark: SparkSession, path: str) -> DataFrame:
    """Zipped tab-separated lines: state, contest, party, votes, with a header line."""
    lines = documents.zip_lines(spark, path, ".*\\.(txt|tsv)").where((F.col("pos") > 0) & (F.trim("line") != ""))
    parts = F.split("line", "\t")
    rows = lines.select(*(F.get(parts, k).alias(n) for k, n in enumerate(("state", "title", "party", "votes"))))
    return contests(rows, F.col("state"), "title", "party", "votes")


@parsers.register("keyed_json")
def keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of contests by key, each with state, title and choices of party and votes."""
    rows = documents.keyed_json(spark, path, "state string, title string, choices array<struct<party:string,votes:bigint>>")
    return contests(rows.select("state", "title", F.inline("choices")), F.col("state"), "title", "party", "votes")


@parsers.register("sheet")
def sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet's columns state, contest, party and votes below a header in row 1."""
    rows = documents.with_header(documents.sheet_cells(spark, path), ["path", "sheet"], 1, ["state", "contest", "party", "votes"])
    return contests(rows, F.col("state"), "contest", "party", "votes")


def carried_lines(lines: DataFrame, keys: Sequence[str], order: str, line: str, state: Column) -> DataFrame:
    """Text lines of a canvass: a contest's title, then lines that end in a party in brackets and a number."""
    from ..operators.windows import carried_header

    is_title = text.contest(F.col(line), TITLES)["office"].isNotNull() & ~F.col(line).rlike(r"\)\s+[\d,]+\s*$")
    titled = carried_header(lines, keys, order, F.when(is_title, F.col(line)), "_title")
    parts = titled.select("_title", F.regexp_extract(line, r"\(([^)]*)\)\s+[\d,]+\s*$", 1).alias("_label"), text.whole_number(F.regexp_extract(line, r"([\d,]+)\s*$", 1)).alias("_number"))
    return contests(parts.where("_number is not null and _title is not null and _label <> ''"), state, "_title", "_label", "_number")
