"""Semi-structured sources: XML, JSON, header-row matrices, HTML tables, zip archives, spreadsheets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archives


def xml_contests(spark: SparkSession, path: str) -> DataFrame:
    """(contest, choice, party, votes) of Contest elements with Choice children."""
    schema = "_text string, Choice array<struct<_party:string,_text:string,_totalVotes:bigint>>"
    rows = spark.read.format("xml").option("rowTag", "Contest").schema(schema).load(path)
    return rows.select(F.col("_text").alias("contest"), F.explode_outer("Choice").alias("c")).select("contest", F.col("c._text").alias("choice"), F.col("c._party").alias("party"), F.col("c._totalVotes").alias("votes"))


#: Parties of the members' list.
_MEMBER_PARTIES = {"D": "DEMOCRAT", "R": "REPUBLICAN", "I": "INDEPENDENT"}


def xml_roster(spark: SparkSession, path: str, states: Sequence[str], seats: int | None = None) -> DataFrame:
    """(state_po, district_num, holder, party) of a house's member list in XML: voting districts of ``states``; a vacant seat has no holder.

    Raises, when run, if there are not exactly ``seats`` different districts.
    """
    schema = "statedistrict string, `member-info` struct<`official-name`:string,party:string>"
    rows = spark.read.format("xml").option("rowTag", "member").schema(schema).load(path)
    place, name = F.trim("statedistrict"), F.trim(F.coalesce(F.col("`member-info`.`official-name`"), F.lit("")))
    party = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _MEMBER_PARTIES.items() for x in kv)), F.col("`member-info`.party")), F.lit("OTHER"))
    found = rows.select(F.substring(place, 1, 2).alias("state_po"), F.substring(place, 3, 2).try_cast("int").alias("district_num"), F.when((name != "") & (F.lower(name) != "vacant"), name).alias("holder"), party.alias("party"), place.alias("_p"))
    voting = found.where((F.length("_p") == 4) & F.col("state_po").isin(list(states)) & F.col("district_num").isNotNull()).drop("_p")
    if seats is None:
        return voting
    counts = voting.agg(F.count("*").alias("_n"), F.countDistinct("state_po", "district_num").alias("_u"))  # one row
    whole = F.when((F.col("_n") == seats) & (F.col("_u") == seats), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("roster has not all districts:"), F.col("_n").cast("string"), F.lit("rows,"), F.col("_u").cast("string"), F.lit("districts"))).cast("boolean"))
    return voting.crossJoin(F.broadcast(counts.select(whole.alias("_ok")))).where("_ok").drop("_ok")


def json_pages(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The elements of ``results`` of multi-line JSON pages, with ``item`` as their DDL."""
    return spark.read.option("multiLine", True).schema(f"results array<struct<{item}>>").json(path).select(F.inline("results"))


def keyed_json(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(key, fields...) of a JSON object of objects."""
    raw = spark.read.option("wholetext", True).text(path)
    parsed = raw.select(F.explode(F.from_json("value", f"map<string,struct<{item}>>")).alias("key", "v"))
    return parsed.select("key", "v.*")


def matrix_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of arrays whose first row is the header, as text columns. The header is one row of one file."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "row"))
    header = rows.where("pos = 0").select("row").first()
    if header is None:
        raise ValueError(f"{path}: no header row")
    return rows.where("pos > 0").select(*(F.try_element_at("row", F.lit(i + 1)).alias(name.strip().lower()) for i, name in enumerate(header.row)))


class _Cells(HTMLParser):
    """Cells of all tables, in order: (table, row, column, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.table, self.row, self.column, self.parts = [], -1, -1, -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self._close()
            self.column, self.parts = self.column + 1, []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.parts is not None:
            self.parts.append(data)

    def _close(self):
        if self.parts is not None:
            self.cells.append((self.table, self.row, self.column, re.sub(r"\s+", " ", "".join(self.parts)).strip()))
            self.parts = None


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, column, text) of every table cell; null or tableless pages have none."""
    kind = dict(pages.dtypes)[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cells = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Cells()
                parser.feed(text or "")
                parser.close()
                parser._close()
                keys += [k] * len(parser.cells)
                cells += parser.cells
            table, row, column, text = zip(*cells, strict=True) if cells else ((), (), (), ())
            numbers = {n: pa.array(v, pa.int32()) for n, v in (("table", table), ("row", row), ("column", column))}
            yield pa.record_batch({key: pa.array(keys, batch.schema.field(0).type), **numbers, "text": pa.array(text, pa.string())})

    return pages.select(key, html).mapInArrow(read, f"{key} {kind}, table int, row int, column int, text string")


def zip_lines(spark: SparkSession, path: str, pattern: str = ".*", encoding: str = "UTF-8") -> DataFrame:
    """(path, member, pos, line) of the archives' text members whose names match, a task for each member."""
    return archives.read(spark, "ziplines", path, pattern=pattern, encoding=encoding)


def sheet_cells(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, sheet, row, column, text) of the cells of xlsx files, counted from 1, a task for each sheet whose title matches."""
    return archives.read(spark, "xlsxcells", path, pattern=pattern)


def with_header(cells: DataFrame, keys: list[str], header_row: int, names: list[str]) -> DataFrame:
    """Cells (row, column, text) as rows with the named header columns, by where the header has them."""
    header = cells.where(F.col("row") == header_row).select(*keys, "column", F.lower(F.trim("text")).alias("_name"))
    rows = cells.where(F.col("row") > header_row).join(header, [*keys, "column"])
    return rows.groupBy(*keys, "row").pivot("_name", [n.lower() for n in names]).agg(F.first("text"))


def schema_of(*fields: tuple[str, str]) -> T.StructType:
    """A schema from (name, type) pairs."""
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
