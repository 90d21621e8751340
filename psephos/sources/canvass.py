"""Text canvasses whose columns are places on the line: tokens by their offsets, joined to the spans of header columns.

A token is what stands between runs of two or more spaces, or the line's ends. Header lines that follow each other are one
block; tokens of its lines that lie above each other are one column, so wrapped titles are read whole. Below a block, until
the next one, each number goes to a column: by order where the line has as many numbers as the block has columns, else by
place, to the column that it overlaps most, and without overlap to the one whose right edge is nearest, as numbers are set
flush right. What stands before the first number is the row's label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import whole_number

_TOKEN = r"\S+(?: \S+)*"
_NUMBER = r"^-?[0-9][0-9,]*%?$"


def tokens(lines: DataFrame, keys: Sequence[str], pos: str, line: str) -> DataFrame:
    """(keys, pos, k, token, start, end): the tokens of each line with their offsets in characters."""
    found = lambda group: F.regexp_extract_all(line, F.lit(f"(.*?)({_TOKEN}|$)"), F.lit(group))
    pieces = lines.select(*keys, pos, F.posexplode(F.arrays_zip(found(1).alias("gap"), found(2).alias("token"))).alias("k", "p"))
    end = F.sum(F.length("p.gap") + F.length("p.token")).over(Window.partitionBy(*keys, pos).orderBy("k"))
    placed = pieces.select(*keys, pos, "k", "p.token", end.cast("int").alias("end")).where("token <> ''")
    return placed.withColumn("start", F.col("end") - F.length("token"))


def blocks(lines: DataFrame, keys: Sequence[str], pos: str, is_header: Column) -> DataFrame:
    """The lines with _header and _block, the place of the first line of the header block at or above them; lines above all are left out."""
    order = Window.partitionBy(*keys).orderBy(pos)
    marked = lines.withColumn("_header", F.coalesce(is_header, F.lit(False)))
    begins = F.col("_header") & ~F.coalesce(F.lag("_header").over(order), F.lit(False))
    named = marked.withColumn("_first", F.when(begins, F.col(pos)))
    return named.withColumn("_block", F.last("_first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_first").where("_block is not null")


def columns(header: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """(keys, _block, column, name, low, high) of header tokens (with _block): the columns from left to right, from 0."""
    order = Window.partitionBy(*keys, "_block").orderBy("start", "end", pos)
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = header.withColumn("_new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    numbered = fresh.withColumn("column", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "start", "token"))), lambda t: t["token"]), " ")
    return numbered.groupBy(*keys, "_block", "column").agg(name.alias("name"), F.min("start").alias("low"), F.max("end").alias("high"))


def cells(lines: DataFrame, keys: Sequence[str], pos: str, line: str, is_header: Column, label_columns: int = 1) -> DataFrame:
    """(keys, block, pos, label, column, name, value) of the numbers below header blocks.

    The first ``label_columns`` columns of a header stand above the labels and take no numbers. Two numbers that go to one
    column by place are both kept, so that totals don't reconcile rather than lose one.
    """
    placed = blocks(lines, keys, pos, is_header)
    found = tokens(placed, [*keys, "_block", "_header"], pos, line)
    heads = columns(found.where("_header"), keys, pos).where(F.col("column") >= label_columns)
    below = found.where("not _header").withColumn("_number", F.col("token").rlike(_NUMBER))
    row = Window.partitionBy(*keys, pos)
    order = row.orderBy("start")
    first = F.min(F.when(F.col("_number"), F.col("start"))).over(row)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_number") & (F.col("start") < F.col("_first")), F.struct("start", "token"))).over(row)), lambda t: t["token"]), " ")
    rows = below.withColumn("_first", first).where("_first is not null").withColumn("label", words).where("_number")
    rows = rows.withColumns({"_n": F.count("*").over(row), "_place": (F.row_number().over(order) - 1).cast("int")})
    # A header has few columns, so each number meets them all.
    listed = F.array_sort(F.collect_list(F.struct("column", "name", "low", "high")))
    joined = rows.join(heads.groupBy(*keys, "_block").agg(listed.alias("_columns")), [*keys, "_block"])
    by_order = F.get("_columns", F.col("_place"))
    apart = lambda c: -F.greatest(F.least(F.col("end"), c["high"]) - F.greatest(F.col("start"), c["low"]), F.lit(0))
    by_place = F.array_min(F.transform("_columns", lambda c: F.struct(apart(c).alias("a"), F.abs(c["high"] - F.col("end")).alias("b"), c["column"].alias("column"), c["name"].alias("name"))))
    whole = F.col("_n") == F.size("_columns")
    pick = lambda c: F.when(whole, by_order[c]).otherwise(by_place[c]).alias(c)
    return joined.select(*keys, F.col("_block").alias("block"), pos, "label", pick("column"), pick("name"), whole_number(F.regexp_replace("token", "%$", "")).alias("value"))


def reconciled(found: DataFrame, keys: Sequence[str], total: str = "TOTAL") -> DataFrame:
    """(keys, name, total, summed, passed): each column's printed total, over all pages of ``keys``, against the sum of its rows."""
    is_total = F.upper(F.trim("label")).startswith(total.upper())
    sums = found.groupBy(*keys, "name").agg(F.sum(F.when(is_total, F.col("value"))).alias("total"), F.coalesce(F.sum(F.when(~is_total, F.col("value"))), F.lit(0)).alias("summed"))
    return sums.withColumn("passed", F.coalesce(F.col("total") == F.col("summed"), F.lit(False)))
