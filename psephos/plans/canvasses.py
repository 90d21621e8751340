"""Queries of text canvasses: counts of orders by nation, county and status, printed in columns and read back by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import canvass
from .catalog import register, table

_STATUS = ("F", "O", "P")
#: Counties are the customers' last digit in base 7; a count of nothing is blank.
_COUNTS_SQL = "SELECT c_nationkey AS nation, 'County ' || (c_custkey % 7) AS county, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 GROUP BY ALL"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, pos, line): a wrapped header, a line for each county, some shifted, the header again after three, and a total."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = o.groupBy(F.col("c_nationkey").alias("nation"), F.concat(F.lit("County "), (F.col("c_custkey") % 7).cast("string")).alias("county")).pivot("o_orderstatus", list(_STATUS)).count()
    sums = counts.groupBy("nation").agg(F.lit("Total").alias("county"), *(F.sum(s).alias(s) for s in _STATUS))
    cell = lambda s: F.lpad(F.coalesce(F.regexp_replace(F.format_number(F.col(s), 0), "^0$", ""), F.lit("")), 14, " ")
    shift = F.when(F.col("county").endswith("1") | F.col("county").endswith("4"), "   ").otherwise("")
    body = counts.unionByName(sums).select("nation", F.when(F.col("county") == "Total", 90).otherwise(10 * F.substring("county", -1, 1).cast("int") + 10).alias("pos"), F.rtrim(F.concat(F.rpad("county", 20, " "), shift, *map(cell, _STATUS))).alias("line"))
    head = [F.lit(" " * 28 + "Fred" + " " * 10 + "Olga" + " " * 11 + "Pam"), F.lit("County" + " " * 23 + "(F)" + " " * 11 + "(O)" + " " * 11 + "(P)")]
    heads = F.array(*(F.struct(F.lit(at + k).alias("pos"), line.alias("line")) for at in (0, 35) for k, line in enumerate(head)), F.struct(F.lit(34).alias("pos"), F.lit("page 2").alias("line")))
    return body.unionByName(counts.select("nation").distinct().select("nation", F.explode(heads).alias("h")).select("nation", "h.*"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvass.cells(_lines(spark, sf_dir), ["nation"], "pos", "line", F.col("line").rlike(r"\((F|O|P)\)|Fred"))


@register("canvass_columns", f"SELECT nation, county AS label, ['Fred (F)', 'Olga (O)', 'Pam (P)'][list_position(['F', 'O', 'P'], status)] AS name, n AS value FROM ({_COUNTS_SQL})")
def canvass_columns(spark, sf_dir):
    return _cells(spark, sf_dir).where("label <> 'Total'").select("nation", "label", "name", "value")


@register("canvass_totals", f"SELECT nation, ['Fred (F)', 'Olga (O)', 'Pam (P)'][list_position(['F', 'O', 'P'], status)] AS name, sum(n) AS total, sum(n) AS summed, true AS passed FROM ({_COUNTS_SQL}) GROUP BY 1, 2")
def canvass_totals(spark, sf_dir):
    return canvass.reconciled(_cells(spark, sf_dir), ["nation"])
