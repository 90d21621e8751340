"""Queries of geometry. Suppliers play areas: diamonds with a diamond hole and an island, of sizes from a yard to half the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry
from .catalog import register, table


def _diamond(x, y, r):
    """A closed ring around (x, y), all corners at whole numbers."""
    corner = lambda dx, dy: F.concat_ws(" ", (x + dx * r).cast("string"), (y + dy * r).cast("string"))
    return F.concat(F.lit("("), F.concat_ws(", ", corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1), corner(1, 0)), F.lit(")"))


def areas(spark, sf_dir):
    """(area, wkt): a diamond of radius r with a hole of half of it, and an island of a quarter in the hole."""
    x, y = F.col("s_suppkey") * 37 % 1000, F.col("s_suppkey") * 91 % 1000
    r = F.pow(F.lit(2), 2 + F.col("s_suppkey") % 8).cast("bigint")
    shape = F.concat(F.lit("SRID=4269;MULTIPOLYGON (("), _diamond(x, y, r), F.lit(", "), _diamond(x, y, (r / 2).cast("bigint")), F.lit("), ("), _diamond(x, y, (r / 4).cast("bigint")), F.lit("))"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("area"), shape.alias("wkt"))


@register(
    "points_in_shapes",
    """WITH p AS (SELECT c_custkey, (c_custkey * 17 % 1000) + 0.25 AS x, (c_custkey * 53 % 1000) + 0.125 AS y FROM customer),
    a AS (SELECT s_suppkey AS area, s_suppkey * 37 % 1000 AS cx, s_suppkey * 91 % 1000 AS cy, CAST(pow(2, 2 + s_suppkey % 8) AS BIGINT) AS r FROM supplier),
    h AS (SELECT c_custkey, area FROM p JOIN a ON abs(x - cx) + abs(y - cy) < r AND (abs(x - cx) + abs(y - cy) > r / 2 OR abs(x - cx) + abs(y - cy) < r / 4)),
    n AS (SELECT c_custkey, count(*) AS n, min(area) AS area FROM h GROUP BY 1)
    SELECT p.c_custkey, CASE WHEN n = 1 THEN area END AS area, CASE WHEN n IS NULL THEN 'unplaced' WHEN n > 1 THEN 'overlap' ELSE 'placed' END AS status FROM p LEFT JOIN n ON n.c_custkey = p.c_custkey""",
)
def points_in_shapes(spark, sf_dir):
    """Customers as points in areas with holes and islands, given as WKT of one reference system."""
    shapes = areas(spark, sf_dir).select("area", geometry.shape(F.col("wkt")).alias("shape"), geometry.crs_of(F.col("wkt")).alias("crs"))
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 17 % 1000 + 0.25).cast("double").alias("x"), (F.col("c_custkey") * 53 % 1000 + 0.125).cast("double").alias("y"), F.lit(4269).alias("crs"))
    found = geometry.points_in_shapes(geometry.one_crs(points, "crs", shapes, "crs"), shapes, "c_custkey", "area")
    return found.select("c_custkey", "area", "status")


@register(
    "shape_rings",
    """SELECT s_suppkey AS area, 4269 AS crs, CAST(2 AS INTEGER) AS polygons, CAST(3 AS INTEGER) AS rings, CAST(15 AS INTEGER) AS points, 2 * r * r * 0.75 + r * r / 8.0 AS surface
    FROM (SELECT s_suppkey, CAST(pow(2, 2 + s_suppkey % 8) AS BIGINT) AS r FROM supplier)""",
)
def shape_rings(spark, sf_dir):
    """What is read from the areas' WKT, with their surface by the rings' signed areas, holes taken out."""
    a = areas(spark, sf_dir).select("area", geometry.crs_of(F.col("wkt")).alias("crs"), geometry.shape(F.col("wkt")).alias("shape"))
    double_area = lambda ring: F.abs(F.aggregate(geometry.edges(F.array(F.array(ring))), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    of_polygon = lambda p: F.aggregate(F.transform(p, double_area), F.lit(0.0), lambda s, v: s - v) + 2 * double_area(p[0])
    surface = F.aggregate(F.transform("shape", of_polygon), F.lit(0.0), lambda s, v: s + v) / 2
    return a.select("area", "crs", F.size("shape").alias("polygons"), F.size(F.flatten("shape")).alias("rings"), F.size(F.flatten(F.flatten("shape"))).alias("points"), surface.alias("surface"))
