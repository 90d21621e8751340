"""Shapes of several rings: WKT to nested coordinates, CRS checks, and points in polygons over cells that fit the shapes.

A shape is an array of polygons, a polygon an array of rings (the outer one, then holes), a ring an array of points. The
even-odd rule over all rings tells inside from outside, so holes and multipolygons need no rule of their own; a point on
an edge counts for one side only, as the usual half-open rule has it.

For the join, each shape is cut in the cells of one grid, whose size follows the shape's: at most ``ACROSS`` + 1 cells
each way, whether the shape is a street or a continent. A cell keeps only the edges that can be crossed from within it (a
ray to the right), so a coast of a million points is not looked at whole for each point. Points look into one cell of
each size that some shape has; sizes are powers of two, so they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACROSS = 8
_POINT = "struct<x:double,y:double>"
#: The shape of numbers, rings and polygons in WKT.
_RING = r"\(([^()]+)\)"
_POLYGON = r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"


def crs_of(wkt: Column) -> Column:
    """The reference system of ``SRID=n;...``, null where none is said."""
    return F.nullif(F.regexp_extract(wkt, r"(?i)^\s*SRID\s*=\s*([0-9]+)\s*;", 1), F.lit("")).cast("int")


def shape(wkt: Column) -> Column:
    """The nested coordinates of a POLYGON or MULTIPOLYGON, null for anything else; an empty one has no polygons. Further ordinates are left out."""
    body = F.regexp_replace(wkt, r"(?i)^\s*SRID\s*=\s*[0-9]+\s*;", "")
    number = lambda p, k: F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(k)).try_cast("double")
    point = lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y"))
    ring = lambda r: F.transform(F.split(r, ","), point)
    polygon = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_RING), F.lit(1)), ring)
    found = F.transform(F.regexp_extract_all(body, F.lit(_POLYGON), F.lit(1)), polygon)
    return F.when(body.rlike(r"(?i)^\s*(MULTI)?POLYGON\b"), found)


def edges(shape: Column) -> Column:
    """All edges of all rings (x1, y1, x2, y2); rings need not be closed."""

    def of_ring(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    return F.flatten(F.transform(F.flatten(shape), of_ring))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule: whether a ray to the right crosses an odd number of edges."""

    def crossed(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return F.size(F.filter(edges, lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1


def one_crs(df: DataFrame, crs: str, other: DataFrame, other_crs: str) -> DataFrame:
    """``df`` that raises, when it is run, unless all rows of both tables name one and the same reference system."""
    named = lambda d, c: d.select(F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("_c"))
    said = named(df, crs).unionByName(named(other, other_crs)).agg(F.min("_c").alias("_low"), F.max("_c").alias("_high"))
    bad = F.when((F.col("_low") != F.col("_high")) | (F.col("_low") == "none"), F.concat_ws(" ", F.lit("reference systems differ:"), "_low", "_high"))
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(said)).where(checked).drop("_low", "_high")  # one row


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("bigint")


def cells(shapes: DataFrame, shape_id: str, shape: str = "shape") -> DataFrame:
    """(shape_id, level, cx, cy, edges): the cells of each shape with the edges that a ray to the right may cross from there."""
    e = shapes.select(F.col(shape_id), edges(F.col(shape)).alias("_e")).where(F.size("_e") > 0)
    low = lambda a, b: F.array_min(F.concat(F.col(f"_e.{a}"), F.col(f"_e.{b}")))
    high = lambda a, b: F.array_max(F.concat(F.col(f"_e.{a}"), F.col(f"_e.{b}")))
    box = e.withColumns({"_x0": low("x1", "x2"), "_x1": high("x1", "x2"), "_y0": low("y1", "y2"), "_y1": high("y1", "y2")})
    size = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")) / ACROSS
    level = F.when(size > 0, F.ceil(F.log2(size))).otherwise(0).cast("int")
    box = box.withColumn("level", level)
    each = lambda v0, v1: F.explode(F.sequence(_cell(F.col(v0), F.col("level")), _cell(F.col(v1), F.col("level"))))
    # Rows of cells first: their edges are cut once for the whole row.
    rows = box.withColumn("cy", each("_y0", "_y1"))
    step = F.pow(F.lit(2.0), F.col("level"))
    bottom, top = F.col("cy") * step, (F.col("cy") + 1) * step
    rows = rows.withColumn("_e", F.filter("_e", lambda s: (F.greatest(s["y1"], s["y2"]) >= bottom) & (F.least(s["y1"], s["y2"]) <= top)))
    left = F.col("cx") * step
    out = rows.withColumn("cx", each("_x0", "_x1")).withColumn("edges", F.filter("_e", lambda s: F.greatest(s["x1"], s["x2"]) >= left))
    return out.where(F.size("edges") > 0).select(shape_id, "level", "cx", "cy", "edges")


def points_in_shapes(points: DataFrame, shapes: DataFrame, point_id: str, shape_id: str, shape: str = "shape") -> DataFrame:
    """Each point (x, y) with its shape and status placed, unplaced or overlap (in several shapes, then none is named).

    Points without a coordinate are unplaced; shapes that are null or empty hold nothing; ids of points are unique. Equal
    points and equal shapes are looked at once, a shape with its number and least id.
    """
    alike = shapes.groupBy(shape).agg(F.struct(F.min(shape_id).alias("id"), F.count("*").alias("n")).alias("_held"))
    tiles = cells(alike, "_held", shape)
    levels = tiles.agg(F.sort_array(F.collect_set("level")).alias("_levels"))  # a number per size of cells
    spots = points.select("x", "y").where("x is not null and y is not null").distinct()
    spread = spots.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("_levels"))
    spread = spread.select("x", "y", "level", _cell(F.col("x"), F.col("level")).alias("cx"), _cell(F.col("y"), F.col("level")).alias("cy"))
    # The cells are many times what Spark expects from the shapes' size, so they must not be broadcast for it.
    hits = spread.join(tiles.hint("merge"), ["level", "cx", "cy"]).where(inside(F.col("x"), F.col("y"), F.col("edges")))
    found = hits.groupBy("x", "y").agg(F.sum("_held.n").alias("_n"), F.min("_held.id").alias("_shape"))
    status = F.when(F.col("_n").isNull(), "unplaced").when(F.col("_n") > 1, "overlap").otherwise("placed")
    return points.join(found, ["x", "y"], "left").select(*points.columns, F.when(F.col("_n") == 1, F.col("_shape")).alias(shape_id), status.alias("status"))
