import random

import pytest
from pyspark.sql import functions as F

from psephos.operators import geometry

WKT = {
    "hole": "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))",
    "two": "multipolygon(((20 0, 24 0, 24 4, 20 4)),((30 0,34 0,34 4,30 4,30 0),(31 1,32 1,32 2,31 2,31 1)))",
    "small": "POLYGON Z ((5 5 1, 5.01 5 1, 5.01 5.01 1, 5 5.01 1, 5 5 1))",
    "empty": "POLYGON EMPTY",
    "line": "LINESTRING (0 0, 9 9)",
    "none": None,
}


def shapes(spark, wkt):
    return spark.createDataFrame(list(wkt.items()), "area string, wkt string").select("area", geometry.shape(F.col("wkt")).alias("shape"))


def test_nested_rings(spark):
    rows = {r.area: r.shape for r in shapes(spark, WKT).collect()}
    assert [[len(ring) for ring in p] for p in rows["two"]] == [[4], [5, 5]] and rows["hole"][0][1][0] == (4.0, 4.0)
    assert rows["empty"] == [] and rows["line"] is None and rows["none"] is None and rows["small"][0][0][1] == (5.01, 5.0)
    assert spark.range(1).select(geometry.crs_of(F.lit("SRID=4326; POINT (1 2)")).alias("a"), geometry.crs_of(F.lit("POINT (1 2)")).alias("b")).first() == (4326, None)


def test_holes_islands_and_overlaps(spark):
    at = {"in": (1, 1), "hole": (4.5, 4.5), "both": (5.005, 5.005), "left": (22, 2), "right": (33, 3), "right hole": (31.5, 1.5), "out": (50, 50), "none": (None, 1)}
    points = spark.createDataFrame([(k, *map(lambda v: None if v is None else float(v), p)) for k, p in at.items()], "point string, x double, y double")
    found = {r.point: (r.area, r.status) for r in geometry.points_in_shapes(points, shapes(spark, WKT), "point", "area").collect()}
    assert found == {"in": ("hole", "placed"), "hole": (None, "unplaced"), "both": ("small", "placed"), "left": ("two", "placed"), "right": ("two", "placed"), "right hole": (None, "unplaced"), "out": (None, "unplaced"), "none": (None, "unplaced")}
    over = spark.createDataFrame([("a", "POLYGON ((0 0, 2 0, 2 2, 0 2))"), ("b", "POLYGON ((1 1, 3 1, 3 3, 1 3))")], "area string, wkt string").select("area", geometry.shape(F.col("wkt")).alias("shape"))
    one = spark.createDataFrame([(1, 1.5, 1.5)], "point int, x double, y double")
    assert [(r.area, r.status) for r in geometry.points_in_shapes(one, over, "point", "area").collect()] == [(None, "overlap")]


def test_copies_are_looked_at_once(spark):
    """Hundreds of equal shapes and points: their cells and pairs are not multiplied, and cells are never broadcast."""
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2))"
    many = spark.createDataFrame([(k, square) for k in range(300)] + [(300, "POLYGON ((4 4, 6 4, 6 6, 4 6))")], "area int, wkt string").select("area", geometry.shape(F.col("wkt")).alias("shape"))
    points = spark.range(900).select(F.col("id").alias("point"), F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 5.0).otherwise(9.0).alias("x")).withColumn("y", F.col("x"))
    found = geometry.points_in_shapes(points, many, "point", "area")
    assert {(r.x, r.area, r.status, r["count"]) for r in found.groupBy("x", "area", "status").count().collect()} == {(1.0, None, "overlap", 300), (5.0, 300, "placed", 300), (9.0, None, "unplaced", 300)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [level" in plan and "BroadcastHashJoin [level" not in plan


def brute(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_random_stars_against_brute_force(spark):
    """Shapes of sizes over four orders of magnitude, with many corners, and points on cell borders among them."""
    rng = random.Random(2)
    rings = {}
    for k in range(30):
        size, cx, cy = 10 ** rng.uniform(-1, 3), rng.uniform(-500, 500), rng.uniform(-500, 500)
        make = lambda f: [(round(cx + f * size * rng.uniform(-1, 1), 3), round(cy + f * size * rng.uniform(-1, 1), 3)) for _ in range(rng.randrange(3, 40))]  # noqa: B023, E731
        rings[k] = [make(1.0), make(0.4)]
    text = lambda ring: "(" + ", ".join(f"{x} {y}" for x, y in ring) + ")"
    df = spark.createDataFrame([(k, f"POLYGON ({', '.join(map(text, r))})") for k, r in rings.items()], "area int, wkt string").select("area", geometry.shape(F.col("wkt")).alias("shape"))
    at = [(rng.uniform(-600, 600), rng.uniform(-600, 600)) for _ in range(300)] + [(float(rng.randrange(-8, 8) * 64), float(rng.randrange(-8, 8) * 64)) for _ in range(100)] + [tuple(map(float, rng.choice(rings[k][0]))) for k in rings]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "point int, x double, y double")
    found = {r.point: (r.area, r.status) for r in geometry.points_in_shapes(points, df, "point", "area").collect()}
    for k, (x, y) in enumerate(at):
        own = [a for a, r in rings.items() if brute(x, y, r)]
        assert found[k] == ((own[0], "placed") if len(own) == 1 else (None, "overlap" if own else "unplaced"))
    tiles = geometry.cells(df, "area").groupBy("area").count()
    assert tiles.agg(F.max("count")).first()[0] <= (geometry.ACROSS + 1) ** 2


def test_mixed_reference_systems_are_refused(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id int, crs int")
    assert geometry.one_crs(frame([(1, 4326), (2, 4326)]), "crs", frame([(3, 4326)]), "crs").count() == 2
    for a, b in (([(1, 4326)], [(2, 4269)]), ([(1, 4326), (2, None)], [(3, 4326)]), ([(1, None)], [(2, None)])):
        with pytest.raises(Exception, match="reference systems differ"):
            geometry.one_crs(frame(a), "crs", frame(b), "crs").collect()
