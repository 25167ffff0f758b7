"""Points of polygons by trapezoids, and samples of all kinds of geometry."""

import pytest
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import draws
from geofeat.operators import samples as sa

SHAPES = {
    "box": "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))",
    "u": "POLYGON ((0 0, 5 0, 5 4, 4 4, 4 1, 1 1, 1 4, 0 4, 0 0))",
    "thin": "POLYGON ((0 0, 1 1, 1.0001 1, 0.0001 0, 0 0))",
    "hole": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))",
    "two": "MULTIPOLYGON (((0 0, 1 0, 0 1, 0 0)), ((5 5, 8 5, 8 8, 5 5)))",
    "spike": "POLYGON ((0 0, 10 0, 10 0.001, 5 0.002, 4.9 9, 4.8 0.002, 0 0.001, 0 0))",
    "line": "LINESTRING (0 0, 1 1)",
    "flat": "POLYGON ((0 0, 1 1, 2 2, 0 0))",
}


def shapes(spark):
    return spark.createDataFrame([*SHAPES.items(), ("none", None)], "k string, wkt string").withColumn("geom", geo.from_wkt(F.col("wkt")))


def test_trapezoids_have_the_area(spark):
    rows = draws.trapezoids(shapes(spark), "k").groupBy("k").agg(F.sum((F.col("b") - F.col("a")) * (F.col("high_a") - F.col("low_a") + F.col("high_b") - F.col("low_b")) / 2).alias("area")).collect()
    got = {r.k: round(r.area, 6) for r in rows}
    assert {k: got[k] for k in ("box", "u", "thin", "hole", "two")} == {"box": 2.0, "u": 11.0, "thin": 0.0001, "hole": 12.0, "two": 5.0}
    assert "line" not in got and "none" not in got


@pytest.mark.parametrize("block", [4_096, 7])
def test_every_area_gives_the_number_asked_for(spark, monkeypatch, block):
    monkeypatch.setattr(draws, "DRAWS", block)
    df = shapes(spark)
    got = draws.sample_in_polygons(df.repartition(3), 300, 5, "k").cache()
    assert dict(got.groupBy("k").count().collect()) == dict.fromkeys(("box", "u", "thin", "hole", "two", "spike"), 300)
    assert got.select("k", "i").distinct().count() == got.count()
    grown = F.lit(1e-9)  # a point drawn on an edge may stand beside it by a rounding
    near = geo.planar_distance_m(F.col("geom"), F.col("lon"), F.col("lat"), F.lit(1.0), F.lit(1.0)) < grown
    assert not got.join(df, "k").where(~(geo.st_covers_point(F.col("geom"), F.col("lon"), F.col("lat")) | near)).count()
    assert sorted(got.collect()) == sorted(draws.sample_in_polygons(df.repartition(7), 300, 5, "k").collect())


def test_points_are_uniform(spark):
    got = draws.sample_in_polygons(shapes(spark).where("k IN ('u', 'two', 'hole')"), 4_000, 2, "k")
    share = lambda k, test: got.where(F.col("k") == k).agg(F.avg(F.expr(test).cast("double"))).first()[0]
    assert abs(share("u", "lat < 1") - 5 / 11) < 0.03 and abs(share("u", "lon > 4 AND lat > 1") - 3 / 11) < 0.03
    assert abs(share("two", "lon > 4") - 4.5 / 5) < 0.03 and abs(share("two", "lon > 6.5") - 4.5 / 5 * 0.75) < 0.03
    assert abs(share("hole", "lon < 1") - 4 / 12) < 0.03 and share("hole", "lon > 1 AND lon < 3 AND lat > 1 AND lat < 3") == 0


def test_samples_of_parts_and_collections(spark):
    rows = [
        (0, "POINT (9 9)", 1.0),
        (1, "MULTIPOINT (7 7, 8 8)", 0.5),
        (2, SHAPES["two"], 0.25),
        (3, "GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (POLYGON ((0 0, 1e0 0, 1 1, 0 0)), MULTIPOINT (3 3, 4 4)))", 0.0),
    ]
    df = spark.createDataFrame(rows, "source_idx long, wkt string, y double").withColumn("geom", geo.from_wkt(F.col("wkt")))
    got = sa.sample_from_geoms(df, 3).collect()
    assert sorted((r.source_idx, r.y) for r in got) == sorted([(0, 1.0)] + [(1, 0.5)] * 2 + [(2, 0.25)] * 6 + [(3, 0.0)] * 6)
    assert sum(r.lon > 4 for r in got if r.source_idx == 2) == 3
    with pytest.raises(ValueError):
        sa.sample_from_geoms(spark.createDataFrame([(0, "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", 1.0)], "source_idx long, wkt string, y double"))


def test_polygons_of_an_area_keep_their_holes(spark):
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1)), ((5 5, 8 5, 8 8, 5 5)))"
    row = spark.createDataFrame([(wkt,)], "wkt string").select(F.transform(geo.polygons(geo.from_wkt(F.col("wkt"))), geo.area_m2).alias("a"), geo.area_m2(geo.from_wkt(F.col("wkt"))).alias("all")).first()
    assert len(row.a) == 2 and abs(sum(row.a) - row["all"]) < 1e-3
