import pytest
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import clusters, spatial, tables
from geofeat.operators import features as ft

WKT = {
    "square with hole": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))",
    "two squares": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((2 2, 3 2, 3 3, 2 3, 2 2)))",
    "line": "LINESTRING (0 0, 1 0, 1 1)",
    "point": "POINT (1 2)",
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("wkt", WKT.values())
def test_wkt_round_trip(spark, wkt):
    again = geo.to_wkt(geo.from_wkt(F.lit(wkt)), 1)
    assert one(spark, again.alias("x")).x.replace(".0", "") == wkt


def test_null_wkt(spark):
    assert one(spark, geo.from_wkt(F.lit(None).cast("string")).alias("x")).x is None


@pytest.mark.parametrize("lon,lat,inside", [(0.5, 0.5, True), (2, 2, False), (0, 2, True), (1, 2, True), (5, 5, False), (3.5, 3.9, True)])
def test_covers(spark, lon, lat, inside):
    g = geo.from_wkt(F.lit(WKT["square with hole"]))
    assert one(spark, geo.st_covers_point(g, F.lit(float(lon)), F.lit(float(lat))).alias("x")).x is inside


def test_area_length_centroid(spark):
    hole, line = geo.from_wkt(F.lit(WKT["square with hole"])), geo.from_wkt(F.lit(WKT["line"]))
    row = one(spark, geo.area_m2(hole).alias("a"), geo.area_m2(geo.from_wkt(F.lit(WKT["two squares"]))).alias("m"), geo.length_m(line).alias("l"), geo.length_m(hole).alias("z"), geo.centroid(hole).alias("c"))
    assert row.a / row.m == pytest.approx(6, rel=1e-2) and row.l == pytest.approx(111_319.5 + 110_574.4, rel=1e-5) and row.z == 0
    assert (row.c.lon, row.c.lat) == pytest.approx((2, 2))


def test_distances(spark):
    a = [F.lit(x) for x in (34.5, 31.5, 34.51, 31.51)]
    row = one(spark, geo.distance_m(*a).alias("d"), geo.geodesic_m(*a).alias("g"), geo.geodesic_m(*a[:2], *a[:2]).alias("z"))
    assert row.d == pytest.approx(row.g, rel=1e-7) and row.z == 0


def test_intersects_within(spark):
    g = lambda t: geo.from_wkt(F.lit(t))
    big, small, far, crossing = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON ((20 20, 21 20, 21 21, 20 20))", "POLYGON ((8 -1, 10 -1, 10 10, 8 10, 8 -1))"
    row = one(spark, geo.st_intersects(g(big), g(small)).alias("a"), geo.st_intersects(g(big), g(far)).alias("b"), geo.st_intersects(g(big), g(crossing)).alias("c"), geo.st_within(g(small), g(big)).alias("d"), geo.st_within(g(crossing), g(big)).alias("e"))
    assert tuple(row) == (True, False, True, True, False)


def test_geohash(spark):
    assert one(spark, geo.geohash(F.lit(-5.603), F.lit(42.605), 5).alias("x")).x == "ezs42"


@pytest.mark.parametrize("lat0", [0.0, 31.5, 60.0, -45.0])
def test_cell_join_equals_nested_loop(spark, lat0):
    points = tables.sample_in_range(spark, (10.0, 10.02, lat0, lat0 + 0.02), 150, 5)
    q, t = points.where("id < 50").withColumnRenamed("id", "geom_id"), points.where("id >= 50").withColumnRenamed("id", "obj_id")
    got = spatial.dwithin_points(q, t, 300.0).select("geom_id", "obj_id")
    d = geo.distance_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, q.join(t.toDF("obj_id", "lon2", "lat2"), d <= 300).select("geom_id", "obj_id").collect()))


def test_duplicates_are_refused(spark):
    df = spark.createDataFrame([(0, 116.45391699999999, 39.881534), (1, 116.45391699999999, 39.881534)], "geom_id long, lon double, lat double")
    with pytest.raises(ValueError):
        ft.assert_distinct(df)


def test_bundle_levels():
    assert {f.names()[0] for f in ft.bundle(ft.DEFAULT_BUNDLE, 1)} < {f.names()[0] for f in ft.bundle(ft.DEFAULT_BUNDLE, 3)}
    assert "area_of_building_0m" in {f.names()[0] for f in ft.bundle(ft.DEFAULT_BUNDLE)}


@pytest.mark.parametrize("spec", [{"param1": ["a", "b"], "param1_a__param2": [1, 2], "param1_a__param2_1__param3": [3, 4]}, {"param1": ["a", "b"], "param1_a__param2": [1, 2], "param2_1__param3": [3, 4]}])
def test_param_grid(spark, spec):
    got = {tuple(x for x in r if x is not None) for r in tables.param_grid(spark, spec).collect()}
    assert got == {("a", "1", "3"), ("a", "1", "4"), ("a", "2"), ("b",)}


def test_hull():
    assert clusters._hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]


def test_time_bucket_unit():
    with pytest.raises(ValueError):
        tables.time_bucket(F.lit(None), "week")


def test_empty_range(spark):
    with pytest.raises(ValueError):
        tables.sample_in_range(spark, (1.0, 1.0, 0.0, 1.0), 3, 1)


@pytest.mark.parametrize(
    "wkt,within",
    [
        ("POLYGON ((0.2 3, 3.8 3, 3.8 3.5, 0.2 3.5, 0.2 3))", False),  # all vertices in the arms of the U
        ("POLYGON ((0.2 0.2, 3.8 0.2, 3.8 0.8, 0.2 0.8, 0.2 0.2))", True),
        ("LINESTRING (0.5 3, 3.5 3)", False),
        ("LINESTRING (0.5 3, 0.5 0.5, 3.5 0.5)", True),
        ("POINT (2 2)", False),
        ("POINT (1 2)", True),
    ],
)
def test_within_a_concave_area(spark, wkt, within):
    u = geo.from_wkt(F.lit("POLYGON ((0 0, 4 0, 4 4, 3 4, 3 1, 1 1, 1 4, 0 4, 0 0))"))
    assert one(spark, geo.st_within(geo.from_wkt(F.lit(wkt)), u).alias("x")).x is within


def test_within_an_area_with_a_hole(spark):
    h = geo.from_wkt(F.lit(WKT["square with hole"]))
    around = geo.from_wkt(F.lit("POLYGON ((0.5 0.5, 3.5 0.5, 3.5 3.5, 0.5 3.5, 0.5 0.5))"))
    beside = geo.from_wkt(F.lit("POLYGON ((0.1 0.1, 0.9 0.1, 0.9 3.9, 0.1 3.9, 0.1 0.1))"))
    row = one(spark, geo.st_within(around, h).alias("a"), geo.st_within(beside, h).alias("b"), geo.st_within(h, h).alias("c"))
    assert (row.a, row.b, row.c) == (False, True, True)


def test_centroid_over_all_parts(spark):
    two = geo.centroid(geo.from_wkt(F.lit("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((4 0, 4 1, 7 1, 7 0, 4 0)))")))
    hole = geo.centroid(geo.from_wkt(F.lit("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 0, 2 4, 0 4, 0 0))")))
    row = one(spark, two.alias("a"), hole.alias("b"))
    assert (row.a.lon, row.a.lat) == pytest.approx(((0.5 + 3 * 5.5) / 4, 0.5)) and (row.b.lon, row.b.lat) == pytest.approx((3, 2))


def test_nearest_of_several_polygons_has_no_area(spark):
    layer = spark.createDataFrame([(1, "MULTIPOLYGON (((0 0, 0.001 0, 0.001 0.001, 0 0.001, 0 0)), ((0.002 0, 0.003 0, 0.003 0.001, 0.002 0.001, 0.002 0)))", "yes")], "obj_id long, wkt string, building string").withColumn("geom", geo.from_wkt(F.col("wkt")))
    q = spark.createDataFrame([(1, 0.0005, 0.0005)], "geom_id long, lon double, lat double")
    f = ft.AreaOfNearest(ft.BUILDING, "b", "building", 100.0)
    assert ft.FeatureBuilder([f], {"b": layer}).transform(q).first()[1] == 0.0
