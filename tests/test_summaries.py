import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import features as ft
from geofeat.operators import spatial as sp
from geofeat.operators import summaries as su
from geofeat.operators import tables as tb


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 9 + [1.0], list(range(101)), [-2.5, 0.0, 0.0, 7.25, None]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    known = [v for v in values if v is not None]
    for p in (0.0, 0.3, 0.5, 0.95, 1.0):
        assert abs(su.quantile_of(df, "v", p).first().q - np.quantile(known, p)) < 1e-9
    assert su.quantile_of(df.where("false"), "v", 0.5).first().q is None


def test_masks_with_either_condition(spark):
    df = spark.createDataFrame([(k, float(k), k * 2.0 if k else None) for k in range(5)], "k long, a double, b double")
    got = su.dense_mask(df, {"a": (3, None), "b": (None, 0.5)}, ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 1, 1)]


def test_counts_in_areas(spark):
    polys = spark.createDataFrame([(0, "POLYGON ((0 0, 1 0, 0 1, 0 0))"), (1, "POLYGON ((9 9, 10 9, 10 10, 9 9))")], "source_idx long, wkt string").withColumn("geom", geo.from_wkt(F.col("wkt")))
    points = spark.createDataFrame([(1, 0.1, 0.1, "x"), (2, 0.2, 0.1, None), (3, 0.9, 0.9, "x")], "obj_id long, lon double, lat double, amenity string")
    got = su.object_counts(polys, points, {"amenity": ft.AMENITY, "object": ft.ALL}, cell=50_000.0).orderBy("source_idx").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2), (1, 0, 0)]


def test_image_of_stored_features(spark):
    box = "POLYGON (({0} 0, {1} 0, {1} 0.0001, {0} 0.0001, {0} 0))"
    rows = [(box.format(k * 0.001, k * 0.001 + 0.0001), n, v, k) for k, n, v in ((0, "h", 1.0), (2, "h", 3.0), (2, "g", 5.0), (3, "h", float("nan")), (4, "h", None), (5, "x", 1.0))]
    df = spark.createDataFrame(rows, "geom_wkt string, feature_name string, feature_value double, obj_id long")
    got = su.feature_image(df, ["h", "g"], 111.0, "obj_id").orderBy("ix", "iy").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0.0, 0.0, 1), (1, 0, 0.0, 0.0, 0), (2, 0, 1.0, 0.0, 1)]
    area = geo.box(F.lit(-1.0), F.lit(-1.0), F.lit(0.001), F.lit(1.0))
    assert su.feature_image(df, ["h", "g"], 111.0, "obj_id", area).count() == 1 and su.feature_image(df.where("false"), ["h"], 1.0, "obj_id").count() == 0


def test_frames_and_bands(spark):
    at = datetime.datetime(2020, 1, 1, 5, 30)
    df = spark.createDataFrame([(at, 1.0, 2.0), (at, 1.0, 2.0), (at, 0.5, 3.0), (at, None, 1.0), (None, 1.0, 1.0)], "ts timestamp, lat double, lon double")
    (frame,) = su.heatmap_frames(df, "ts").collect()
    assert [tuple(p) for p in frame.points] == [(0.5, 3.0), (1.0, 2.0), (1.0, 2.0)]
    shaped = df.select("ts", F.when(F.col("lat").isNotNull(), geo.point(F.col("lon"), F.col("lat"))).alias("geom"))
    assert su.heatmap_frames(shaped, "ts").collect()[0].points == frame.points
    assert [tuple(p) for p in su.heatmap_frames(df, "ts", "day", 1.0).first().points] == [(0.0, 3.0, 1), (1.0, 2.0, 2)]
    bands = spark.createDataFrame([(7, 2, 0.2), (7, 0, 0.9), (7, 1, 0.5)], "tile long, channel long, v double")
    assert su.label_by_band(bands, ["tile"], "channel", "v").first().bands == [0.9, 0.5, 0.2]
    scores = spark.createDataFrame([("a", 0.5), ("a", float("nan")), ("a", 0.7), ("b", None)], "model string, auc double")
    assert {r.model: r.auc for r in su.mean_score_by_model(scores).collect()} == {"a": 0.6, "b": None}


def test_pixels_span_the_box(spark):
    px = spark.createDataFrame([(0, 0), (2, 4)], "row long, col long")
    assert [(r.lon, r.lat) for r in su.pixels_to_points(px, (1.0, 2.0, 3.0, 4.0), 3, 5).orderBy("row").collect()] == [(1.0, 3.0), (2.0, 4.0)]
    assert su.pixels_to_points(px, (1.0, 2.0, 3.0, 4.0), 1, 1).where("row = 0").first().lon == 1.0


def test_stores(spark):
    long = spark.createDataFrame([("h", "a", 1.0), ("h", "b", 2.0)], "geom_wkt_hash string, feature_name string, feature_value double")
    assert [tb.select_features(long, n).count() for n in (None, [], ["a"])] == [2, 0, 1]
    empty = spark.createDataFrame([], "geom_wkt_hash string, geom_wkt string, experiment string, model string, train_hash string, score double, modification_date timestamp")
    probas = spark.createDataFrame([("POINT (1 1)", 0.1, 0.2), ("POINT (2 2)", 0.3, 0.4)], "geom_wkt string, m1 double, m2 double")
    now = F.lit("2020-01-01").cast("timestamp")
    stored = tb.save_scores(empty, probas, ["m1", "m2"], "e", "t1", now)
    stored = tb.save_scores(tb.save_scores(stored, probas.withColumn("m1", F.lit(0.9)), ["m1"], "e", "t1", now), probas, ["m1"], "e", "t2", now)
    assert stored.count() == 6
    met = probas.select(F.col("geom_wkt").alias("wkt")).union(spark.createDataFrame([("POINT (3 3)",)], "wkt string"))
    assert sorted(r.scores for r in tb.score_join(met, stored, "e", "m1", "t1").collect()) == [0.9, 0.9]
    assert sorted(r.scores for r in tb.score_join(met, stored, "e", "m1", "t2").collect()) == [0.1, 0.3]


def test_nearest_ends_and_excluded_objects(spark):
    shape = lambda rows, k: spark.createDataFrame(rows, f"{k} long, wkt string").withColumn("geom", geo.from_wkt(F.col("wkt")))
    inputs = shape([(0, "POLYGON ((0 0, 0.002 0, 0.002 0.002, 0 0.002, 0 0))"), (1, "POINT (5 5)")], "geom_id")
    layer = shape([(7, "LINESTRING (0.003 -1, 0.003 0.001)"), (8, "POLYGON ((0.0025 0.0015, 0.004 0.0015, 0.004 0.003, 0.0025 0.0015))"), (9, "POINT (0.0025 0.0015)")], "obj_id")
    (r,) = sp.nearest_pairs(inputs, layer, 500.0).collect()
    assert (r.geom_id, r.obj_id) == (0, 8) and abs(r.dist_m - 55.66) < 0.2
    assert (round(r.source.lon, 6), round(r.source.lat, 6), r.destination.lon, round(r.destination.lat, 6)) == (0.001, 0.001, 0.002, 0.0015)
    assert {x.wkt for x in sp.objects_in_radius(inputs, layer, 500.0).collect()} == {x.wkt for x in layer.collect()}
    hole = shape([(1, "POLYGON ((0.002 0.0014, 0.0026 0.0014, 0.0026 0.0016, 0.002 0.0014))")], "source_idx").drop("wkt")
    excluded = shape([(1, "POLYGON ((0.0024 0.001, 0.005 0.0012, 0.005 0.004, 0.0024 0.001))")], "source_idx").drop("wkt")
    left = {x.wkt for x in sp.objects_in_radius(inputs, layer, 500.0, excluded).collect()}
    assert left == {"LINESTRING (0.003 -1, 0.003 0.001)", "POINT (0.0025 0.0015)"} and hole.count() == 1


def test_distances_refuse_lines(spark):
    df = spark.createDataFrame([("POINT (0 0)",), ("POLYGON ((0 0, 1 0, 1 1, 0 0))",), (None,)], "wkt string").withColumn("geom", geo.from_wkt(F.col("wkt")))
    got = [r.dist_m for r in geo.distances_to_point(df, F.lit(0.5), F.lit(0.25)).collect()]
    assert 60_000 < got[0] < 65_000 and got[1:] == [0.0, None]
    line = df.limit(1).withColumn("geom", geo.from_wkt(F.lit("LINESTRING (0 0, 1 1)")))
    with pytest.raises(Exception, match="no distance to a LINESTRING"):
        geo.distances_to_point(line, F.lit(0.5), F.lit(0.25)).collect()
    assert sp.closest_to(spark.createDataFrame([], "obj_id long, lon double, lat double"), 0, 0).count() == 0
