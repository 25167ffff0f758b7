import pytest
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import features as ft
from geofeat.operators import models as ml
from geofeat.operators import samples as sa
from geofeat.operators import tables as tb


def squares(spark, *corners, side=0.01):
    rows = [(i, float(x), float(y), float(i % 2)) for i, (x, y) in enumerate(corners)]
    df = spark.createDataFrame(rows, "source_idx long, x double, y0 double, y double")
    return df.select("source_idx", "y", geo.box(F.col("x"), F.col("y0"), F.col("x") + side, F.col("y0") + side).alias("geom"))


def test_dataset_of_polygons_is_balanced(spark):
    polys = squares(spark, (34.5, 31.5), (34.55, 31.52))
    got = sa.polys_to_dataset(polys, (34.5, 34.6, 31.5, 31.6), 100.0).cache()
    counts = dict(got.groupBy("label").count().collect())
    assert counts[1] == counts[0] > 100
    inside = got.crossJoin(F.broadcast(polys.drop("y"))).where(geo.st_covers_point(F.col("geom"), F.col("lon"), F.col("lat")))
    assert dict(inside.groupBy("label").count().collect()) == {1: counts[1]}
    coords = spark.createDataFrame([(1, 34.55, 31.55)], "source_idx long, lon double, lat double")
    assert sorted(n for _, n in sa.coords_to_dataset(coords, (34.5, 34.6, 31.5, 31.6), 50.0, 500.0).groupBy("label").count().collect())[0] > 50


def test_no_room_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(sa, "HOPELESS", 4)
    with pytest.raises(ValueError):
        sa.random_outside(spark, (34.5, 34.505, 31.5, 31.505), squares(spark, (34.49, 31.49), side=0.1), 3, 1)


def test_sample_from_geoms(spark):
    wkts = [(0, "POINT (34.5 31.5)", 1.0), (1, "POLYGON ((34 31, 35 31, 35 32, 34 32, 34 31))", 0.0)]
    df = spark.createDataFrame(wkts, "source_idx long, wkt string, y double").withColumn("geom", geo.from_wkt(F.col("wkt")))
    got = sa.sample_from_geoms(df, 3).collect()
    assert sorted((r.source_idx, r.y) for r in got) == [(0, 1.0)] + [(1, 0.0)] * 3
    with pytest.raises(ValueError):
        sa.sample_from_geoms(df.union(df))


def test_labels_with_sampling_and_noise(spark):
    polys = squares(spark, (34.5, 31.5), (34.55, 31.52))
    points = spark.range(40).select(F.col("id").alias("obj_id"), (F.when(F.col("id") < 10, 34.551).otherwise(34.501) + F.col("id") * 1e-4).alias("lon"), (F.when(F.col("id") < 10, 31.521).otherwise(31.501) + F.col("id") * 1e-5).alias("lat"))
    layer = points.select("obj_id", geo.box(F.col("lon"), F.col("lat"), F.col("lon") + 1e-5, F.col("lat") + 1e-5).alias("geom")).withColumn("wkt", geo.to_wkt(F.col("geom")))
    count = lambda **k: {(r.source_idx, r.label): r["count"] for r in sa.objects_with_labels(polys, layer, **k).groupBy("source_idx", "label").count().collect()}
    assert count() == {(1, 1.0): 10, (0, 0.0): 30}
    assert count(positive_sampling=0.45, noise=0.4) == {(1, 1.0): 5, (0, 1.0): 4, (0, 0.0): 26}


def test_negatives_by_fold(spark):
    df = spark.range(60).select("id", (F.col("id") % 3).cast("int").alias("fold"), F.when(F.col("id") < 9, 1.0).otherwise(0.0).alias("label"))
    got = sa.negative_sampling_by_fold(df, 2.0, 1, "id")
    assert {(r.fold, r.label): r["count"] for r in got.groupBy("fold", "label").count().collect()} == {(f, x): n for f in range(3) for x, n in ((1.0, 3), (0.0, 6))}
    assert sorted(got.collect()) == sorted(sa.negative_sampling_by_fold(df.repartition(5), 2.0, 1, "id").collect())


def test_builder_uses_and_fills_the_store(spark):
    points = spark.createDataFrame([(0, 34.5, 31.5), (1, 34.51, 31.5)], "geom_id long, lon double, lat double").withColumn("geom_wkt", geo.to_wkt(geo.point(F.col("lon"), F.col("lat"))))
    layer = spark.createDataFrame([(7, 34.5, 31.5001, "x")], "obj_id long, lon double, lat double, amenity string")
    builder = ft.FeatureBuilder([ft.NumberOf(ft.AMENITY, "points", "amenity", 250.0), ft.DistanceTo(ft.AMENITY, "points", "amenity", 250.0)], {"points": layer})
    empty = spark.createDataFrame([], "geom_wkt_hash string, geom_wkt string, feature_name string, feature_value double, modification_date timestamp")
    now = F.lit("2020-01-01").cast("timestamp")
    frame, store = builder.transform_stored(points, empty, now)
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, builder.transform(points).collect())) and store.count() == 4
    # one feature complete in the store, with other values than a new count would give; the other lacks an input
    changed = store.withColumn("feature_value", F.when(F.col("feature_name").like("number%"), 99.0).otherwise(F.col("feature_value")))
    part = changed.where((F.col("feature_name").like("number%")) | (F.col("feature_value") < 250))
    cached, rest = ft.split_cached(builder.features, points, part)
    assert [type(f) for f in cached] == [ft.NumberOf] and [type(f) for f in rest] == [ft.DistanceTo]
    frame, store = builder.transform_stored(points, part, now)
    assert [r.number_of_amenity_250m for r in frame.collect()] == [99.0, 99.0] and store.count() == 4
    assert sorted(r.distance_to_amenity_250m for r in frame.collect())[1] == 250.0


def test_own_geometry_is_no_neighbour(spark):
    wkt = "POLYGON ((34.5 31.5, 34.501 31.5, 34.501 31.501, 34.5 31.501, 34.5 31.5))"
    layer = spark.createDataFrame([(1, wkt, "x")], "obj_id long, wkt string, building string").withColumn("geom", geo.from_wkt(F.col("wkt")))
    inputs = spark.createDataFrame([(0, 34.5005, 31.5005, wkt), (1, 34.5006, 31.5005, "other")], "geom_id long, lon double, lat double, geom_wkt string")
    got = ft.FeatureBuilder([ft.DistanceTo(ft.BUILDING, "polygons", "building", 100.0)], {"polygons": layer}).transform(inputs)
    assert sorted(map(tuple, got.collect())) == [(0, 100.0), (1, 0.0)]


def test_model_helpers(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("label"), ((F.col("id") % 2) * 3 + F.col("id") % 5).cast("double").alias("good"), (F.col("id") % 7).cast("double").alias("bad"))
    for test in ("f", "chi2"):
        assert ml.select_univariate(df, ["bad", "good"], 1, test) == ["good"]
    rows = [(k, float(k % 2), k % 2, f, m, (k % 4) / 4) for k in range(8) for f in (0, 1) for m in ("a", "b")]
    scored = spark.createDataFrame(rows, "id long, label double, fold int, test_fold int, model string, proba double")
    frame, auc = ml.combine_fold_results(scored, "id", ["a", "b"])
    assert frame.columns == ["fold", "id", "label", "a", "b"] and frame.count() == 8
    assert sorted((r.model, r.test_fold) for r in auc.collect()) == [(m, f) for m in "ab" for f in (0, 1)]


def test_losses_and_extremes(spark):
    df = spark.createDataFrame([("h", 1, 0.9, 0.0), ("h", 2, 0.0, 0.9), ("h", 3, 0.9, 0.8), ("h", 4, 0.1, 0.0)], "head string, id long, p double, y double")
    assert tuple(tb.extreme_examples(df, "head", "id", "p", "y").first()) == ("h", 1, 2, 3, 4)
    losses = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "head string, loss double")
    got = tb.multihead_loss(losses, {"a": 1.0, "b": 2.0}, {"a": 0.0, "b": 1.0}).first()[0]
    assert abs(got - (2 + 2 * 3 / 2.718281828459045 + 1)) < 1e-9


def test_one_value_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id long, v double")
    assert [r.v for r in tb.minmax(df, "v").orderBy("id").collect()] == [0.0, 0.0, None]


def test_results_of_a_missing_path(spark, tmp_path):
    assert tb.load_model_results(spark, str(tmp_path / "none"), "t").count() == 0
    path = str(tmp_path / "there")
    tb.save_experiment(spark.createDataFrame([("m", 0.5)], "model string, auc double"), path, "2020-01-01")
    got = tb.load_model_results(spark, path, "2020-01-01")
    assert [(r.model, r.auc) for r in got.collect()] == [("m", 0.5)] and tb.existing_models(got).collect() == [("m",)]
