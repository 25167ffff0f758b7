"""Counts from cells against counting all pairs, also at the line of 180 degrees and far north."""

import random

import pytest
from pyspark.sql import functions as F

from geofeat.operators import features as ft
from geofeat.operators import pyramid as py
from geofeat.operators import spatial as sp

POINT = "geom_id long, lon double, lat double"


def around(lon, lat, n, span, seed):
    rng = random.Random(seed)
    out = [(k, lon + rng.uniform(-span, span), lat + rng.uniform(-span, span) / 2) for k in range(n)]
    return [(k, x - 360 if x > 180 else x + 360 if x < -180 else x, y) for k, x, y in out]


@pytest.mark.parametrize("lon,lat,span", [(34.5, 31.5, 0.02), (180.0, -17.0, 0.02), (20.0, 78.0, 0.08), (-70.0, 60.0, 0.04), (0.0, 0.0, 0.02)])
def test_counts_equal_all_pairs(spark, lon, lat, span):
    q = spark.createDataFrame(around(lon, lat, 40, span, 1), POINT)
    t = spark.createDataFrame([(k, x, y, k % 3) for k, x, y in around(lon, lat, 500, span, 2)] * 2, "obj_id long, lon double, lat double, w int")
    radii = [100.0, 333.0, 1500.0]
    got = {(r.geom_id, r.radius): (r.w, r.one) for r in py.counts_around(q, t.withColumn("one", F.lit(1)), radii, ["w", "one"]).collect()}
    pairs = sp.dwithin_points(q, t, 1500.0).select("geom_id", "w", "dist_m").collect()
    for k in range(40):
        for r in radii:
            near = [p.w for p in pairs if p.geom_id == k and p.dist_m <= r]
            assert got.get((k, r), (0, 0)) == (sum(near), len(near))


def test_full_cells_make_no_pairs(spark):
    """5,000 objects in the middle of a circle are one cell's sum, and meet no input."""
    rng = random.Random(5)
    t = spark.createDataFrame([(k, 34.5 + rng.uniform(-1e-3, 1e-3), 31.5 + rng.uniform(-1e-3, 1e-3)) for k in range(5_000)], "obj_id long, lon double, lat double")
    q = spark.createDataFrame([(k, 34.5 + k * 1e-6, 31.5) for k in range(50)], POINT)
    cells = py.covers(q, [1_000.0])
    assert cells.where("inside").count() < 50 * 200 and cells.where("NOT inside").count() < 50 * 200
    rim = cells.where("NOT inside").join(py._cells(t, [py.level_of(1_000.0) + py.DEPTH], 0.02), ["level", "joined", "cx", "cy"])
    assert rim.count() == 0
    assert {r.one for r in py.counts_around(q, t.withColumn("one", F.lit(1)), [1_000.0], ["one"]).collect()} == {5_000}


@pytest.mark.parametrize("few", [0, 3, 60, 10**9])
def test_features_by_pyramid_equal_those_by_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(ft, "FEW_PAIRS", few)
    q = spark.createDataFrame(around(34.5, 31.5, 60, 0.03, 7), POINT)
    own = [(k + 1_000, x, y, "yes") for k, x, y in around(34.5, 31.5, 60, 0.03, 7)[:20]]  # objects at the inputs' own places
    t = spark.createDataFrame([(k, x, y, "yes" if k % 9 == 0 else None) for k, x, y in around(34.5, 31.5, 300, 0.03, 8)] + own, "obj_id long, lon double, lat double, shop string")
    wanted = [cls(flt, "p", name, r) for name, flt in (("shop", ft.SHOP), ("any", ft.ALL)) for r in (50.0, 400.0, 2_000.0) for cls in (ft.NumberOf, ft.DistanceTo)]
    got = {r.geom_id: r for r in ft.FeatureBuilder(wanted, {"p": t}).transform(q).collect()}
    plain = ft.aggregate(ft.pairs(q, t, wanted), wanted)
    defaults = {k: v for f in wanted for k, v in f.defaults().items()}
    for r in ft.fill_defaults(q, plain, defaults).collect():
        assert {n: got[r.geom_id][n] for n in defaults} == pytest.approx({n: r[n] for n in defaults})
    assert ft.FeatureBuilder(wanted, {"p": t.limit(0)}).transform(q).where("number_of_any_50m = 0 AND distance_to_any_400m = 400").count() == 60
