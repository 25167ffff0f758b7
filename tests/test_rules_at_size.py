"""Queries and their SQL where tables are dense: ties, and little room."""

import duckdb
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import features as ft
from geofeat.operators import models as ml
from geofeat.operators import samples as sa
from geofeat.operators import spatial as sp
from geofeat.operators import summaries as su
from geofeat.operators import tables as tb
from geofeat.plans import learning
from geofeat.sources.fixtures import table


def test_nearest_pairs_ties_go_to_the_smaller_id(spark):
    a, b, c, d = 34.5, 31.5, 34.504, 31.503
    areas = spark.createDataFrame([(0, a, b, c, d)], "geom_id long, a double, b double, c double, d double").select("geom_id", geo.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geom"))
    for shift in range(5):  # points of one latitude above the area are all as far away, whatever piece of its edge is below
        points = spark.createDataFrame([(i, a + 1e-5 + (7 * i + shift) % 20 * 1.9e-4, 31.5037001) for i in range(20)], "obj_id long, lon double, lat double")
        found = sp.nearest_pairs(areas, points.select("obj_id", geo.point(F.col("lon"), F.col("lat")).alias("geom")), 1000.0).collect()
        assert [r.obj_id for r in found] == [0]


def test_sql_of_negatives_goes_on_until_there_are_enough(spark):
    box = (34.482724, 34.583301, 31.492354, 31.585196)
    a, b, c, d = 34.482724, 31.492354, 34.5783, 31.585196  # a twentieth of the range is free
    areas = spark.createDataFrame([(0, a, b, c, d)], "source_idx long, a double, b double, c double, d double").select("source_idx", geo.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geom"))
    got = sa.polys_to_dataset(areas, box, 1e-3 / geo.DEGREES_PER_METRE, seed=9)
    got = got.select("label", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat")).collect()
    given = f"WITH areas AS (SELECT 0 AS source_idx, {a}e0 AS min_lon, {b}e0 AS min_lat, {c}e0 AS max_lon, {d}e0 AS max_lat)"
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(given + learning.SA6).fetchall())


def test_points_in_meets_every_area_of_a_crowded_cell(spark):
    wide = [(34.5, 31.5, 34.501, 31.501)] * 40  # more than a point is tested against at first
    boxes = spark.createDataFrame([*wide, (34.5021, 31.5021, 34.5022, 31.5022)], "a double, b double, c double, d double")
    areas = boxes.select(geo.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geom"))
    points = spark.createDataFrame([(0, 34.5005, 31.5005), (1, 34.50215, 31.50215), (2, 34.5015, 31.5015), (3, 34.501, 31.5)], "k long, lon double, lat double")
    assert sorted(r.k for r in sp.points_in(points, areas, "k").collect()) == [0, 1, 3]


def test_only_upright_rectangles_go_by_their_boxes(spark):
    texts = {"POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))": True, "POLYGON ((0 0, 1 1, 2 0, 1 -1, 0 0))": False, "POLYGON ((0 0, 2 0, 2 1, 2 0, 0 0))": False, "POLYGON ((0 0, 2 1, 2 0, 0 1, 0 0))": False, "LINESTRING (0 0, 2 0, 2 1, 0 1, 0 0)": False}
    rows = sp.boxed(spark.createDataFrame([(t,) for t in texts], "wkt string").withColumn("geom", geo.from_wkt(F.col("wkt"))), "a").collect()
    assert {r.wkt: r.a_rect for r in rows} == texts


def test_a_nearest_search_starts_where_few_points_are(spark):
    grid = spark.createDataFrame([(i, 34.5 + i % 50 * 2e-5, 31.5 + i // 50 * 2e-5) for i in range(2500)], "obj_id long, lon double, lat double")
    q = grid.limit(100).withColumnRenamed("obj_id", "geom_id")
    assert sp.first_radius(q, grid, 10.0, 250.0) < 25
    near = sp.k_nearest(q, grid, 1, limit_m=100.0).collect()
    assert len(near) == 100 and all(r.geom_id == r.obj_id and r.dist_m == 0 for r in near)


def test_counts_of_an_area_that_is_no_rectangle(spark):
    shape = "POLYGON ((34.5 31.5, 34.504 31.5, 34.504 31.503, 34.502 31.501, 34.5 31.503, 34.5 31.5))"
    areas = spark.createDataFrame([(1, shape)], "source_idx long, wkt string").select("source_idx", geo.from_wkt(F.col("wkt")).alias("geom"))
    points = spark.createDataFrame([(i, 34.4995 + i % 40 * 1.3e-4, 31.4995 + i // 40 * 1.1e-4) for i in range(1600)], "obj_id long, lon double, lat double")
    plain = points.crossJoin(areas).where(geo.st_covers_point(F.col("geom"), F.col("lon"), F.col("lat"))).count()
    assert [r.n for r in su.object_counts(areas, points, {"n": "1=1"}).collect()] == [plain]
    assert plain > 100


def test_objects_of_crowded_polygons_take_the_lowest_in_few_pairs(spark, monkeypatch):
    rows = [(300 - i, 34.5 + i % 20 * 1e-4, 31.5 + i // 20 * 1e-4, 34.503 + i % 20 * 1e-4, 31.503 + i // 20 * 1e-4) for i in range(300)]
    box = lambda *c: geo.box(*map(F.col, c)).alias("geom")
    polys = spark.createDataFrame([*rows, (2000, 34.53, 31.53, 34.531, 31.531)], "source_idx long, a double, b double, c double, d double").select("source_idx", box("a", "b", "c", "d"))
    points = [(i, 34.4995 + i % 10 * 6e-4, 31.4995 + i // 10 * 6e-4) for i in range(100)] + [(100, 34.5305, 31.5305), (101, 34.6, 31.6)]
    layer = spark.createDataFrame([(i, x, y, x + 1e-4, y + 1e-4) for i, x, y in points], "obj_id long, a double, b double, c double, d double")
    layer = layer.select("obj_id", box("a", "b", "c", "d")).withColumn("wkt", geo.to_wkt(F.col("geom")))
    joined = []
    plain = sp.box_join
    monkeypatch.setattr(sp, "box_join", lambda a, b, *rest: joined.append((a.count(), b.count())) or plain(a, b, *rest))
    boxes = {r.source_idx: r.geom.parts[0] for r in polys.collect()}
    for intersects in (True, False):
        joined.clear()
        expected = []
        for r in layer.collect():
            (x0, y0), (x1, y1) = r.geom.parts[0][0], r.geom.parts[0][2]
            fits = (lambda p: x0 <= p[2].lon and p[0].lon <= x1 and y0 <= p[2].lat and p[0].lat <= y1) if intersects else (lambda p: p[0].lon <= x0 and x1 <= p[2].lon and p[0].lat <= y0 and y1 <= p[2].lat)
            met = [i for i, p in boxes.items() if fits(p)]
            expected += [(r.wkt, min(met))] if met else []
        assert sorted(map(tuple, sp.objects_from_polygons(polys, layer, intersects).collect())) == sorted(expected)
        assert sum(n * m for n, m in joined) < 0.6 * 102 * 301 and sum(m for _, m in joined) == 301


def test_embeddings_of_one_file_are_worked_out_by_all_tasks(spark):
    rows = spark.range(400).coalesce(1).withColumnRenamed("id", "k")
    made = ml.random_embedding(rows, "k", 4)
    assert made.rdd.getNumPartitions() == 4
    assert sorted(r.k for r in made.collect()) == list(range(400))


def test_models_are_fitted_on_a_written_table(spark):
    rows = learning.dataset(lambda name: table(spark, "/root/testdata/sf0.001", name))
    assert rows.count() == 150
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_small_rectangles_go_by_their_boxes(spark, monkeypatch):
    """The same pairs as of shapes of any kind: small and large rectangles, a triangle, a line, and both sides of 180 degrees."""
    import random

    rng = random.Random(5)
    places = [(34.5 + rng.uniform(0, 0.01), 31.5 + rng.uniform(0, 0.01)) for _ in range(150)] + [(rng.choice([-1, 1]) * (180 - rng.uniform(0, 0.004)), 60 + rng.uniform(0, 0.004)) for _ in range(80)]
    rect = lambda x, y, w, h: f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"
    texts = [rect(min(x, 179.9998), y, rng.uniform(1e-5, 2e-4), rng.uniform(1e-5, 4e-4)) for x, y in places]
    texts += [rect(34.502, 31.502, 6e-3, 1e-3), "POLYGON ((34.503 31.503, 34.504 31.503, 34.503 31.504, 34.503 31.503))", "LINESTRING (34.5 31.505, 34.51 31.506)"]
    t = spark.createDataFrame(list(enumerate(texts)), "obj_id long, wkt string").select("obj_id", geo.from_wkt(F.col("wkt")).alias("geom"))
    q = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "geom_id long, lon double, lat double")
    boxed = geo.bound(t, "_box", geo.bbox(F.col("geom")))
    plain = sp._dwithin_any(q, geo.bound(boxed, "_rect", geo.is_box(F.col("geom"), F.col("_box"))), 250.0)
    asked, by_boxes = [], sp._dwithin_boxes
    monkeypatch.setattr(sp, "_dwithin_boxes", lambda q, b, *rest: asked.append(b.count()) or by_boxes(q, b, *rest))
    rows = lambda df: sorted((r.geom_id, r.obj_id, round(r.dist_m, 6)) for r in df.select("geom_id", "obj_id", "dist_m").collect())
    got = rows(sp.dwithin_objects(q, t, 250.0))
    assert asked == [len(places)] and len(got) > 1000 and got == rows(plain)


def test_pairs_of_shapes_are_summed_without_a_sort_of_them(spark):
    box = geo.box(F.col("lon"), F.col("lat"), F.col("lon") + 1e-4, F.col("lat") + 1e-4).alias("geom")
    q = spark.range(60).select(F.col("id").alias("geom_id"), (34.5 + F.col("id") * 1e-4).alias("lon"), F.lit(31.5).alias("lat"))
    layer = q.select(F.col("geom_id").alias("obj_id"), box, F.lit("x").alias("building"))
    wanted = [cls(ft.BUILDING, "polygons", "building", r) for r in (100.0, 250.0) for cls in (ft.NumberOf, ft.AreaOf, ft.AreaOfNearest)]
    out = ft.FeatureBuilder(wanted, {"polygons": layer}).transform(q)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert {r[0] > 0 for r in out.select("area_of_nearest_building_100m").collect()} == {True}


def test_scores_are_joined_by_shuffles(spark):
    shapes = spark.createDataFrame([("a",), ("b",)], "wkt string")
    store = spark.createDataFrame([("a", "e", "m", "h", 0.5), ("b", "e", "m", "other", 0.5)], "geom_wkt string, experiment string, model string, train_hash string, score double")
    met = tb.score_join(shapes, store, "e", "m", "h")
    assert [tuple(r) for r in met.collect()] == [("a", 0.5)]
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_a_nearest_search_copies_inputs_to_few_cells(spark, monkeypatch):
    """The same pairs as of all within the radius, on both sides of 180 degrees too, by many tasks, and no more columns than asked."""
    import random

    rng = random.Random(7)
    places = [(34.5 + rng.uniform(0, 0.02), 31.5 + rng.uniform(0, 0.02)) for _ in range(400)] + [(rng.choice([-1, 1]) * (180 - rng.uniform(0, 0.004)), 60 + rng.uniform(0, 0.004)) for _ in range(200)]
    t = spark.createDataFrame([(i, x, y, "a") for i, (x, y) in enumerate(places)], "obj_id long, lon double, lat double, amenity string")
    q = spark.createDataFrame([(i, x + 1e-5, y) for i, (x, y) in enumerate(places) if abs(x) < 179.9999], "geom_id long, lon double, lat double")
    rows = lambda df: sorted((r.geom_id, r.obj_id, round(r.dist_m, 6)) for r in df.select("geom_id", "obj_id", "dist_m").collect())
    wide = rows(sp._near_in_wide_cells(q, t, 150.0, 9))
    assert len(wide) > 2 * len(places) and wide == rows(sp.dwithin_points(q, t, 150.0))
    copies = []
    plain = sp._with_cells
    monkeypatch.setattr(sp, "_with_cells", lambda df, *rest: copies.append(plain(df, *rest).count() / df.count()) or plain(df, *rest))
    near = sp.k_nearest(q, t, 2)
    assert near.columns == ["geom_id", "obj_id", "dist_m", "rank"] and max(copies) < 5
    best = {}
    for g, o, d in rows(sp.dwithin_points(q, t, 2e4)):
        best.setdefault(g, []).append((d, o))
    assert sorted((r.geom_id, r["rank"], r.obj_id) for r in near.collect()) == sorted((g, i + 1, o) for g, found in best.items() for i, (_, o) in enumerate(sorted(found)[:2]))
