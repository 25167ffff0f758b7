"""Joins of shapes of any kind against brute force, and pairs across the line of 180 degrees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import features as ft
from geofeat.operators import spatial as sp

SHAPE = "id long, wkt string"


def text(kind, parts):
    ring = lambda p: "(" + ", ".join(f"{x:.7f} {y:.7f}" for x, y in p) + ")"
    return {"POINT": lambda: f"POINT {ring(parts[0])}", "LINESTRING": lambda: f"LINESTRING {ring(parts[0])}", "POLYGON": lambda: f"POLYGON ({', '.join(map(ring, parts))})", "MULTILINESTRING": lambda: f"MULTILINESTRING ({', '.join(map(ring, parts))})"}[kind]()


def edges(parts):
    return [e for p in parts for e in (zip(p, p[1:]) if len(p) > 1 else [(p[0], p[0])])]


def scales(lat):
    s = math.sin(math.radians(lat)) ** 2
    return math.radians(geo.A) * math.cos(math.radians(lat)) / math.sqrt(1 - geo.E2 * s), math.radians(geo.A) * (1 - geo.E2) / (1 - geo.E2 * s) ** 1.5


def covers(parts, p):
    inside = False
    for ring in parts:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def pieces(parts, length):
    for a, b in edges(parts):
        kx, ky = scales((a[1] + b[1]) / 2)
        n = max(1, math.ceil(math.hypot((b[0] - a[0]) * kx, (b[1] - a[1]) * ky) / length))
        at = lambda i: (a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n)  # noqa: B023, E731
        yield from ((at(i), at(i + 1)) for i in range(n))


def between(g, h, radius):
    """Metres between two shapes (kind, parts) by every pair of edges, in the planes of the first one's pieces."""
    for a, b in ((g, h), (h, g)):
        if a[0].endswith("POLYGON") and any(covers(a[1], part[0]) for part in b[1]):
            return 0.0
    best = math.inf
    for a, b in pieces(g[1], max(radius / 4, 25)):
        kx, ky = scales((a[1] + b[1]) / 2)
        flat = lambda p: ((p[0] - a[0]) * kx, (p[1] - a[1]) * ky)  # noqa: B023, E731
        for c, d in edges(h[1]):
            a_, b_, c_, d_ = map(flat, (a, b, c, d))
            side = lambda s, e, p: (e[0] - s[0]) * (p[1] - s[1]) - (e[1] - s[1]) * (p[0] - s[0])
            if side(a_, b_, c_) * side(a_, b_, d_) < 0 and side(c_, d_, a_) * side(c_, d_, b_) < 0:
                return 0.0
            for p, s, e in ((a_, c_, d_), (b_, c_, d_), (c_, a_, b_), (d_, a_, b_)):
                u, v = e[0] - s[0], e[1] - s[1]
                n = u * u + v * v
                t = min(1, max(0, ((p[0] - s[0]) * u + (p[1] - s[1]) * v) / n)) if n else 0
                best = min(best, math.hypot(s[0] + t * u - p[0], s[1] + t * v - p[1]))
    return best


def shapes(n, seed, span=0.02):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = round(34.5 + rng.random() * span, 7), round(31.5 + rng.random() * span, 7)
        size = rng.choice((1e-4, 5e-4, 4e-3))
        near = lambda: (round(x + rng.uniform(-size, size), 7), round(y + rng.uniform(-size, size), 7))  # noqa: B023, E731
        kind = rng.choice(("POINT", "LINESTRING", "POLYGON", "MULTILINESTRING"))
        if kind == "POLYGON":
            a, b = near(), (x + 2 * size, y + 2 * size)
            b = (round(b[0], 7), round(b[1], 7))
            u = [(a[0], a[1]), (b[0], a[1]), (b[0], b[1]), (round((a[0] + b[0]) / 2, 7), a[1] + 1e-5), (a[0], b[1]), (a[0], a[1])]
            out.append((k, kind, [[(round(p, 7), round(q, 7)) for p, q in u]]))
        else:
            sizes = {"POINT": [1], "LINESTRING": [rng.randrange(2, 5)], "MULTILINESTRING": [2, 3]}[kind]
            out.append((k, kind, [[near() for _ in range(m)] for m in sizes]))
    return out


def frame(spark, rows, key):
    return spark.createDataFrame([(k, text(kind, parts)) for k, kind, parts in rows], SHAPE).select(F.col("id").alias(key), geo.from_wkt(F.col("wkt")).alias("geom"))


@pytest.mark.parametrize("radius", [0.0, 60.0, 300.0])
def test_shapes_within_a_radius_equal_brute_force(spark, radius):
    q, t = shapes(60, 1), shapes(90, 2)
    expected = {}
    for i, *g in q:
        for j, *h in t:
            d = between(g, h, radius)
            if d <= radius:
                expected[i, j] = d
    got = {(r.geom_id, r.obj_id): r.dist_m for r in sp.dwithin_shapes(frame(spark, q, "geom_id"), frame(spark, t, "obj_id"), radius).collect()}
    assert got.keys() == expected.keys() and len(got) > 20
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-5


def test_long_edges_and_the_same_shape(spark):
    """A line of 40 km is cut, and meets what stands beside its middle; an input's own shape is marked."""
    q = frame(spark, [(1, "LINESTRING", [[(34.0, 31.5), (34.4, 31.5)]]), (2, "POINT", [[(34.2, 31.5005)]])], "geom_id")
    t = frame(spark, [(7, "POINT", [[(34.2, 31.5005)]]), (8, "POINT", [[(34.2, 31.51)]])], "obj_id")
    got = {(r.geom_id, r.obj_id): (round(r.dist_m), r.same_geom) for r in sp.dwithin_shapes(q, t, 100.0).collect()}
    assert got == {(1, 7): (55, False), (2, 7): (0, True)}


def test_features_of_shapes(spark):
    layer = frame(spark, shapes(50, 3), "obj_id").withColumn("building", F.lit("yes"))
    inputs = layer.select(F.col("obj_id").alias("geom_id"), "geom")
    builder = ft.FeatureBuilder([ft.NumberOf(ft.BUILDING, "b", "building", 200.0), ft.DistanceTo(ft.BUILDING, "b", "building", 200.0)], {"b": layer})
    got = {r.geom_id: (r[1], r[2]) for r in builder.transform(inputs).collect()}
    rows = shapes(50, 3)
    for i, *g in rows:
        ds = [between(g, h, 200) for j, *h in rows]
        assert got[i][0] == sum(d <= 200 for d in ds)
        assert got[i][1] == pytest.approx(min([d for j, d in enumerate(ds) if j != i and d <= 200], default=200.0), abs=1e-3)
    with pytest.raises(ValueError):
        builder.transform(inputs.unionByName(inputs.limit(1)))


POINT = "geom_id long, lon double, lat double"


def test_pairs_across_the_line_of_180_degrees(spark):
    q = spark.createDataFrame([(1, 179.9999, 10.0), (2, -179.9999, 10.0), (3, 180.0, 10.0), (4, 0.0, 10.0)], POINT)
    t = spark.createDataFrame([(7, -179.9999, 10.0), (8, 179.9999, 10.0), (9, -180.0, 10.0)], "obj_id long, lon double, lat double")
    got = {(r.geom_id, r.obj_id): round(r.dist_m) for r in sp.dwithin_points(q, t, 30.0).collect()}
    assert got == {(1, 7): 22, (1, 8): 0, (1, 9): 11, (2, 7): 0, (2, 8): 22, (2, 9): 11, (3, 7): 11, (3, 8): 11, (3, 9): 0}
    assert sp.dwithin_points(q, t, 30.0).where("q_lon = 179.9999").count() == 3
    near = {r.geom_id: (r.obj_id, round(r.dist_m)) for r in sp.k_nearest(q.where("geom_id < 3"), t.where("obj_id = 7"), 1).collect()}
    assert near == {1: (7, 22), 2: (7, 0)}


def test_objects_and_shapes_across_the_line(spark):
    q = spark.createDataFrame([(1, 179.9999, 10.0), (2, -179.9995, 10.0)], POINT)
    box = lambda a, b: geo.box(F.lit(a), F.lit(9.9999), F.lit(b), F.lit(10.0001))
    both = F.struct(F.lit("MULTIPOLYGON").alias("kind"), F.concat(box(179.9998, 180.0)["parts"], box(-180.0, -179.9998)["parts"]).alias("parts"), F.array(F.lit(True), F.lit(True)).alias("outer"))
    t = spark.range(7, 8).select(F.col("id").alias("obj_id"), box(-180.0, -179.9998).alias("geom")).unionByName(spark.range(8, 9).select(F.col("id").alias("obj_id"), both.alias("geom")))
    got = {(r.geom_id, r.obj_id): round(r.dist_m) for r in sp.dwithin_objects(q, t, 100.0).collect()}
    assert got == {(1, 7): 11, (1, 8): 0, (2, 7): 33, (2, 8): 33}
    assert len(sp.dwithin_objects(q, t, 100.0).collect()) == 4
    shaped = q.select("geom_id", geo.point(F.col("lon"), F.col("lat")).alias("geom"))
    assert {(r.geom_id, r.obj_id): round(r.dist_m) for r in sp.dwithin_shapes(shaped, t, 100.0).collect()} == got
