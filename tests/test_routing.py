import pytest
from pyspark.sql import functions as F

from geofeat.operators import routing as rt
from geofeat.operators import spatial as sp

WAYS = "source long, target long, length_m double, maxspeed_forward double"


def test_routes_of_more_than_64_edges(spark):
    ways = spark.createDataFrame([(i, i + 1, 10.0, 50.0) for i in range(70)] + [(0, 70, 1000.0, 50.0)], WAYS)
    pairs = spark.createDataFrame([(0, 70), (0, 99)], "source long, target long")
    assert {r.target: r.metres for r in rt.shortest_routes(pairs, ways).collect()} == {70: 700.0, 99: None}


def test_routes_equal_dijkstra(spark, monkeypatch):
    """Two large parts, a small one which no landmark reaches, ties in metres, doubled ways, loops, and pairs of one node."""
    import heapq
    import random

    monkeypatch.setattr(rt, "LANDMARKS", 2)
    rng = random.Random(6)
    ways = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 9)), 30.0 + rng.randrange(3)) for _ in range(120)]
    ways += [(100 + rng.randrange(30), 100 + rng.randrange(30), float(rng.randrange(1, 5)), 50.0) for _ in range(50)] + [(200, 201, 3.0, 50.0), (201, 202, 0.0, 50.0), (5, 5, 1.0, 50.0)]
    near = {}
    for a, b, m, v in ways:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, []).append((y, m, m / 1000 / v * 60))

    def dijkstra(s):
        done, heap = {}, [(0.0, 0.0, s)]
        while heap:
            m, t, x = heapq.heappop(heap)
            if x not in done:
                done[x] = (m, t)
                for y, dm, dt in near.get(x, []):
                    heapq.heappush(heap, (m + dm, t + dt, y))
        return done

    pairs = [(s, t) for s in (0, 1, 7, 33, 100, 111, 200, 202, 999) for t in (0, 2, 9, 45, 59, 104, 118, 201, 202, 999)] + [(0, 2)]
    got = rt.shortest_routes(spark.createDataFrame(pairs, "source long, target long"), spark.createDataFrame(ways, WAYS)).collect()
    assert len(got) == len(pairs)
    for r in got:
        m, t = dijkstra(r.source).get(r.target, (None, None))
        assert (r.metres, r.minutes) == (pytest.approx(m), pytest.approx(t)) if m is not None else r.metres is None, r


def test_sources_look_no_farther_than_they_must(spark):
    """On a ring of 24 nodes with landmarks, neighbours are looked at from few ends."""
    ways = spark.createDataFrame([(i, (i + 1) % 24, 10.0, 50.0) for i in range(24)], WAYS)
    pairs = spark.createDataFrame([(i, (i + 2) % 24) for i in range(24)], "source long, target long")
    edges = rt._edges(ways)
    asked = rt._bounds(pairs, rt._landmark_rows(edges, rt.LANDMARKS))
    ball = rt._reached(asked.select("source", (F.col("bound") * 0.5).alias("far")), edges)
    assert ball.count() < 24 * 24 / 2
    assert {r.metres for r in rt.shortest_routes(pairs, ways).collect()} == {20.0}


def test_a_first_look_spares_far_ones(spark, monkeypatch):
    """A dense graph of short ways: no end looks at most of the nodes, and landmarks go by few ways of each node."""
    import random

    rng = random.Random(2)
    ways = [(i, j, 10.0 + rng.random() * 1000, 50.0) for i in range(120) for j in range(i)]
    asked, plain = [], rt._reached
    monkeypatch.setattr(rt, "_reached", lambda q, e: asked.append((q.where("far IS NOT NULL").count(), e.count(), plain(q, e))) or asked[-1][2])
    pairs = spark.createDataFrame([(i, (7 * i + 3) % 120) for i in range(120)], "source long, target long")
    got = {r.source: r.metres for r in rt.shortest_routes(pairs, spark.createDataFrame(ways, WAYS)).collect()}
    assert asked[0][1] == 120 * rt.SHORT_WAYS
    assert asked[1][0] == 120 and asked[1][2].count() < 120 * 60
    far = {(i, j): (0.0 if i == j else float("inf")) for i in range(120) for j in range(120)}
    for a, b, m, _ in ways:
        far[a, b] = far[b, a] = m
    for k in range(120):
        for i in range(120):
            for j in range(120):
                far[i, j] = min(far[i, j], far[i, k] + far[k, j])
    assert got == {i: pytest.approx(far[i, (7 * i + 3) % 120]) for i in range(120)}


def test_negative_length_is_an_error(spark):
    with pytest.raises(ValueError):
        rt.reach(spark.createDataFrame([(0,)], "source long"), spark.createDataFrame([(0, 1, -1.0, 50.0)], WAYS))


def test_nearest_beyond_the_last_radius(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 10.0)], "geom_id long, lon double, lat double")
    t = spark.createDataFrame([(7, 0.001, 0.0), (8, 30.0, 5.0), (9, 20.0, 5.0)], "obj_id long, lon double, lat double")
    got = sp.k_nearest(q, t, 2, max_rounds=2)
    assert sorted((r.geom_id, r["rank"], r.obj_id) for r in got.collect()) == [(1, 1, 7), (1, 2, 9), (2, 1, 8), (2, 2, 9)]


def test_fewer_points_than_asked_for(spark):
    q = spark.createDataFrame([(1, -170.0, -80.0)], "geom_id long, lon double, lat double")
    t = spark.createDataFrame([(7, 170.0, 80.0), (8, 0.0, 0.0)], "obj_id long, lon double, lat double")
    assert [r.obj_id for r in sp.k_nearest(q, t, 5, max_rounds=1).orderBy("rank").collect()] == [8, 7]
    assert sp.k_nearest(q, t.where("false"), 5, max_rounds=1).count() == 0
