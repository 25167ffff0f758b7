"""Queries for labels, models, routing, clusters and the remaining table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.functions.hashed import digest_sql, unit_sql
from geofeat.operators import clusters as cl
from geofeat.operators import features as ft
from geofeat.operators import models as ml
from geofeat.operators import routing as rt
from geofeat.operators import samples as sa
from geofeat.operators import spatial as sp
from geofeat.operators import summaries as su
from geofeat.operators import tables as tb
from geofeat.plans.registry import BOX_AREA, D, INTERSECTS, areas, buildings, pixels, query, r, store, wide
from geofeat.sources.fixtures import lat, lon
from geofeat.sources.shared import written

VERTICES = f", v AS (SELECT s_suppkey AS node, {lon('s_suppkey+3000')} AS lon, {lat('s_suppkey+3000')} AS lat FROM supplier)"


def vertices(t):
    return t("supplier").select(F.col("s_suppkey").alias("node"), F.expr(lon("s_suppkey+3000")).alias("lon"), F.expr(lat("s_suppkey+3000")).alias("lat"))


def _reach_sql(rounds: int = 14) -> str:
    """Rounds of relaxation: every route one edge longer, the minimum per (source, node) stays."""
    out = ", e AS MATERIALIZED (SELECT source AS a, target AS b, length_m AS m, length_m / 1000e0 / maxspeed_forward * 60 AS t FROM ways UNION ALL SELECT target, source, length_m, length_m / 1000e0 / maxspeed_forward * 60 FROM ways)"
    out += ", d0 AS MATERIALIZED (SELECT s_suppkey AS s, s_suppkey AS n, 0e0 AS m, 0e0 AS t FROM supplier)"
    for i in range(1, rounds + 1):
        out += f", d{i} AS MATERIALIZED (SELECT s, n, min(struct_pack(m := m, t := t)) AS x FROM (SELECT s, n, m, t FROM d{i - 1}_ UNION ALL SELECT s, b, d.m + e.m, d.t + e.t FROM d{i - 1}_ d JOIN e ON d.n = e.a) y GROUP BY s, n), d{i}_ AS (SELECT s, n, x.m AS m, x.t AS t FROM d{i})"
    return out.replace("d0 AS MATERIALIZED", "d0_ AS MATERIALIZED")


@query("r2_shortest_routes", _reach_sql() + ", p AS (SELECT s_suppkey AS source, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS target FROM supplier) SELECT source, target, round(m, 3) AS metres, round(t, 4) AS minutes FROM p LEFT JOIN d14_ ON s = source AND n = target", ("ways",))
def _(t):
    n = t("supplier").agg(F.count("*").alias("n"))
    pairs = t("supplier").join(F.broadcast(n)).select(F.col("s_suppkey").alias("source"), ((F.col("s_suppkey") * 7 + 3) % F.col("n")).alias("target"))
    return rt.shortest_routes(pairs, t("ways")).select("source", "target", r(F.col("metres")).alias("metres"), r(F.col("minutes"), 4).alias("minutes"))


NEAR_V = "SELECT {k}, (SELECT node FROM (SELECT node, {d} AS d FROM v) x ORDER BY d, node LIMIT 1) AS node FROM {t} q"


@query("r1_snap_to_vertex", VERTICES + f", p AS (SELECT q.geom_id, t.node, {D} AS d FROM q_points q, v t), n AS (SELECT *, row_number() OVER (PARTITION BY geom_id ORDER BY d, node) AS r FROM p) SELECT geom_id, node FROM n WHERE r = 1", ("q_points",))
def _(t):
    return rt.snap_to_vertex(t("q_points"), vertices(t))


@query("f10_f11_route_features", VERTICES + _reach_sql() + f""", p AS (SELECT q.geom_id, t.obj_id, t.lon, t.lat, row_number() OVER (PARTITION BY q.geom_id ORDER BY {D}, t.obj_id) AS r FROM q_points q, o_points t WHERE amenity IS NOT NULL AND {D} <= 1000),
z AS (SELECT geom_id, lon, lat FROM p WHERE r = 1),
a AS (SELECT geom_id, node FROM (SELECT q.geom_id, t.node, row_number() OVER (PARTITION BY q.geom_id ORDER BY {D}, t.node) AS r FROM q_points q, v t) x WHERE r = 1),
b AS (SELECT geom_id, node FROM (SELECT q.geom_id, t.node, row_number() OVER (PARTITION BY q.geom_id ORDER BY {D}, t.node) AS r FROM z q, v t) x WHERE r = 1)
SELECT q.geom_id, round(coalesce(m, 1000e0), 3) AS driving_distance_to_nearest_amenity, round(coalesce(t, 1.2e0), 4) AS driving_time_to_nearest_amenity
FROM q_points q LEFT JOIN (SELECT b.geom_id, m, t FROM b JOIN a ON a.geom_id = b.geom_id LEFT JOIN d14_ ON s = a.node AND n = b.node) x ON q.geom_id = x.geom_id""", ("q_points", "o_points", "ways"))
def _(t):
    out = rt.route_features(t("q_points"), t("o_points").where(ft.AMENITY), vertices(t), t("ways"), 1000.0, "amenity")
    return out.select("geom_id", r(F.col("driving_distance_to_nearest_amenity")).alias("driving_distance_to_nearest_amenity"), r(F.col("driving_time_to_nearest_amenity"), 4).alias("driving_time_to_nearest_amenity"))


# --- labels and samples

L1 = f""", f AS (SELECT b.wkt, min(source_idx) AS source_idx, arg_min(y, source_idx) AS label FROM buildings b, areas a WHERE {INTERSECTS} GROUP BY b.wkt),
n AS (SELECT count(*) AS n FROM f WHERE label > 0), p AS (SELECT *, row_number() OVER (ORDER BY {digest_sql(3, 'wkt')}, wkt) AS r FROM f WHERE label > 0), m AS (SELECT *, row_number() OVER (ORDER BY {digest_sql(4, 'wkt')}, wkt) AS r FROM f WHERE label <= 0)
SELECT wkt, source_idx, label FROM p, n WHERE r <= ceil(0.6e0 * n) UNION ALL SELECT wkt, source_idx, CASE WHEN r <= round_even(0.25e0 * n, 0) THEN 1e0 ELSE label END FROM m, n"""


@query("l1_objects_with_labels", L1, ("buildings", "areas"))
def _(t):
    return sa.objects_with_labels(areas(t), buildings(t), 0.6, 0.25, seed=3)


@query("l2_negatives_by_fold", f""", r AS (SELECT doc_id, doc_id % 3 AS fold, toxic AS label FROM labels), n AS (SELECT fold, floor(1.5e0 * count(*)) AS n FROM r WHERE label > 0 GROUP BY fold), m AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {digest_sql(7, 'doc_id')}, doc_id) AS k FROM r WHERE label <= 0)
SELECT doc_id, fold, label FROM r WHERE label > 0 UNION ALL SELECT doc_id, m.fold, label FROM m JOIN n ON m.fold = n.fold WHERE k <= n""".replace(", r AS", "WITH r AS", 1))
def _(t):
    rows = t("labels").select("doc_id", (F.col("doc_id") % 3).alias("fold"), F.col("toxic").alias("label"))
    return sa.negative_sampling_by_fold(rows, 1.5, 7, "doc_id")


@query("sa1_sample_in_range", f"SELECT id, round(34.48e0 + (34.59e0 - 34.48e0) * {unit_sql(3, 'id')}, 7) AS lon, round(31.49e0 + (31.59e0 - 31.49e0) * {unit_sql(4, 'id')}, 7) AS lat FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS id) g")
def _(t):
    customers = t("customer")
    return tb.sample_in_range(customers.sparkSession, (34.48, 34.59, 31.49, 31.59), customers.count(), 3).select("id", r(F.col("lon"), 7).alias("lon"), r(F.col("lat"), 7).alias("lat"))


SA5_KEY = "source_idx || ':0:0'"


@query("sa5_sample_from_geoms", f"SELECT geom_id AS source_idx, round(lon, 6) AS lon, round(lat, 6) AS lat, 2e0 AS y FROM q_points UNION ALL SELECT source_idx, round(min_lon + (max_lon - min_lon) * {unit_sql(5, SA5_KEY, 'i')}, 6), round(min_lat + (max_lat - min_lat) * {unit_sql(6, SA5_KEY, 'i')}, 6), y FROM areas, (SELECT unnest(range(1, 6)) AS i) g", ("q_points", "areas"))
def _(t):
    points = t("q_points").select(F.col("geom_id").alias("source_idx"), F.concat(F.lit("POINT ("), "lon", F.lit(" "), "lat", F.lit(")")).alias("wkt"), F.lit(2.0).alias("y"))
    shapes = areas(t).select("source_idx", geo.to_wkt(F.col("geom")).alias("wkt"), "y")
    drawn = sa.sample_from_geoms(points.unionByName(shapes), 5, 4)
    return drawn.select("source_idx", r(F.col("lon"), 6).alias("lon"), r(F.col("lat"), 6).alias("lat"), "y")


OUTSIDE = "NOT EXISTS (SELECT 1 FROM areas a WHERE lon BETWEEN a.min_lon AND a.max_lon AND lat BETWEEN a.min_lat AND a.max_lat)"


def _draws_sql(rounds: int = 14) -> str:
    """Points outside all areas by rounds, each with the ids up to twice as many as before, from twice the n wanted, until n are found."""
    out, before = "", "0"
    for i in range(rounds):
        low, high = ("0", "2 * n") if i == 0 else (f"{2 ** i} * n", f"{2 ** (i + 1)} * n")
        out += f""", d{i} AS (SELECT id, 34.482724e0 + (34.583301e0 - 34.482724e0) * {unit_sql(9, 'id')} AS lon, 31.492354e0 + (31.585196e0 - 31.492354e0) * {unit_sql(10, 'id')} AS lat FROM (SELECT unnest(range({low}, CASE WHEN {before} < n THEN {high} ELSE {low} END)) AS id FROM n) h),
o{i} AS MATERIALIZED (SELECT id, lon, lat FROM d{i} WHERE {OUTSIDE})"""
        before += f" + (SELECT count(*) FROM o{i})"
    return out + ", o AS (SELECT lon, lat FROM (" + " UNION ALL ".join(f"SELECT * FROM o{i}" for i in range(rounds)) + ") x ORDER BY id LIMIT (SELECT n FROM n))"


SA6 = f""", g AS MATERIALIZED (SELECT min_lon + ix * 1e-3 AS lon, min_lat + iy * 1e-3 AS lat FROM (SELECT *, unnest(range(CAST(ceil((max_lon - min_lon) / 1e-3) AS BIGINT))) AS ix FROM areas) x, LATERAL (SELECT unnest(range(CAST(ceil((max_lat - min_lat) / 1e-3) AS BIGINT))) AS iy) z),
n AS MATERIALIZED (SELECT count(*) AS n FROM g){_draws_sql()}
SELECT 1 AS label, round(lon, 8) AS lon, round(lat, 8) AS lat FROM g UNION ALL SELECT 0, round(lon, 8), round(lat, 8) FROM o"""


@query("sa6_polys_to_dataset", SA6, ("areas",))
def _(t):
    out = sa.polys_to_dataset(areas(t).drop("y"), (34.482724, 34.583301, 31.492354, 31.585196), 1e-3 / geo.DEGREES_PER_METRE, seed=9)
    return out.select("label", r(F.col("lon"), 8).alias("lon"), r(F.col("lat"), 8).alias("lat"))


@query("a6_coverage_ratio", ", b AS (SELECT 34.482724e0 + ix * 2e-3 AS lon, 31.492354e0 + iy * 2e-3 AS lat FROM (SELECT unnest(range(51)) AS ix) i, (SELECT unnest(range(47)) AS iy) j) SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM areas a WHERE lon BETWEEN a.min_lon AND a.max_lon AND lat BETWEEN a.min_lat AND a.max_lat) THEN 1e0 ELSE 0e0 END), 6) AS ratio FROM b", ("areas",))
def _(t):
    whole = t("areas").agg(F.lit(34.482724).alias("min_lon"), F.lit(34.583301).alias("max_lon"), F.lit(31.492354).alias("min_lat"), F.lit(31.585196).alias("max_lat"))
    return su.coverage_ratio(whole, areas(t), 2e-3).select(r(F.col("ratio"), 6).alias("ratio"))


@query("a10_dense_mask", ", c AS (SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1), p AS (SELECT quantile_cont(n, 0.25e0) AS a, quantile_cont(q, 0.75e0) AS b FROM c) SELECT k, CASE WHEN n >= 5 AND n >= a THEN 1 ELSE 0 END AS n_dense, CASE WHEN q >= 5 AND q >= b THEN 1 ELSE 0 END AS q_dense FROM c, p".replace(", c AS", "WITH c AS", 1))
def _(t):
    counts = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return su.dense_mask(counts, {"n": (5, 0.25), "q": (5, 0.75)}, ["k"]).select("k", F.col("n").alias("n_dense"), F.col("q").alias("q_dense"))


@query("j12_g5_closest_to_point", f", p AS (SELECT t.obj_id, {geo.distance_sql('34.53e0', '31.54e0', 't.lon', 't.lat')} AS d FROM o_points t) SELECT obj_id, round(d, 3) AS dist_m FROM p ORDER BY d, obj_id LIMIT 1", ("o_points",))
def _(t):
    return sp.closest_to(t("o_points"), 34.53, 31.54).select("obj_id", r(F.col("dist_m")).alias("dist_m"))


@query("g5_distances", f"SELECT obj_id, round({geo.box_distance_sql('34.53e0', '31.54e0', 't.min_lon', 't.min_lat', 't.max_lon', 't.max_lat')}, 3) AS dist_m FROM buildings t UNION ALL SELECT -t.geom_id - 1, round({geo.distance_sql('34.53e0', '31.54e0', 't.lon', 't.lat')}, 3) FROM q_points t", ("buildings", "q_points"))
def _(t):
    shapes = buildings(t).select("obj_id", "geom").unionByName(t("q_points").select((-F.col("geom_id") - 1).alias("obj_id"), geo.point(F.col("lon"), F.col("lat")).alias("geom")))
    return geo.distances_to_point(shapes, F.lit(34.53), F.lit(31.54)).select("obj_id", r(F.col("dist_m")).alias("dist_m"))


@query("c2_load_in_polygon", ", f AS (SELECT md5(wkt) AS geom_wkt_hash, min(obj_id) AS o, arg_min(height, obj_id) AS h, min(min_lon) AS x0, max(max_lon) AS x1, min(min_lat) AS y0, max(max_lat) AS y1 FROM buildings GROUP BY wkt) SELECT geom_wkt_hash, h AS height FROM f WHERE x0 >= 34.5e0 AND x1 <= 34.56e0 AND y0 >= 31.5e0 AND y1 <= 31.57e0", ("buildings",))
def _(t):
    area = geo.box(F.lit(34.5), F.lit(31.5), F.lit(34.56), F.lit(31.57))
    inside = geo.bound(store(t), "_g", geo.from_wkt(F.col("geom_wkt"))).where(geo.st_within(F.col("_g"), area)).drop("_g")
    return tb.pivot_features(inside, ["height"]).select("geom_wkt_hash", "height")


@query("c5_save_scores", ", n AS (SELECT md5(wkt) AS geom_wkt_hash, 'exp0' AS experiment, 'm1' AS model, 'h1' AS train_hash, max(scores) / 2 AS score FROM buildings b JOIN scores s ON b.obj_id = s.obj_id GROUP BY wkt), o AS (SELECT md5(wkt) AS geom_wkt_hash, experiment, 'm1' AS model, 'h' || min(b.obj_id % 2) AS train_hash, max(scores) AS score FROM buildings b JOIN scores s ON b.obj_id = s.obj_id GROUP BY wkt, experiment) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.geom_wkt_hash = o.geom_wkt_hash AND n.experiment = o.experiment AND n.train_hash = o.train_hash)", ("buildings", "scores"))
def _(t):
    met = t("buildings").join(t("scores"), "obj_id").withColumnRenamed("wkt", "geom_wkt")
    old = met.groupBy(geo.geom_hash(F.col("geom_wkt")).alias("geom_wkt_hash"), "geom_wkt", "experiment").agg(F.concat(F.lit("h"), F.min(F.col("obj_id") % 2)).alias("train_hash"), F.max("scores").alias("score"))
    old = old.withColumns({"model": F.lit("m1"), "modification_date": F.lit("2020-01-01 00:00:00").cast("timestamp")})
    new = met.groupBy("geom_wkt").agg((F.max("scores") / 2).alias("m1"))
    return tb.save_scores(old, new, ["m1"], "exp0", "h1", F.lit("2021-01-01 00:00:00").cast("timestamp")).select(*tb.SCORE_KEYS, "score")


@query("p5_p11_feature_filter", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS number_of_shop_100m, p_retailprice AS distance_to_shop_100m FROM part")
def _(t):
    frame = t("part").select("p_partkey", F.col("p_size").cast("double").alias("number_of_shop_100m"), F.lit(1).alias("number_of_park_100m"), F.col("p_retailprice").alias("distance_to_shop_100m"))
    return ft.feature_filter(frame, ft.bundle([(ft.SHOP, "points", "shop", [100, 250], ft.SUITED["point"], 1), (ft.PARK, "points", "park", [100], ft.SUITED["point"], 11)]), ["p_partkey"])


@query("p10_of_kind", "SELECT obj_id FROM buildings UNION ALL SELECT geom_id FROM q_points WHERE false", ("buildings", "q_points"))
def _(t):
    both = buildings(t).select("obj_id", "geom").unionByName(t("q_points").select(F.col("geom_id").alias("obj_id"), geo.point(F.col("lon"), F.col("lat")).alias("geom")))
    return geo.of_kind(both, "Polygon").select("obj_id")


@query("t4_importance_order", ", w AS (SELECT c_mktsegment AS feature, avg(c_acctbal) - 4500 AS weight FROM customer GROUP BY 1) SELECT feature, CAST(row_number() OVER (ORDER BY abs(weight) DESC, feature) AS BIGINT) AS rank FROM w".replace(", w AS", "WITH w AS", 1))
def _(t):
    weights = t("customer").groupBy(F.col("c_mktsegment").alias("feature")).agg((F.avg("c_acctbal") - 4500).alias("weight"))
    return tb.ranked(weights, [-F.abs("weight")], ["feature"]).select("feature", "rank")


@query("x6_distance_correlation", ", s AS (SELECT vec_id, embedding AS a, list_transform(embedding[1:8], lambda x: x * 2) AS b FROM embeddings), d AS (SELECT list_distance(x.a, y.a) AS u, list_distance(x.b, y.b) AS v FROM s x, s y) SELECT round(corr(u, v), 4) AS correlation FROM d".replace(", s AS", "WITH s AS", 1))
def _(t):
    rows = t("embeddings").select("vec_id", F.col("embedding").alias("a"), F.transform(F.slice("embedding", 1, 8), lambda x: x * 2).alias("b"))
    return tb.distance_correlation(rows, "vec_id", "a", "b").select(r(F.col("correlation"), 4).alias("correlation"))


B2 = """, f AS (SELECT wkt, min(obj_id) AS o, arg_min(height, obj_id) AS height, arg_min(ground, obj_id) AS ground, min(min_lon) AS x0, max(max_lon) AS x1, min(min_lat) AS y0, max(max_lat) AS y1 FROM buildings GROUP BY wkt),
s AS (SELECT wkt, o, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat, height AS v, 'height' AS channel FROM f WHERE x0 >= 34.5e0 AND x1 <= 34.56e0 AND y0 >= 31.5e0 AND y1 <= 31.57e0 UNION ALL SELECT wkt, o, (x0 + x1) / 2, (y0 + y1) / 2, ground, 'ground' FROM f WHERE o % 2 = 0 AND x0 >= 34.5e0 AND x1 <= 34.56e0 AND y0 >= 31.5e0 AND y1 <= 31.57e0),
m AS (SELECT channel, min(v) AS a, max(v) AS b FROM s GROUP BY channel), g AS (SELECT min(lon) AS x, min(lat) AS y, max(lon) AS x1, max(lat) AS y1 FROM s),
c AS (SELECT s.channel, CAST(round_even((lon - x) / (500 * (1e-5 / 1.11e0)), 0) AS INTEGER) AS ix, CAST(round_even((lat - y) / (500 * (1e-5 / 1.11e0)), 0) AS INTEGER) AS iy, o, coalesce((v - a) / nullif(b - a, 0), 0e0) AS v FROM s JOIN m ON s.channel = m.channel, g),
k AS (SELECT ix, iy, arg_max(v, o) FILTER (channel = 'height') AS height, arg_max(v, o) FILTER (channel = 'ground') AS ground FROM c GROUP BY ix, iy),
w AS (SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM (SELECT *, unnest(range(CAST(round_even((x1 - x) / (500 * (1e-5 / 1.11e0)), 0) AS BIGINT) + 1)) AS ix FROM g) h, LATERAL (SELECT unnest(range(CAST(round_even((y1 - y) / (500 * (1e-5 / 1.11e0)), 0) AS BIGINT) + 1)) AS iy) z)
SELECT w.ix, w.iy, round(coalesce(height, 0e0), 6) AS height, round(coalesce(ground, 0e0), 6) AS ground, CASE WHEN k.ix IS NULL THEN 0 ELSE 1 END AS mask FROM w LEFT JOIN k ON w.ix = k.ix AND w.iy = k.iy"""


@query("b2_feature_image", B2, ("buildings",))
def _(t):
    rows = store(t).join(wide(t).select("geom_wkt", "obj_id"), "geom_wkt")
    area = geo.box(F.lit(34.5), F.lit(31.5), F.lit(34.56), F.lit(31.57))
    image = su.feature_image(rows, ["height", "ground"], 500.0, "obj_id", area)
    return image.select("ix", "iy", r(F.col("height"), 6).alias("height"), r(F.col("ground"), 6).alias("ground"), "mask")


@query("b4_pixels_to_points", "SELECT vec_id, CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col, round(34.5e0 + (i % 8) * 0.01e0 / 7, 8) AS lon, round(31.5e0 + (i // 8) * 0.02e0 / 7, 8) AS lat FROM embeddings, (SELECT unnest(range(64)) AS i) g")
def _(t):
    placed = su.pixels_to_points(pixels(t), (34.5, 34.51, 31.5, 31.52), 8, 8)
    return placed.select("vec_id", "row", "col", r(F.col("lon"), 8).alias("lon"), r(F.col("lat"), 8).alias("lat"))


@query("b5_label_by_band", "SELECT vec_id, CAST(i // 8 AS INTEGER) AS row, " + ", ".join(f"CAST(embedding[i + {k + 1}] AS DOUBLE) AS b{k}" for k in range(8)) + " FROM embeddings, (SELECT unnest(range(0, 64, 8)) AS i) g")
def _(t):
    stacked = su.label_by_band(pixels(t), ["vec_id", "row"], "col", "value")
    return stacked.select("vec_id", "row", *[F.col("bands")[k].alias(f"b{k}") for k in range(8)])


# --- models

FEATURES = ["number_of_amenity_250m", "distance_to_amenity_250m", "number_of_object_1000m"]


def dataset(t):
    fs = [ft.NumberOf(ft.AMENITY, "points", "amenity", 250.0), ft.DistanceTo(ft.AMENITY, "points", "amenity", 250.0), ft.NumberOf(ft.ALL, "points", "object", 1000.0)]
    x = ft.FeatureBuilder(fs, {"points": t("o_points")}).transform(t("q_points"))
    y = t("customer").select(F.col("c_custkey").alias("geom_id"), F.when(F.col("c_acctbal") > 5000, 1.0).otherwise(0.0).alias("label"), (F.col("c_custkey") % 2).cast("int").alias("fold"))
    # fitted many times; a written table keeps the plan of the features out of every one of these jobs
    return written(x.join(y, "geom_id"))


@query("k1_k3_fit_folds")
def _(t):
    return ml.fold_scores(ml.fit_folds(dataset(t), FEATURES, "geom_id"))


@query("k2_predict_all")
def _(t):
    return ml.predict_all(ml.fit_folds(dataset(t), FEATURES, "geom_id"), "geom_id", list(ml.MODELS))


@query("k4_t3_select_features")
def _(t):
    rows = dataset(t)
    return rows.select("geom_id", *ml.select_features(rows, FEATURES, 2))


@query("k5_baseline_score", "SELECT obj_id, round(1 - power((ground - 6) / 6, 2) + 1 - power((height - 8000) / 8000, 2) + 0.9e0 + 0.5e0, 6) AS score FROM buildings", ("buildings",))
def _(t):
    return t("buildings").select("obj_id", r(cl.cluster_baseline_score(F.col("ground"), F.col("height"), F.lit(0.9), F.lit(0.5)), 6).alias("score"))


@query("k6_gaussian_score", ", m AS (SELECT avg(height) AS mh, avg(ground) AS mg, covar_samp(height, height) AS a, covar_samp(height, ground) AS b, covar_samp(ground, ground) AS c FROM buildings) SELECT obj_id, round(sqrt((power(height - mh, 2) * c - 2 * (height - mh) * (ground - mg) * b + power(ground - mg, 2) * a) / (a * c - b * b)), 5) AS distance FROM buildings, m", ("buildings",))
def _(t):
    rows = t("buildings").select("obj_id", "height", "ground")
    return ml.gaussian_score(rows, rows, ["height", "ground"]).select("obj_id", r(F.col("distance"), 5).alias("distance"))


@query("k7_embeddings", f"SELECT c_custkey, round(sum(CAST({unit_sql(0, 'c_custkey', 'i')} AS FLOAT)::DOUBLE), 5) AS total, round(max(CASE WHEN i = 128 THEN CAST({unit_sql(0, 'c_custkey', 'i')} AS FLOAT)::DOUBLE END), 6) AS last, 0e0 AS zero FROM customer, (SELECT unnest(range(1, 129)) AS i) g GROUP BY c_custkey")
def _(t):
    rows = t("customer").select("c_custkey")
    both = ml.random_embedding(rows, "c_custkey").join(ml.zero_embedding(rows, "c_custkey").withColumnRenamed("embedding", "z"), "c_custkey")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return both.select("c_custkey", r(total, 5).alias("total"), r(F.element_at("embedding", -1).cast("double"), 6).alias("last"), F.col("z")[0].cast("double").alias("zero"))


# --- clusters

@query("a5_g16_convex_hull", f"SELECT obj_id, round({BOX_AREA}, 2) AS area FROM buildings t", ("buildings",))
def _(t):
    return cl.convex_hull_agg(buildings(t), "obj_id").select("obj_id", r(geo.area_m2(F.col("hull")), 2).alias("area"))


@query("a5_hull_of_all", ", c AS (SELECT min_lon, max_lon, min_lat, max_lat, obj_id % 3 AS g FROM buildings) SELECT g, round(max(max_lon), 7) AS east, round(min(min_lon), 7) AS west, round(max(max_lat), 7) AS north, round(min(min_lat), 7) AS south, true AS covers FROM c GROUP BY g", ("buildings",))
def _(t):
    rows = written(buildings(t).select((F.col("obj_id") % 3).alias("g"), "geom"))
    hulls = written(cl.convex_hull_agg(rows, "g"))
    box = geo.bbox(F.col("hull"))
    # a vertex that is a corner of the hull may stand beside its edge by a rounding, so the hull is compared as grown by a millimetre about its centre
    held = cl.covered_by_hulls(rows, hulls, "g")
    ends = {"east": "max_lon", "west": "min_lon", "north": "max_lat", "south": "min_lat"}
    return hulls.join(held, "g").select("g", *[r(box[k], 7).alias(n) for n, k in ends.items()], "covers")


@query("q1_neighbour_clusters")
def _(t):
    layer = buildings(t)
    start = cl.with_hulls(layer.select(F.col("obj_id").alias("start"), F.array("obj_id").alias("buildings")), layer)
    return cl.neighbour_clusters(start, layer, 60.0).select("start", F.size("buildings").alias("n"), "hull_wkt")


@query("q2_grow_clusters")
def _(t):
    layer = buildings(t)
    score = lambda c: c.withColumn("score", cl.cluster_baseline_score(F.size("buildings"), geo.area_m2(F.col("hull")), F.lit(0.0), F.lit(0.0)))
    grown = cl.grow_clusters(layer, layer, score, radius=60.0)
    return grown.select("start", F.size("buildings").alias("n"), r(F.col("score"), 6).alias("score"))


@query("q2_e2_grow_by_features")
def _(t):
    layer = buildings(t)
    fs = [ft.NumberOf(ft.AMENITY, "points", "amenity", 100.0), ft.DistanceTo(ft.ALL, "points", "object", 250.0), ft.NumberOf(ft.ALL, "points", "object", 250.0)]
    builder = ft.FeatureBuilder(fs, {"points": t("o_points")})
    known = builder.transform(areas(t).select(F.col("source_idx").alias("geom_id"), "geom"))
    score = cl.FeatureScore(builder, cl.unlike(known, [n for f in fs for n in f.names()]))
    grown = cl.grow_clusters(layer, layer, score, radius=60.0)
    return grown.select("start", F.size("buildings").alias("n"), r(F.col("score"), 6).alias("score"))
