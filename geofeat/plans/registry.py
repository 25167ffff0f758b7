"""Named queries over the driver tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.functions.hashed import digest_sql, unit_sql
from geofeat.operators import draws
from geofeat.operators import features as ft
from geofeat.operators import models as ml
from geofeat.operators import spatial as sp
from geofeat.operators import summaries as su
from geofeat.operators import tables as tb
from geofeat.sources.fixtures import raw, table, with_tables
from geofeat.sources.shared import written

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a function of (tables) where tables(name) gives a frame; sql may use the needed derived tables."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLE_SQL[name] = with_tables(sql, *needs) if needs else sql
        return f

    return register


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return ORACLE_SQL


def r(c, digits: int = 3):
    return F.round(c, digits)


def nudged(c, digits: int = 3):
    """Rounds means of short decimals, which often end in 5 just behind the digits, the same way in all engines."""
    return F.round(c + 1e-9, digits)


D = geo.distance_sql("q.lon", "q.lat", "t.lon", "t.lat")
BOX_D = geo.box_distance_sql("q.lon", "q.lat", "t.min_lon", "t.min_lat", "t.max_lon", "t.max_lat")
BOX_AREA = f"radians(t.max_lon-t.min_lon)*({geo.authalic_sql('t.max_lat')}-{geo.authalic_sql('t.min_lat')})"


def buildings(t):
    return geo.bound(t("buildings").drop("min_lon", "min_lat", "max_lon", "max_lat"), "geom", geo.from_wkt(F.col("wkt")))


def roads(t):
    lines = t("road_vertices").groupBy("obj_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("v")).where(F.size("v") > 1)
    shaped = lines.select("obj_id", geo.line(F.transform("v", lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat")))).alias("geom"))
    return shaped.join(t("roads"), "obj_id")


# --- pairs and map features

POINT_FEATURES = [cls(flt, "points", name, rad) for name, flt in (("amenity", ft.AMENITY), ("object", ft.ALL)) for rad in (100.0, 250.0, 1000.0) for cls in (ft.NumberOf, ft.DistanceTo)]


def point_features(q: DataFrame, o: DataFrame) -> DataFrame:
    out = ft.FeatureBuilder(POINT_FEATURES, {"points": o}).transform(q)
    return out.select("geom_id", *[r(F.col(c)).alias(c) for c in out.columns[1:]])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_features(table(spark, sf_dir, "q_points"), table(spark, sf_dir, "o_points"))


def _features_sql() -> str:
    cols = []
    for f in POINT_FEATURES:
        hit = f"dist <= {f.radius}e0" + (" AND amenity IS NOT NULL" if f.object_name == "amenity" else "")
        name = f.names()[0]
        cols.append(f"round(coalesce(sum(CASE WHEN {hit} THEN 1e0 END), 0e0), 3) AS {name}" if isinstance(f, ft.NumberOf) else f"round(coalesce(min(CASE WHEN {hit} AND NOT same THEN dist END), {f.radius}e0), 3) AS {name}")
    return f""", p AS (SELECT q.geom_id, t.obj_id, t.amenity, q.lon = t.lon AND q.lat = t.lat AS same, {D} AS dist FROM q_points q, o_points t)
SELECT q.geom_id, {', '.join(cols)} FROM q_points q LEFT JOIN p ON q.geom_id = p.geom_id AND dist <= 1000 GROUP BY q.geom_id"""


@query("e2_feature_builder", _features_sql(), ("q_points", "o_points"))
def _(t):
    return point_features(t("q_points"), t("o_points"))


@query("j1_dwithin_join", f"SELECT q.geom_id, t.obj_id, round({D}, 3) AS dist_m FROM q_points q, o_points t WHERE {D} <= 250", ("q_points", "o_points"))
def _(t):
    return sp.dwithin_points(t("q_points"), t("o_points"), 250.0).select("geom_id", "obj_id", r(F.col("dist_m")).alias("dist_m"))


BUILDING_FEATURES = [cls(ft.BUILDING, "polygons", "building", rad) for rad in (100.0, 250.0) for cls in (ft.NumberOf, ft.DistanceTo, ft.AreaOf, ft.AreaOfNearest, ft.Heights)]


def _building_sql() -> str:
    cols = []
    for f in BUILDING_FEATURES:
        hit = f"dist <= {f.radius}e0"
        if isinstance(f, ft.NumberOf):
            cols.append(f"coalesce(sum(CASE WHEN {hit} THEN 1e0 END), 0e0)")
        elif isinstance(f, ft.DistanceTo):
            cols.append(f"coalesce(min(CASE WHEN {hit} THEN dist END), {f.radius}e0)")
        elif isinstance(f, ft.AreaOf):
            cols.append(f"coalesce(sum(CASE WHEN {hit} THEN area END) / {ft.AREA_DIVISOR}e0, 0e0)")
        elif isinstance(f, ft.AreaOfNearest):
            cols.append(f"coalesce(max(CASE WHEN {hit} AND nth = 1 THEN area END), 0e0)")
        else:
            cols += [f"coalesce({s}(CASE WHEN {hit} THEN {c} END), 0e0)" for c in ("height", "ground + height") for s in ("avg", "min", "max", "stddev_samp")]
    names = [n for f in BUILDING_FEATURES for n in f.names()]
    return f""", p AS (SELECT q.geom_id, t.obj_id, height, ground, {BOX_D} AS dist, {BOX_AREA} AS area FROM q_points q, buildings t WHERE building IS NOT NULL AND {BOX_D} <= 250),
n AS (SELECT *, row_number() OVER (PARTITION BY geom_id ORDER BY dist, obj_id) AS nth FROM p)
SELECT q.geom_id, {', '.join(f'round({c} + 1e-9, 3) AS {n}' for c, n in zip(cols, names))} FROM q_points q LEFT JOIN n ON q.geom_id = n.geom_id GROUP BY q.geom_id"""


@query("f2_f5_f6_building_features", _building_sql(), ("q_points", "buildings"))
def _(t):
    out = ft.FeatureBuilder(BUILDING_FEATURES, {"polygons": buildings(t)}).transform(t("q_points"))
    return out.select("geom_id", *[nudged(F.col(c)).alias(c) for c in out.columns[1:]])


KX, KY = geo.m_per_lon("q.lat"), geo.m_per_lat("q.lat")
SEGMENTS = f""", s AS (SELECT obj_id, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS by2, {geo.distance_sql('lon', 'lat', 'lead(lon) OVER w', 'lead(lat) OVER w')} AS len FROM road_vertices WINDOW w AS (PARTITION BY obj_id ORDER BY seq)),
l AS (SELECT obj_id, sum(len) AS len, min(least(ax, bx)) AS x0, max(greatest(ax, bx)) AS x1, min(least(ay, by2)) AS y0, max(greatest(ay, by2)) AS y1 FROM s WHERE bx IS NOT NULL GROUP BY obj_id),
c AS (SELECT q.geom_id, q.lon, q.lat, l.obj_id, len FROM q_points q JOIN l ON q.lon BETWEEN x0 - 5e-3 AND x1 + 5e-3 AND q.lat BETWEEN y0 - 5e-3 AND y1 + 5e-3),
e AS (SELECT q.geom_id, q.obj_id, q.len, (ax-q.lon)*{KX} AS ax, (ay-q.lat)*{KY} AS ay, (bx-q.lon)*{KX} AS bx, (by2-q.lat)*{KY} AS by2 FROM c q JOIN s ON q.obj_id = s.obj_id WHERE bx IS NOT NULL),
d AS (SELECT *, CASE WHEN power(bx-ax,2)+power(by2-ay,2) = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, -(ax*(bx-ax)+ay*(by2-ay))/(power(bx-ax,2)+power(by2-ay,2)))) END AS u FROM e),
g AS (SELECT geom_id, obj_id, max(len) AS len, min(sqrt(power(ax+u*(bx-ax),2)+power(ay+u*(by2-ay),2))) AS dist FROM d GROUP BY geom_id, obj_id)"""


@query("f3_total_length", SEGMENTS + """ SELECT q.geom_id, round(coalesce(sum(CASE WHEN highway IN ('primary', 'secondary', 'tertiary') THEN len END), 0e0), 3) AS length_of_major_road_250m,
round(coalesce(min(CASE WHEN highway IN ('primary', 'secondary', 'tertiary') THEN dist END), 250e0), 3) AS distance_to_major_road_250m, round(coalesce(sum(CASE WHEN highway IN ('residential', 'service', 'track', 'path') THEN len END), 0e0), 3) AS length_of_minor_road_250m
FROM q_points q LEFT JOIN (SELECT g.*, highway FROM g JOIN roads ON g.obj_id = roads.obj_id WHERE dist <= 250) x ON q.geom_id = x.geom_id GROUP BY q.geom_id""", ("q_points", "road_vertices", "roads"))
def _(t):
    wanted = [ft.TotalLength(ft.MAJOR_ROAD, "lines", "major_road", 250.0), ft.DistanceTo(ft.MAJOR_ROAD, "lines", "major_road", 250.0), ft.TotalLength(ft.MINOR_ROAD, "lines", "minor_road", 250.0)]
    out = ft.FeatureBuilder(wanted, {"lines": roads(t)}).transform(t("q_points"))
    return out.select("geom_id", *[r(F.col(c)).alias(c) for c in out.columns[1:]])


@query("f7_j10_object_distances", f""", p AS (SELECT q.geom_id, t.obj_id, t.lon, t.lat FROM q_points q, o_points t WHERE amenity IS NOT NULL AND {D} <= 250),
d AS (SELECT q.geom_id, {D} AS d FROM p q JOIN p t ON q.geom_id = t.geom_id AND q.obj_id <> t.obj_id)
SELECT q.geom_id, {', '.join(f"round(coalesce({s if s != 'stddev' else 'stddev_samp'}(d), 0e0), 3) AS object_distances_amenity_{s}_250m" for s in ft.STATISTICS)} FROM q_points q LEFT JOIN d ON q.geom_id = d.geom_id GROUP BY q.geom_id""", ("q_points", "o_points"))
def _(t):
    out = ft.object_distances_around(t("q_points"), t("o_points"), ft.AMENITY, "amenity", 250.0)
    filled = ft.fill_defaults(t("q_points"), out, {c: 0.0 for c in out.columns[1:]})
    return filled.select("geom_id", *[r(F.col(c)).alias(c) for c in out.columns[1:]])


@query("f8_j11_building_scores", f""", p AS (SELECT q.geom_id, s.scores FROM q_points q, buildings t, scores s WHERE t.obj_id = s.obj_id AND experiment = 'exp1' AND model = 'm1' AND building IS NOT NULL AND {BOX_D} <= 250)
SELECT q.geom_id, {', '.join(f"round(coalesce({s if s != 'stddev' else 'stddev_samp'}(scores), 0e0), 4) AS building_scores_{s}_250m" for s in ft.STATISTICS)} FROM q_points q LEFT JOIN p ON q.geom_id = p.geom_id GROUP BY q.geom_id""", ("q_points", "buildings", "scores"))
def _(t):
    known = t("buildings").hint("merge").join(t("scores"), "obj_id").groupBy(F.col("wkt").alias("geom_wkt"), "experiment", "model").agg(F.first("scores").alias("score")).withColumn("train_hash", F.lit("h1"))
    scored = written(tb.score_join(buildings(t), known, "exp1", "m1", "h1"))
    out = ft.FeatureBuilder([ft.BuildingScores(ft.BUILDING, "polygons", "building", 250.0)], {"polygons": scored}).transform(t("q_points"))
    return out.select("geom_id", *[r(F.col(c), 4).alias(c) for c in out.columns[1:]])


@query("f9_g9_area_of_self", f"SELECT t.obj_id AS geom_id, round({BOX_AREA}, 3) AS area_of_self_0m FROM buildings t", ("buildings",))
def _(t):
    return ft.area_of_self(buildings(t).withColumnRenamed("obj_id", "geom_id")).select("geom_id", r(F.col("area_of_self_0m")).alias("area_of_self_0m"))


@query("p1_p2_p3_p9_flags", """SELECT obj_id, CASE WHEN amenity IS NOT NULL THEN 1 ELSE 0 END AS amenity_flag, CASE WHEN shop IS NOT NULL THEN 1 ELSE 0 END AS shop_flag FROM o_points WHERE amenity IS NOT NULL OR shop IS NOT NULL""", ("o_points",))
def _(t):
    filters = {"amenity_flag": ft.AMENITY, "shop_flag": ft.SHOP}
    return ft.flag_columns(ft.any_filter(t("o_points"), filters), filters).select("obj_id", *filters)


@query("p9_heights", "SELECT obj_id, round(ground + height, 4) AS absolute_height FROM buildings", ("buildings",))
def _(t):
    return ft.height_columns(t("buildings")).select("obj_id", r(F.col("absolute_height"), 4).alias("absolute_height"))


@query("p7_fill_defaults", "SELECT c_custkey AS geom_id, coalesce(n, -1e0) AS n FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_custkey) x ON c_custkey = o_custkey")
def _(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("geom_id")).agg(F.count("*").cast("double").alias("n"))
    return ft.fill_defaults(t("customer").select(F.col("c_custkey").alias("geom_id")), n, {"n": -1.0})


# --- lookups

INTERSECTS = "b.min_lon <= a.max_lon AND a.min_lon <= b.max_lon AND b.min_lat <= a.max_lat AND a.min_lat <= b.max_lat"


def areas(t):
    return t("areas").select("source_idx", "y", geo.box(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")).alias("geom"))


@query("j3_j4_objects_from_polygons", f"SELECT b.wkt, min(source_idx) AS source_idx FROM buildings b, areas a WHERE building IS NOT NULL AND {INTERSECTS} GROUP BY b.wkt", ("buildings", "areas"))
def _(t):
    return sp.objects_from_polygons(areas(t), buildings(t).where(ft.BUILDING))


@query("j3_objects_within", "SELECT b.wkt, min(source_idx) AS source_idx FROM buildings b, areas a WHERE b.min_lon >= a.min_lon AND b.max_lon <= a.max_lon AND b.min_lat >= a.min_lat AND b.max_lat <= a.max_lat GROUP BY b.wkt", ("buildings", "areas"))
def _(t):
    return sp.objects_from_polygons(areas(t), buildings(t), intersects=False)


@query("j5_objects_in_radius", f"SELECT DISTINCT q.geom_id, t.wkt FROM q_points q, buildings t WHERE {BOX_D} <= 250 AND NOT EXISTS (SELECT 1 FROM areas a, buildings b WHERE b.obj_id = t.obj_id AND {INTERSECTS})", ("q_points", "buildings", "areas"))
def _(t):
    inputs = t("q_points").select("geom_id", geo.point(F.col("lon"), F.col("lat")).alias("geom"))
    return sp.objects_in_radius(inputs, buildings(t), 250.0, areas(t))


@query("j6_k_nearest", f", p AS (SELECT q.geom_id, t.obj_id, {D} AS dist FROM q_points q, o_points t), n AS (SELECT *, row_number() OVER (PARTITION BY geom_id ORDER BY dist, obj_id) AS rank FROM p) SELECT geom_id, obj_id, CAST(rank AS INTEGER) AS rank, round(dist, 3) AS dist_m FROM n WHERE rank <= 5", ("q_points", "o_points"))
def _(t):
    return sp.k_nearest(t("q_points"), t("o_points"), 5).select("geom_id", "obj_id", "rank", r(F.col("dist_m")).alias("dist_m"))


J7 = f""", p AS (SELECT a.source_idx AS geom_id, q.geom_id AS obj_id, q.lon, q.lat, a.min_lon, a.max_lon, a.min_lat, a.max_lat, {geo.box_distance_sql('q.lon', 'q.lat', 'a.min_lon', 'a.min_lat', 'a.max_lon', 'a.max_lat')} AS dist FROM areas a, q_points q WHERE NOT EXISTS (SELECT 1 FROM areas z WHERE q.lon BETWEEN z.min_lon AND z.max_lon AND q.lat BETWEEN z.min_lat AND z.max_lat)),
n AS (SELECT *, row_number() OVER (PARTITION BY geom_id ORDER BY dist, obj_id) AS r FROM p WHERE dist <= 1000)
SELECT geom_id, obj_id, round((min_lon + max_lon) / 2 + 1e-9, 6) AS source_lon, round((min_lat + max_lat) / 2 + 1e-9, 6) AS source_lat, round(least(greatest(lon, min_lon), max_lon), 6) AS destination_lon, round(least(greatest(lat, min_lat), max_lat), 6) AS destination_lat FROM n WHERE r = 1"""


@query("j7_nearest_pairs", J7, ("q_points", "areas"))
def _(t):
    # objects which lie in no area, as destinations inside are any point of the area's edge
    outside = sp.points_outside(t("q_points").withColumnRenamed("geom_id", "obj_id"), areas(t), "obj_id")
    near = sp.nearest_pairs(areas(t).withColumnRenamed("source_idx", "geom_id"), outside.select("obj_id", geo.point(F.col("lon"), F.col("lat")).alias("geom")), 1000.0)
    return near.select("geom_id", "obj_id", *[nudged(F.col(f"source.{c}"), 6).alias(f"source_{c}") for c in ("lon", "lat")], *[r(F.col(f"destination.{c}"), 6).alias(f"destination_{c}") for c in ("lon", "lat")])


@query("j7_w1_nearest_pairs", f", p AS (SELECT q.geom_id, t.obj_id, {D} AS dist FROM q_points q, o_points t WHERE amenity IS NOT NULL AND {D} <= 500), n AS (SELECT *, row_number() OVER (PARTITION BY geom_id ORDER BY dist, obj_id) AS r FROM p) SELECT geom_id, obj_id, round(dist, 3) AS dist_m FROM n WHERE r = 1", ("q_points", "o_points"))
def _(t):
    return sp.k_nearest(t("q_points"), t("o_points").where(ft.AMENITY), 1, limit_m=500.0).select("geom_id", "obj_id", r(F.col("dist_m")).alias("dist_m"))


@query("j8_label_within", "SELECT q.geom_id, EXISTS (SELECT 1 FROM areas a WHERE q.lon BETWEEN a.min_lon AND a.max_lon AND q.lat BETWEEN a.min_lat AND a.max_lat) AS inside FROM q_points q", ("q_points", "areas"))
def _(t):
    return sp.label_within(t("q_points"), areas(t), "geom_id").select("geom_id", "inside")


@query("j13_points_outside", "SELECT q.geom_id FROM q_points q WHERE NOT EXISTS (SELECT 1 FROM areas a WHERE q.lon BETWEEN a.min_lon AND a.max_lon AND q.lat BETWEEN a.min_lat AND a.max_lat)", ("q_points", "areas"))
def _(t):
    return sp.points_outside(t("q_points"), areas(t), "geom_id").select("geom_id")


@query("a11_object_counts", ", c AS (SELECT source_idx, count(obj_id) AS n FROM areas a LEFT JOIN o_points o ON o.lon BETWEEN a.min_lon AND a.max_lon AND o.lat BETWEEN a.min_lat AND a.max_lat GROUP BY source_idx), q AS (SELECT quantile_cont(n, 0.5) AS p FROM c) SELECT source_idx, n, CASE WHEN n >= 1 AND n >= p THEN 1 ELSE 0 END AS dense FROM c, q", ("areas", "o_points"))
def _(t):
    counts = written(su.object_counts(areas(t), t("o_points"), {"n": ft.ALL}))
    dense = su.dense_mask(counts, {"n": (1, 0.5)}, ["source_idx"]).withColumnRenamed("n", "dense")
    return counts.join(dense, "source_idx").select("source_idx", "n", "dense")


# --- geometry functions

@query("g1_wkt_round_trip", "SELECT obj_id, wkt, 'POLYGON' AS kind, 5 AS n_points FROM buildings", ("buildings",))
def _(t):
    g = F.col("geom")
    return buildings(t).select("obj_id", geo.to_wkt(g).alias("wkt"), g["kind"].alias("kind"), F.size(F.flatten(g["parts"])).alias("n_points"))


@query("g3_distance_to_centre", f"SELECT q.geom_id, round({geo.distance_sql('q.lon', 'q.lat', '34.53e0', '31.54e0')}, 3) AS dist_m FROM q_points q", ("q_points",))
def _(t):
    return t("q_points").select("geom_id", r(geo.distance_m(F.col("lon"), F.col("lat"), F.lit(34.53), F.lit(31.54))).alias("dist_m"))


@query("g6_geodesic", None)
def _(t):
    return t("q_points").select("geom_id", r(geo.geodesic_m(F.col("lon"), F.col("lat"), F.lit(2.35), F.lit(48.85))).alias("metres"))


@query("g4_g12_closest_point", f", x AS (SELECT t.obj_id, t.min_lon, t.min_lat, least(greatest(34.53e0, t.min_lon), t.max_lon) AS lon, least(greatest(31.54e0, t.min_lat), t.max_lat) AS lat, {geo.box_distance_sql('34.53e0', '31.54e0', 't.min_lon', 't.min_lat', 't.max_lon', 't.max_lat')} AS d FROM buildings t) SELECT obj_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(d, 3) AS dist_m FROM x WHERE d > 0", ("buildings",))
def _(t):
    out = geo.bound(buildings(t), "c", geo.closest_point(F.col("geom"), F.lit(34.53), F.lit(31.54)))
    out = geo.bound(out, "d", F.when(geo.st_covers_point(F.col("geom"), F.lit(34.53), F.lit(31.54)), F.lit(0.0)).otherwise(F.sqrt("c.d2")))
    return out.where("d > 0").select("obj_id", r(F.col("c.lon"), 6).alias("lon"), r(F.col("c.lat"), 6).alias("lat"), r(F.col("d")).alias("dist_m"))


@query("g10_road_length", f", s AS (SELECT obj_id, {geo.distance_sql('lon', 'lat', 'lead(lon) OVER w', 'lead(lat) OVER w')} AS len FROM road_vertices WINDOW w AS (PARTITION BY obj_id ORDER BY seq)) SELECT obj_id, round(sum(len), 3) AS length_m FROM s WHERE len IS NOT NULL GROUP BY obj_id", ("road_vertices",))
def _(t):
    return roads(t).select("obj_id", r(geo.length_m(F.col("geom"))).alias("length_m"))


@query("g11_centroid", "SELECT obj_id, round((min_lon + max_lon) / 2 + 1e-9, 6) AS lon, round((min_lat + max_lat) / 2 + 1e-9, 6) AS lat FROM buildings", ("buildings",))
def _(t):
    c = geo.centroid(F.col("geom"))
    return buildings(t).select("obj_id", nudged(c["lon"], 6).alias("lon"), nudged(c["lat"], 6).alias("lat"))


@query("g13_bbox", "SELECT obj_id, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat FROM road_vertices GROUP BY obj_id HAVING count(*) > 1", ("road_vertices",))
def _(t):
    b = geo.bbox(F.col("geom"))
    return roads(t).select("obj_id", *[r(b[k], 6).alias(k) for k in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query("g14_rect", "SELECT geom_id, round(lon - 2e-3, 6) AS min_lon, round(lon + 2e-3, 6) AS max_lon, round(lat - 1e-3, 6) AS min_lat, round(lat + 1e-3, 6) AS max_lat FROM q_points", ("q_points",))
def _(t):
    b = geo.bbox(geo.rect(F.col("lon"), F.col("lat"), F.lit(2e-3), F.lit(4e-3)))
    return t("q_points").select("geom_id", *[r(b[k], 6).alias(k) for k in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query("g15_tile_extent", f"SELECT geom_id, round(lon - 50/{geo.m_per_lon('lat')}, 6) AS min_lon, round(lon + 50/{geo.m_per_lon('lat')}, 6) AS max_lon, round(lat - 50/{geo.m_per_lat('lat')}, 6) AS min_lat, round(lat + 50/{geo.m_per_lat('lat')}, 6) AS max_lat FROM q_points", ("q_points",))
def _(t):
    b = geo.tile_extent(F.col("lon"), F.col("lat"), F.lit(50.0))
    return t("q_points").select("geom_id", *[r(b[k], 6).alias(k) for k in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query("g17_geohash", None)
def _(t):
    return t("q_points").select("geom_id", geo.geohash(F.col("lon"), F.col("lat"), 8).alias("geohash"))


@query("g7_st_predicates", f"SELECT source_idx, obj_id, b.min_lon >= a.min_lon AND b.max_lon <= a.max_lon AND b.min_lat >= a.min_lat AND b.max_lat <= a.max_lat AS within FROM buildings b, areas a WHERE {INTERSECTS}", ("buildings", "areas"))
def _(t):
    a = sp.boxed(buildings(t).withColumnRenamed("geom", "g"), "a", "g")
    met = sp.box_join(a, sp.boxed(areas(t), "b"), 500.0, ("obj_id", "source_idx"))
    return met.where(sp.touching(F.col("g"), F.col("geom"))).select("source_idx", "obj_id", sp.holding(F.col("g"), F.col("geom")).alias("within"))


@query("m1_metres_degrees", "SELECT geom_id, round((lon * 100) * 1e-5 / 1.11e0, 9) AS degrees, round(lat / (1e-5 / 1.11e0), 3) AS metres FROM q_points", ("q_points",))
def _(t):
    return t("q_points").select("geom_id", r(geo.meters2degrees(F.col("lon") * 100), 9).alias("degrees"), r(geo.degrees2meters(F.col("lat"))).alias("metres"))


@query("a3_bbox_of", "SELECT round(min(lon), 7) AS min_lon, round(max(lon), 7) AS max_lon, round(min(lat), 7) AS min_lat, round(max(lat), 7) AS max_lat FROM o_points", ("o_points",))
def _(t):
    box = geo.bbox_of(t("o_points").select(geo.point(F.col("lon"), F.col("lat")).alias("geom")))
    return box.select(*[r(F.col(c), 7).alias(c) for c in box.columns])


@query("g13_bbox_shapes", "SELECT obj_id, round((min_lon + max_lon) / 2 + 1e-9, 6) AS lon, round((min_lat + max_lat) / 2 + 1e-9, 6) AS lat, 5 AS n, max_lon AS third_lon, max_lat AS second_lat, wkt FROM buildings", ("buildings",))
def _(t):
    b = geo.bbox(F.col("geom"))
    ring = geo.bbox_to_coord_list(b)
    return buildings(t).select("obj_id", nudged(geo.bbox_center(b)["lon"], 6).alias("lon"), nudged(geo.bbox_center(b)["lat"], 6).alias("lat"), F.size(ring).alias("n"), ring[2]["lon"].alias("third_lon"), ring[1]["lat"].alias("second_lat"), geo.to_wkt(geo.bbox_to_polygon(b)).alias("wkt"))


A4 = "SELECT CAST(floor(i / 1024) AS BIGINT) AS i, md5(string_agg(line, '' ORDER BY i)) AS line FROM {} GROUP BY 1"


@query("a4_hash_geoms", f""", l0 AS (SELECT i, i || ',"' || wkt || '"' || chr(10) AS line FROM (SELECT wkt, row_number() OVER (ORDER BY wkt) - 1 AS i FROM (SELECT DISTINCT wkt FROM buildings) x) y),
l1 AS ({A4.format('l0')}), l2 AS ({A4.format('l1')}), l3 AS ({A4.format('l2')}) SELECT CASE WHEN (SELECT count(*) FROM l1) <= 1 THEN (SELECT max(line) FROM l1) WHEN (SELECT count(*) FROM l2) <= 1 THEN (SELECT max(line) FROM l2) ELSE (SELECT max(line) FROM l3) END AS hash""", ("buildings",))
def _(t):
    return tb.hash_geoms(t("buildings"))


@query("h1_geom_hash", "SELECT obj_id, md5(wkt) AS hash FROM buildings", ("buildings",))
def _(t):
    return t("buildings").select("obj_id", geo.geom_hash(F.col("wkt")).alias("hash"))


@query("u2_distinct_geoms", "SELECT DISTINCT wkt FROM buildings", ("buildings",))
def _(t):
    return t("buildings").select("wkt").dropDuplicates(["wkt"])


# --- stores

LONG = ", f AS (SELECT md5(wkt) AS geom_wkt_hash, wkt AS geom_wkt, height, ground, min(obj_id) OVER (PARTITION BY wkt) AS m, obj_id FROM buildings), d AS (SELECT * FROM f WHERE m = obj_id)"


def wide(t):
    first = t("buildings").groupBy("wkt").agg(F.min_by(F.struct("height", "ground", "obj_id"), "obj_id").alias("x"))
    return first.select(F.md5("wkt").alias("geom_wkt_hash"), F.col("wkt").alias("geom_wkt"), "x.height", "x.ground", "x.obj_id")


def store(t):
    """Rows of the store: heights of all, ground of the even objects."""
    rows = tb.unpivot_features(wide(t), ["height", "ground"], ["geom_wkt_hash", "geom_wkt", "obj_id"]).where("feature_name = 'height' OR obj_id % 2 = 0")
    return rows.drop("obj_id").withColumn("modification_date", F.lit("2020-01-01 00:00:00").cast("timestamp"))


@query("a2_unpivot_features", LONG + " SELECT geom_wkt_hash, 'height' AS feature_name, height AS feature_value FROM d UNION ALL SELECT geom_wkt_hash, 'ground', ground FROM d", ("buildings",))
def _(t):
    return tb.unpivot_features(wide(t), ["height", "ground"], ["geom_wkt_hash"])


@query("a1_c3_pivot_features", LONG + " SELECT geom_wkt_hash, geom_wkt, height, CASE WHEN obj_id % 2 = 0 THEN ground END AS ground FROM d", ("buildings",))
def _(t):
    return tb.pivot_features(store(t), ["height", "ground"])


@query("c1_j9_p4_load_features", LONG + " SELECT b.obj_id AS geom_id, d.height, CASE WHEN d.obj_id % 2 = 0 THEN d.ground END AS ground FROM buildings b LEFT JOIN d ON md5(b.wkt) = d.geom_wkt_hash", ("buildings",))
def _(t):
    return tb.load_features(t("buildings").select(F.col("obj_id").alias("geom_id"), F.col("wkt").alias("geom_wkt")), store(t), ["height", "ground"])


@query("c4_s4_save_features", LONG + ", s AS (SELECT geom_wkt_hash, 'height' AS feature_name, height AS v FROM d UNION ALL SELECT geom_wkt_hash, 'ground', ground FROM d WHERE obj_id % 2 = 0), u AS (SELECT geom_wkt_hash, 'ground' AS feature_name, ground + 100 AS v FROM d) SELECT coalesce(s.geom_wkt_hash, u.geom_wkt_hash) AS geom_wkt_hash, coalesce(s.feature_name, u.feature_name) AS feature_name, CASE WHEN u.v IS NOT NULL THEN u.v ELSE s.v END AS feature_value FROM s FULL JOIN u ON s.geom_wkt_hash = u.geom_wkt_hash AND s.feature_name = u.feature_name", ("buildings",))
def _(t):
    new = wide(t).select("geom_wkt", (F.col("ground") + 100).alias("ground"))
    return tb.save_features(store(t), new, ["ground"], F.lit("2021-01-01 00:00:00").cast("timestamp")).select("geom_wkt_hash", "feature_name", "feature_value")


@query("u4_c6_missing_features", LONG + " SELECT unnest(['ground', 'slope']) AS feature_name", ("buildings",))
def _(t):
    return tb.missing_features(wide(t).select("geom_wkt"), store(t), ["height", "ground", "slope"])


@query("s4_upsert", "SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 0e0 ELSE total END AS total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) x UNION ALL SELECT c_custkey, 0e0 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    target = t("orders").groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("total"))
    updates = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(0.0).alias("total"))
    return tb.upsert(target, updates, ["o_custkey"], ["total"])


@query("s5_stage_inputs", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS geom_id FROM customer")
def _(t):
    return tb.stage_inputs(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "geom_id")


@query("s2_sql", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(t):
    frame = t("customer")
    return frame.sparkSession.sql("SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_mktsegment", customer=frame)


@query("s7_replicate_table", "SELECT obj_id, building, wkt AS way FROM buildings", ("buildings",))
def _(t):
    return tb.replicate_table(t("buildings"), "wkt", ["height", "ground", "min_lon", "min_lat", "max_lon", "max_lat"])


@query("s9_dedupe_lines", "SELECT line, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) x GROUP BY line")
def _(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return tb.dedupe_lines(lines, "line", ["doc_id"])


@query("s10_shuffle_rows", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return tb.shuffle_rows(t("orders").select("o_orderkey", "o_totalprice"), 7)


@query("s11_load_experiment", "SELECT obj_id, scores, experiment AS experiment_ts FROM scores WHERE experiment = (SELECT max(experiment) FROM scores)", ("scores",))
def _(t):
    return tb.load_experiment(t("scores").select("obj_id", "scores", F.col("experiment").alias("experiment_ts"))).select("obj_id", "scores", "experiment_ts")


@query("s12_existing_models", "SELECT DISTINCT model FROM scores", ("scores",))
def _(t):
    return tb.existing_models(t("scores"))


@query("s13_r0_pair_tiles", "SELECT vec_id, label, " + ", ".join(f"CASE WHEN isnan(embedding[{i + 1}]) OR (vec_id + {i}) % 5 = 0 THEN 1000e0 ELSE CAST(embedding[{i + 1}] AS DOUBLE) END AS f{i}" for i in range(4)) + " FROM embeddings JOIN documents ON vec_id = doc_id")
def _(t):
    images = t("documents").select(F.col("doc_id").alias("vec_id"))
    holes = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 4), lambda x, i: F.when((F.col("vec_id") + i) % 5 == 0, F.lit(float("nan"))).otherwise(x))
    feats = t("embeddings").select("vec_id", "label", holes.alias("feats"))
    return tb.pair_tiles(images, feats, "vec_id", "feats").select("vec_id", "label", *[F.col("feats")[i].alias(f"f{i}") for i in range(4)])


# --- windows, folds, sorts, samples

@query("w2_kfold", "SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS fold FROM customer")
def _(t):
    return tb.kfold(t("customer").select("c_custkey"), 7, ["c_custkey"]).select("c_custkey", "fold")


@query("w3_t1_top_percent", "SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER () AS n FROM customer) x WHERE r <= floor(n * 15 / 100)")
def _(t):
    return tb.top_percent(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 15, "c_custkey")


@query("w4_latest_version", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) x WHERE r = 1")
def _(t):
    return tb.latest_version(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("u1_union_samples", "SELECT doc_id, 1e0 AS label FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 0e0 FROM labels WHERE toxic = 0")
def _(t):
    rows = t("labels")
    return tb.union_samples(rows.where("toxic = 1").select("doc_id"), rows.where("toxic = 0").select("doc_id"))


@query("j15_expand_folds", "SELECT o_orderkey, f.fold FROM orders JOIN (SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS fold FROM customer) f ON o_custkey = c_custkey")
def _(t):
    folds = tb.kfold(t("customer").select("c_custkey"), 4, ["c_custkey"])
    return tb.expand_folds(t("orders").withColumnRenamed("o_custkey", "c_custkey"), folds, "c_custkey").select("o_orderkey", "fold")


@query("l2_negative_sampling", f"WITH n AS (SELECT 2 * count(*) AS n FROM labels WHERE toxic = 1), m AS (SELECT doc_id, row_number() OVER (ORDER BY {digest_sql(5, 'doc_id')}, doc_id) AS k FROM labels WHERE toxic = 0) SELECT doc_id, 1 AS label FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 0 FROM m, n WHERE k <= n")
def _(t):
    return tb.negative_sampling(t("labels").select("doc_id", F.col("toxic").alias("label")), 2.0, 5, "doc_id")


@query("l3_train_test_split", f"SELECT doc_id, row_number() OVER (ORDER BY {digest_sql(3, 'doc_id')}, doc_id) <= ceil(count(*) OVER () * 0.25e0) AS is_test FROM labels")
def _(t):
    return tb.train_test_split(t("labels"), 0.25, 3, "doc_id").select("doc_id", "is_test")


@query("l4_soft_labels", f"SELECT q.geom_id, round(coalesce(greatest(0e0, 1 - min({BOX_D}) / 300), 0e0), 4) AS label FROM q_points q, buildings t WHERE t.building IS NOT NULL GROUP BY q.geom_id", ("q_points", "buildings"))
def _(t):
    near = sp.nearest_object(t("q_points"), buildings(t).where(ft.BUILDING), 300.0).withColumnRenamed("dist_m", "d")
    return t("q_points").join(near, "geom_id", "left").select("geom_id", r(tb.soft_label(F.col("d"), 300.0), 4).alias("label"))


@query("sa2_sample_in_polygons", f"SELECT source_idx, i, round(min_lon + (max_lon - min_lon) * {unit_sql(12, 'source_idx', 'i')}, 6) AS lon, round(min_lat + (max_lat - min_lat) * {unit_sql(13, 'source_idx', 'i')}, 6) AS lat FROM areas, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS i) g", ("areas",))
def _(t):
    return draws.sample_in_polygons(areas(t), 7, 11, "source_idx").select("source_idx", "i", r(F.col("lon"), 6).alias("lon"), r(F.col("lat"), 6).alias("lat"))


GRID = "SELECT source_idx, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round(min_lon + ix * 5e-4, 7) AS lon, round(min_lat + iy * 5e-4, 7) AS lat FROM (SELECT *, unnest(range(CAST(ceil((max_lon - min_lon) / 5e-4) AS BIGINT))) AS ix FROM areas) x, LATERAL (SELECT unnest(range(CAST(ceil((max_lat - min_lat) / 5e-4) AS BIGINT))) AS iy) z"


@query("sa3_sa4_grid", GRID, ("areas",))
def _(t):
    return tb.grid_in_range(t("areas"), 5e-4).select("source_idx", "ix", "iy", r(F.col("lon"), 7).alias("lon"), r(F.col("lat"), 7).alias("lat"))


# --- metrics

PRF = "sum(CASE WHEN proba >= 0.5e0 THEN y ELSE 0 END)"


@query("x1_soft_prf", f", s AS (SELECT {PRF} AS b, sum(CASE WHEN proba >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS p, sum(y) AS t, count(*) AS n FROM probas) SELECT round(b / nullif(p, 0), 6) AS precision, round(b / nullif(t, 0), 6) AS recall, round(2 * (b/nullif(p,0)) * (b/nullif(t,0)) / nullif(b/nullif(p,0) + b/nullif(t,0), 0), 6) AS f_score, n FROM s", ("probas",))
def _(t):
    out = tb.soft_prf(t("probas"))
    return out.select(*[r(F.col(c), 6).alias(c) for c in ("precision", "recall", "f_score")], "n")


CURVE = ", c AS (SELECT i, coalesce(sum(CASE WHEN proba >= i * 0.005e0 THEN y END) / nullif(count(CASE WHEN proba >= i * 0.005e0 THEN 1 END), 0), 0e0) AS precision, coalesce(sum(CASE WHEN proba >= i * 0.005e0 THEN y END), 0e0) / nullif(sum(y), 0) AS recall FROM probas, (SELECT CAST(unnest(range(201)) AS INTEGER) AS i) g GROUP BY i)"


@query("x2_soft_pr_curve", CURVE + " SELECT i, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c", ("probas",))
def _(t):
    return tb.soft_pr_curve(t("probas")).select("i", r(F.col("precision"), 6).alias("precision"), r(F.col("recall"), 6).alias("recall"))


@query("x3_k3_soft_auc", CURVE + ", s AS (SELECT *, lag(recall) OVER (ORDER BY i) AS r0, lag(precision) OVER (ORDER BY i) AS p0 FROM c) SELECT round(sum((r0 - recall) * (precision + p0) / 2), 6) AS auc FROM s", ("probas",))
def _(t):
    return tb.soft_auc(tb.soft_pr_curve(t("probas"))).select(r(F.col("auc"), 6).alias("auc"))


@query("x4_pr_curves_by_model", ", m AS (SELECT CAST(doc_id % 3 AS VARCHAR) AS model, y, proba FROM probas), c AS (SELECT model, i, coalesce(sum(CASE WHEN proba >= i * 0.005e0 THEN y END) / nullif(count(CASE WHEN proba >= i * 0.005e0 THEN 1 END), 0), 0e0) AS precision, coalesce(sum(CASE WHEN proba >= i * 0.005e0 THEN y END), 0e0) / nullif(sum(y), 0) AS recall FROM m, (SELECT CAST(unnest(range(201)) AS INTEGER) AS i) g GROUP BY model, i) SELECT model, i, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c", ("probas",))
def _(t):
    rows = t("probas").withColumn("model", (F.col("doc_id") % 3).cast("string"))
    return tb.soft_pr_curve(rows, ["model"]).select("model", "i", r(F.col("precision"), 6).alias("precision"), r(F.col("recall"), 6).alias("recall"))


@query("a7_mean_score_by_model", ", m AS (SELECT obj_id % 5 AS fold, experiment AS model, scores FROM scores), f AS (SELECT model, fold, max(scores) AS auc FROM m GROUP BY model, fold) SELECT model, round(avg(auc), 6) AS auc FROM f GROUP BY model", ("scores",))
def _(t):
    folds = t("scores").groupBy(F.col("experiment").alias("model"), (F.col("obj_id") % 5).alias("fold")).agg(F.max("scores").alias("auc"))
    return su.mean_score_by_model(folds).select("model", r(F.col("auc"), 6).alias("auc"))


@query("k8_combine_folds", "SELECT obj_id % 3 AS fold, obj_id, CAST(obj_id % 2 AS DOUBLE) AS label, scores / 2 AS a, 1 - scores AS b FROM scores", ("scores",))
def _(t):
    # what fit_folds returns: every row, for every fold held out and model
    rows = t("scores").select("obj_id", (F.col("obj_id") % 3).alias("fold"), (F.col("obj_id") % 2).cast("double").alias("label"), "scores")
    tested = rows.withColumn("test_fold", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    scored = tested.select("*", F.explode(F.create_map(F.lit("a"), F.col("scores") / 2, F.lit("b"), 1 - F.col("scores"))).alias("model", "proba"))
    return ml.combine_fold_results(scored, "obj_id", ["a", "b"])[0]


@query("x5_rmse_by_head", ", v AS (SELECT experiment AS head, scores, (obj_id % 10) / 10e0 AS y FROM scores) SELECT head, round(sqrt(avg(power(scores - y, 2))), 6) AS rmse FROM v GROUP BY head", ("scores",))
def _(t):
    rows = t("scores").select(F.col("experiment").alias("head"), "scores", ((F.col("obj_id") % 10) / 10.0).alias("y"))
    return tb.rmse_by_head(rows, "head", "scores", "y").select("head", r(F.col("rmse"), 6).alias("rmse"))


@query("x7_scaled_loss", ", v AS (SELECT experiment AS head, scores, (obj_id % 10) / 10e0 AS y FROM scores) SELECT head, round(sum(abs(ln((scores + 1) / (y + 1)))), 4) AS loss FROM v GROUP BY head", ("scores",))
def _(t):
    rows = t("scores").select(F.col("experiment").alias("head"), "scores", ((F.col("obj_id") % 10) / 10.0).alias("y"))
    return rows.groupBy("head").agg(r(F.sum(tb.scaled_loss(F.col("scores"), F.col("y"))), 4).alias("loss"))


@query("x7_multihead_loss", ", v AS (SELECT experiment AS head, avg(abs(ln((scores + 1) / ((obj_id % 10) / 10e0 + 1)))) AS loss FROM scores GROUP BY experiment) SELECT round(sum(CASE WHEN head = 'exp0' THEN loss * exp(-0.5e0) + 0.5e0 ELSE 2 * loss * exp(0.25e0) - 0.25e0 END), 6) AS loss FROM v", ("scores",))
def _(t):
    losses = t("scores").groupBy(F.col("experiment").alias("head")).agg(F.avg(tb.scaled_loss(F.col("scores"), (F.col("obj_id") % 10) / 10.0)).alias("loss"))
    out = tb.multihead_loss(losses, {"exp0": 1.0, "exp1": 2.0}, {"exp0": 0.5, "exp1": -0.25})
    return out.select(r(F.col(out.columns[0]), 6).alias("loss"))


EXTREME = "(SELECT obj_id FROM v b WHERE b.head = a.head ORDER BY {}, obj_id LIMIT 1)"


@query("x8_extreme_examples", ", v AS (SELECT experiment AS head, obj_id, scores - (obj_id % 7) / 7e0 AS d, scores + (obj_id % 7) / 7e0 AS z FROM scores) SELECT head, " + ", ".join(f"{EXTREME.format(o)} AS {n}" for n, o in (("over", "d DESC"), ("under", "d"), ("high", "z DESC"), ("low", "z"))) + " FROM (SELECT DISTINCT head FROM v) a", ("scores",))
def _(t):
    rows = t("scores").select(F.col("experiment").alias("head"), "obj_id", "scores", ((F.col("obj_id") % 7) / 7.0).alias("y"))
    return tb.extreme_examples(rows, "head", "obj_id", "scores", "y")


@query("x9_embedding_sample", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 1000")
def _(t):
    return t("embeddings").select("vec_id", "label").orderBy("vec_id").limit(1000)


# --- scaling, histograms, raster, time

@query("m2_zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def _(t):
    return tb.zscore(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r(F.col("c_acctbal"), 6).alias("c_acctbal"))


@query("m3_minmax", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer")
def _(t):
    return tb.minmax(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", r(F.col("c_acctbal"), 6).alias("c_acctbal"))


@query("m4_sign_scale", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN c_acctbal / max(c_acctbal) OVER () WHEN c_acctbal < 0 THEN c_acctbal / -min(c_acctbal) OVER () ELSE 0 END / 2 + 0.5e0, 6) AS c_acctbal FROM customer")
def _(t):
    return tb.sign_scale(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", r(F.col("c_acctbal"), 6).alias("c_acctbal"))


@query("a8_score_histogram", ", s AS (SELECT min(proba) AS a, (max(proba) - min(proba)) / 20 AS w FROM probas), b AS (SELECT y, CAST(least(floor((proba - a) / w), 19) AS INTEGER) AS bin, w FROM probas, s), t AS (SELECT y, count(*) AS n FROM probas GROUP BY y) SELECT b.y, bin, round(count(*) / (max(t.n) * max(w)), 6) AS density FROM b JOIN t ON b.y = t.y GROUP BY b.y, bin", ("probas",))
def _(t):
    return tb.score_histogram(t("probas"), "y", "proba").select("y", "bin", r(F.col("density"), 6).alias("density"))


@query("b1_p8_rasterize", ", m AS (SELECT min(lon) AS x, min(lat) AS y, min(obj_id % 97) AS a, max(obj_id % 97) AS b FROM o_points), c AS (SELECT CAST(round_even((lon - x) / (250 * (1e-5 / 1.11e0)), 0) AS INTEGER) AS ix, CAST(round_even((lat - y) / (250 * (1e-5 / 1.11e0)), 0) AS INTEGER) AS iy, obj_id, (obj_id % 97 - a) / CAST(b - a AS DOUBLE) AS v FROM o_points, m) SELECT ix, iy, round(arg_max(v, obj_id), 6) AS score FROM c GROUP BY ix, iy", ("o_points",))
def _(t):
    rows = t("o_points").withColumn("score", (F.col("obj_id") % 97).cast("double"))
    return tb.rasterize(rows, "score", 250.0, "obj_id").select("ix", "iy", r(F.col("score"), 6).alias("score"))


def pixels(t):
    p = t("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return p.select("vec_id", F.expr("cast(pos div 8 as int)").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), F.col("v").cast("double").alias("value"))


PIXELS = "p AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(64)) AS i) g)"


@query("b3_image_to_tiles", f"WITH {PIXELS} SELECT vec_id, CAST(row // 3 AS INTEGER) AS tile_row, CAST(col // 3 AS INTEGER) AS tile_col, CAST(row % 3 AS INTEGER) AS in_row, CAST(col % 3 AS INTEGER) AS in_col, value FROM p WHERE row < 6 AND col < 6")
def _(t):
    return tb.image_to_tiles(pixels(t), 3, 8, 8).select("vec_id", "tile_row", "tile_col", "in_row", "in_col", "value")


@query("b3_tiles_to_image", f"WITH {PIXELS} SELECT vec_id, row, col, value FROM p")
def _(t):
    return tb.tiles_to_image(tb.image_to_tiles(pixels(t), 4, 8, 8).drop("row", "col"), 4).select("vec_id", "row", "col", "value")


@query("m5_sa7_image_entropy", f"WITH {PIXELS}, s AS (SELECT vec_id, min(value) AS a, max(value) AS b FROM p GROUP BY vec_id), h AS (SELECT p.vec_id, least(floor((value - a) * 256 / (b - a)), 255) AS bin, count(*) AS n FROM p JOIN s ON p.vec_id = s.vec_id GROUP BY 1, 2) SELECT vec_id, round(-sum(n / 64e0 * log2(n / 64e0)), 6) AS entropy FROM h GROUP BY vec_id HAVING -sum(n / 64e0 * log2(n / 64e0)) >= 5.2")
def _(t):
    return su.tile_samples(pixels(t), "vec_id", "value", 5.2).select("vec_id", r(F.col("entropy"), 6).alias("entropy"))


@query("d1_time_bucket", "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(tb.time_bucket(F.col("ts"), "hour").alias("bucket")).agg(F.count("*").alias("n"))


@query("d2_time_intervals", "SELECT user_id, f AS from_ts, least(f + INTERVAL 720 MINUTE, b) AS to_ts FROM (SELECT user_id, b, unnest(generate_series(a, b, INTERVAL 720 MINUTE)) AS f FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id) x) y WHERE f < b")
def _(t):
    spans = t("events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return tb.time_intervals(spans, "a", "b", 720).select("user_id", "from_ts", "to_ts")


@query("d3_parse_format_ts", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('second', o_orderdate) END AS ts FROM orders")
def _(t):
    text = tb.format_ts(F.col("o_orderdate"))
    return t("orders").select("o_orderkey", text.alias("text"), tb.parse_ts(F.when(F.col("o_orderkey") % 2 == 0, text).otherwise("no time")).alias("ts"))


@query("a9_heatmap_frames", "SELECT date_trunc('hour', ts) AS frame, CAST(row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY lat, lon) - 1 AS INTEGER) AS pos, round(lat, 7) AS lat, round(lon, 7) AS lon FROM events_geo", ("events_geo",))
def _(t):
    frames = su.heatmap_frames(t("events_geo"), "ts", "hour").select("frame", F.posexplode("points").alias("pos", "p"))
    return frames.select("frame", "pos", r(F.col("p.lat"), 7).alias("lat"), r(F.col("p.lon"), 7).alias("lon"))


@query("a9_heatmap_cells", "SELECT date_trunc('day', ts) AS frame, round(floor(lat / 0.01e0) * 0.01e0, 6) AS lat, round(floor(lon / 0.01e0) * 0.01e0, 6) AS lon, count(*) AS n FROM events_geo GROUP BY 1, 2, 3", ("events_geo",))
def _(t):
    cells = su.heatmap_frames(t("events_geo"), "ts", "day", 0.01).select("frame", F.explode("points").alias("p"))
    return cells.select("frame", r(F.col("p.lat"), 6).alias("lat"), r(F.col("p.lon"), 6).alias("lon"), "p.n")


from geofeat.plans import joins, learning  # noqa: E402,F401  register their queries
