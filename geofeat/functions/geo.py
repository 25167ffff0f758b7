"""Geometry as Spark columns: WKT, metres on the WGS84 ellipsoid, predicates, measures.

A geometry is ``struct<kind, parts, outer>``: parts are arrays of (lon, lat); a point
has one part of one coordinate, a line one part per line, a polygon one part per
ring, with ``outer`` telling shells from holes. Everything is a column expression:
no UDF, and null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84, and the angle that stands for a metre in plain conversions.
A, E2 = 6378137.0, 0.0066943799901413165
DEGREES_PER_METRE = 1e-5 / 1.11
GEOMETRY = "struct<kind:string,parts:array<array<struct<lon:double,lat:double>>>,outer:array<boolean>>"
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


# --- scales and distances: SQL text, so that other engines can run the same formula

def m_per_lat(lat: str) -> str:
    """Metres of one degree of latitude at ``lat``."""
    return f"(0.017453292519943295e0*{A}e0*(1e0-{E2}e0)/power(1e0-{E2}e0*power(sin(radians({lat})),2),1.5e0))"


def m_per_lon(lat: str) -> str:
    """Metres of one degree of longitude at ``lat``."""
    return f"(0.017453292519943295e0*{A}e0*cos(radians({lat}))/sqrt(1e0-{E2}e0*power(sin(radians({lat})),2)))"


def distance_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Metres between two points by the mid-latitude formula; good to 3e-7 up to 20 km."""
    mid = f"(({lat1})+({lat2}))/2e0"
    return f"sqrt(power({m_per_lat(mid)}*(({lat2})-({lat1})),2)+power({m_per_lon(mid)}*(({lon2})-({lon1})),2))"


def box_distance_sql(lon: str, lat: str, a: str, b: str, c: str, d: str) -> str:
    """Metres from a point to an upright rectangle, in the plane local to the point; 0 inside."""
    return f"sqrt(power({m_per_lon(lat)}*greatest({a}-{lon},0e0,{lon}-{c}),2)+power({m_per_lat(lat)}*greatest({b}-{lat},0e0,{lat}-{d}),2))"


def scale_lat(lat: Column) -> Column:
    return F.lit(0.017453292519943295 * A * (1 - E2)) / F.pow(1 - E2 * F.pow(F.sin(F.radians(lat)), 2), 1.5)


def scale_lon(lat: Column) -> Column:
    return F.lit(0.017453292519943295 * A) * F.cos(F.radians(lat)) / F.sqrt(1 - E2 * F.pow(F.sin(F.radians(lat)), 2))


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    mid = (lat1 + lat2) / 2
    return F.sqrt(F.pow(scale_lat(mid) * (lat2 - lat1), 2) + F.pow(scale_lon(mid) * (lon2 - lon1), 2))


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 12) -> Column:
    """Vincenty's inverse formula with a fixed number of rounds, for long distances; 0 for equal points."""
    f = 1 - (1 - E2) ** 0.5
    b = A * (1 - f)
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2)))
    far = F.radians(lon2 - lon1)

    fixed = F.struct(far.alias("far"), *[g(u).alias(f"{n}{i}") for i, u in ((1, u1), (2, u2)) for n, g in (("s", F.sin), ("c", F.cos))])

    def parts(k: Column, lam: Column, f_: callable) -> Column:
        """f_ of the terms of one round; each step binds what the next ones use more than once."""
        sines = let(F.struct(F.sin(lam).alias("s"), F.cos(lam).alias("c")), lambda t: F.struct(
            F.sqrt(F.pow(k["c2"] * t["s"], 2) + F.pow(k["c1"] * k["s2"] - k["s1"] * k["c2"] * t["c"], 2)).alias("sin_s"),
            (k["s1"] * k["s2"] + k["c1"] * k["c2"] * t["c"]).alias("cos_s"), t["s"].alias("sin_l")))
        angle = lambda t: F.struct(t["sin_s"], t["cos_s"], F.when(t["sin_s"] == 0, 0.0).otherwise(k["c1"] * k["c2"] * t["sin_l"] / F.when(t["sin_s"] != 0, t["sin_s"])).alias("sin_a"))
        square = lambda t: F.struct(t["sin_s"], t["cos_s"], t["sin_a"], (1 - t["sin_a"] * t["sin_a"]).alias("cos2"))
        middle = lambda t: F.struct(t["sin_s"], t["cos_s"], t["sin_a"], t["cos2"], F.atan2(t["sin_s"], t["cos_s"]).alias("s"), F.when(t["cos2"] == 0, 0.0).otherwise(t["cos_s"] - 2 * k["s1"] * k["s2"] / F.when(t["cos2"] != 0, t["cos2"])).alias("cos_m"))
        return let(let(let(let(sines, angle), square), middle), lambda t: f_(t["s"], t["sin_s"], t["cos_s"], t["sin_a"], t["cos2"], t["cos_m"]))

    def step(k: Column, lam: Column) -> Column:
        def moved(s, sin_s, cos_s, sin_a, cos2, cos_m):
            return let(f / 16 * cos2 * (4 + f * (4 - 3 * cos2)), lambda c: k["far"] + (1 - c) * f * sin_a * (s + c * sin_s * (cos_m + c * cos_s * (2 * cos_m * cos_m - 1))))

        return parts(k, lam, moved)

    def finish(k: Column, lam: Column) -> Column:
        def metres(s, sin_s, cos_s, _, cos2, cos_m):
            def scaled(u):
                a1 = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
                b1 = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
                d = lambda v: v * sin_s * (cos_m + v / 4 * (cos_s * (2 * cos_m * cos_m - 1) - v / 6 * cos_m * (4 * sin_s * sin_s - 3) * (4 * cos_m * cos_m - 3)))
                return b * a1 * (s - let(b1, d))

            return let(cos2 * (A * A - b * b) / (b * b), scaled)

        return parts(k, lam, metres)

    return let(fixed, lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k["far"], lambda lam, _: step(k, lam), lambda lam: finish(k, lam)))


def meters2degrees(m: Column) -> Column:
    return m * DEGREES_PER_METRE


def degrees2meters(d: Column) -> Column:
    return d / DEGREES_PER_METRE


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds (or replaces) a column that is worked out once a row, however often later steps and filters use it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


# --- construction and text

def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("POINT").alias("kind"), F.array(F.array(F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")))).alias("parts"), F.array(F.lit(True)).alias("outer"))


def line(coordinates: Column) -> Column:
    """From an array of (lon, lat) structs in order."""
    return F.struct(F.lit("LINESTRING").alias("kind"), F.array(coordinates).alias("parts"), F.array(F.lit(True)).alias("outer"))


def box(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Upright rectangle of min_lon, min_lat, max_lon, max_lat."""
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.struct(F.lit("POLYGON").alias("kind"), F.array(F.array(at(a, b), at(c, b), at(c, d), at(a, d), at(a, b))).alias("parts"), F.array(F.lit(True)).alias("outer"))


def from_wkt(wkt: Column) -> Column:
    kind = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    ring = r"(\(*)\(\s*([^()]+)\)"
    coordinate = lambda c: let(F.split(F.trim(c), r"\s+"), lambda x: F.struct(x[0].cast("double").alias("lon"), x[1].cast("double").alias("lat")))
    parts = F.transform(F.regexp_extract_all(wkt, F.lit(ring), F.lit(2)), lambda r: F.transform(F.split(r, ","), coordinate))
    outer = F.transform(F.regexp_extract_all(wkt, F.lit(ring), F.lit(1)), lambda p: (p != "") | ~kind.endswith("POLYGON"))
    return F.when(wkt.isNotNull(), F.struct(kind.alias("kind"), parts.alias("parts"), outer.alias("outer")))


def to_wkt(geom: Column, digits: int = 7) -> Column:
    number = lambda x: x.cast(f"decimal({digits + 4},{digits})").cast("string")
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda c: F.concat(number(c["lon"]), F.lit(" "), number(c["lat"]))), ", "), F.lit(")"))
    rings = F.transform(geom["parts"], ring)
    plain = F.array_join(rings, ", ")
    joined = F.array_join(F.transform(rings, lambda r, i: F.when(i == 0, r).when(F.get(geom["outer"], i), F.concat(F.lit("), ("), r)).otherwise(F.concat(F.lit(", "), r))), "")
    body = F.when(geom["kind"].isin("POINT", "LINESTRING"), plain).when(geom["kind"] == "MULTIPOLYGON", F.concat(F.lit("(("), joined, F.lit("))"))).otherwise(F.concat(F.lit("("), plain, F.lit(")")))
    return F.concat(geom["kind"], F.lit(" "), body)


def members(wkt: Column) -> Column:
    """Texts of a collection's geometries, those of collections within it too; any other text alone."""
    inner = F.regexp_extract_all(wkt, F.lit(r"[A-Za-z]+\s*\((?:[^A-Za-z]|(?<=\d)[eE])*\)"), F.lit(0))
    return F.when(F.upper(F.ltrim(wkt)).startswith("GEOMETRYCOLLECTION"), inner).otherwise(F.array(wkt))


def polygons(geom: Column) -> Column:
    """Polygons of an area, each shell with the holes that follow it."""
    n = F.size(geom["parts"])
    shells = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(geom["outer"], i - 1))
    ends = F.concat(F.slice(shells, F.lit(2), F.size(shells)), F.array(n + 1))
    cut = lambda i, j: F.struct(F.lit("POLYGON").alias("kind"), F.slice(geom["parts"], i, j - i).alias("parts"), F.slice(geom["outer"], i, j - i).alias("outer"))
    return F.zip_with(shells, ends, cut)


def of_kind(df: DataFrame, kind: str, geom: str = "geom") -> DataFrame:
    """Rows whose geometry is of one kind, such as POLYGON; null geometries are of none."""
    return df.where(F.col(f"{geom}.kind") == kind.upper())


# --- boxes

def bbox(geom: Column) -> Column:
    flat = F.flatten(geom["parts"])
    lons, lats = F.transform(flat, lambda c: c["lon"]), F.transform(flat, lambda c: c["lat"])
    return F.struct(F.array_min(lons).alias("min_lon"), F.array_max(lons).alias("max_lon"), F.array_min(lats).alias("min_lat"), F.array_max(lats).alias("max_lat"))


def is_box(geom: Column, b: Column) -> Column:
    """Whether a geometry is an upright rectangle with an inside; ``b`` is its ``bbox``. Its edges then need no test of their own."""
    ring = F.get(geom["parts"], F.lit(0))
    at = lambda i, k: F.get(ring, F.lit(i))[k]
    corners = F.forall(ring, lambda c: c["lon"].isin(b["min_lon"], b["max_lon"]) & c["lat"].isin(b["min_lat"], b["max_lat"]))
    across = [at(i, k) != at(i + 2, k) for i in (0, 1) for k in ("lon", "lat")]
    closed = (at(0, "lon") == at(4, "lon")) & (at(0, "lat") == at(4, "lat")) & ((at(0, "lon") == at(1, "lon")) != (at(0, "lat") == at(1, "lat")))
    shaped = (geom["kind"] == "POLYGON") & (F.size(geom["parts"]) == 1) & (F.size(ring) == 5)
    return F.coalesce(F.when(shaped, closed & across[0] & across[1] & across[2] & across[3] & corners), F.lit(False))


def box_gap_m(b: Column, lon: Column, lat: Column, kx: Column, ky: Column) -> Column:
    """``planar_distance_m`` of an upright rectangle (its ``bbox``)."""
    x, y = F.greatest(b["min_lon"] - lon, F.lit(0.0), lon - b["max_lon"]) * kx, F.greatest(b["min_lat"] - lat, F.lit(0.0), lat - b["max_lat"]) * ky
    return F.sqrt(x * x + y * y)


def bbox_center(b: Column) -> Column:
    return F.struct(((b["min_lon"] + b["max_lon"]) / 2).alias("lon"), ((b["min_lat"] + b["max_lat"]) / 2).alias("lat"))


def bbox_to_polygon(b: Column) -> Column:
    return box(b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"])


def bbox_to_coord_list(b: Column) -> Column:
    """Corners (lon, lat) of the box, from the south-west by way of the north-west, closed."""
    corners = ((w, n) for w, n in (("min_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "max_lat"), ("max_lon", "min_lat"), ("min_lon", "min_lat")))
    return F.array(*[F.struct(b[w].alias("lon"), b[n].alias("lat")) for w, n in corners])


def bbox_of(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row: the box around all geometries; nulls without any."""
    b = bbox(F.col(geom))
    return df.select(b.alias("_b")).agg(*[(F.min if n.startswith("min") else F.max)(f"_b.{n}").alias(n) for n in ("min_lon", "max_lon", "min_lat", "max_lat")])


def rect(lon: Column, lat: Column, w: Column, h: Column) -> Column:
    """Rectangle around a coordinate; ``w`` spans latitude and ``h`` longitude."""
    return box(lon - h / 2, lat - w / 2, lon + h / 2, lat + w / 2)


def tile_extent(lon: Column, lat: Column, radius_m: Column) -> Column:
    """Box whose sides lie ``radius_m`` from the centre."""
    dy, dx = radius_m / scale_lat(lat), radius_m / scale_lon(lat)
    return F.struct((lon - dx).alias("min_lon"), (lon + dx).alias("max_lon"), (lat - dy).alias("min_lat"), (lat + dy).alias("max_lat"))


# --- segments

def _segments(ring: Column, f) -> Column:
    """f(a, b) for each pair of neighbouring coordinates; null for a single one."""
    n = F.size(ring)
    return F.when(n > 1, F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), f))


def segments(geom: Column) -> Column:
    """Edges (a, b) of all parts; a part of one coordinate is an edge from it to itself."""
    edge = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return F.flatten(F.transform(geom["parts"], lambda r: F.coalesce(_segments(r, edge), F.transform(r, lambda c: edge(c, c)))))


def _areal(geom: Column) -> Column:
    return geom["kind"].endswith("POLYGON")


def length_m(geom: Column) -> Column:
    """Length of lines; 0 for points and areas."""
    total = lambda r: F.aggregate(F.coalesce(_segments(r, lambda a, b: distance_m(a["lon"], a["lat"], b["lon"], b["lat"])), F.array(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(geom["kind"].endswith("LINESTRING"), F.aggregate(F.transform(geom["parts"], total), F.lit(0.0), lambda s, x: s + x)).otherwise(F.when(geom.isNotNull(), F.lit(0.0)))


def authalic_sql(lat: str) -> str:
    """Ordinate of the equal-area cylindrical projection, in square metres per radian of longitude."""
    e = E2**0.5
    s = f"sin(radians({lat}))"
    return f"({A * A / 2 * (1 - E2)}e0*({s}/(1e0-{E2}e0*{s}*{s})+ln((1e0+{e}e0*{s})/(1e0-{e}e0*{s}))/{2 * e}e0))"


def _authalic(lat: Column) -> Column:
    e, s = E2**0.5, F.sin(F.radians(lat))
    return F.lit(A * A / 2 * (1 - E2)) * (s / (1 - E2 * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e))


def area_m2(geom: Column) -> Column:
    """Ellipsoidal area with holes taken out; 0 for points and lines."""
    ring = lambda r: F.abs(F.aggregate(F.coalesce(_segments(r, lambda a, b: F.radians(b["lon"] - a["lon"]) * (_authalic(a["lat"]) + _authalic(b["lat"])) / 2), F.array(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x))
    signed = F.zip_with(F.transform(geom["parts"], ring), geom["outer"], lambda a, o: F.when(o, a).otherwise(-a))
    return F.when(_areal(geom), F.aggregate(signed, F.lit(0.0), lambda s, x: s + x)).otherwise(F.when(geom.isNotNull(), F.lit(0.0)))


def _ring_test(geom: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Whether a point is inside the rings by the even-odd rule, and whether it lies on an edge."""

    def crosses(a: Column, b: Column) -> Column:
        span = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(span & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0)

    def touches(a: Column, b: Column) -> Column:
        cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        inside = lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        return (F.abs(cross) < 1e-15) & inside

    crossings = F.flatten(F.transform(geom["parts"], lambda r: F.coalesce(_segments(r, crosses), F.array().cast("array<int>"))))
    edges = F.flatten(F.transform(geom["parts"], lambda r: F.coalesce(_segments(r, touches), F.array().cast("array<boolean>"))))
    return F.aggregate(crossings, F.lit(0), lambda s, x: s + x) % 2 == 1, F.exists(edges, lambda x: x)


def st_covers_point(geom: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against the rings of an area; points on an edge count as inside."""
    odd, touches = _ring_test(geom, lon, lat)
    return _areal(geom) & (odd | touches)


def _strictly_covers(geom: Column, lon: Column, lat: Column) -> Column:
    odd, touches = _ring_test(geom, lon, lat)
    return _areal(geom) & odd & ~touches


def _closest_on(lon: Column, lat: Column, a: Column, b: Column) -> Column:
    """(d2, lon, lat) of the point of a segment that is closest to a point, in the plane local to the point."""
    kx, ky = scale_lon(lat), scale_lat(lat)
    ax, ay, bx, by = (a["lon"] - lon) * kx, (a["lat"] - lat) * ky, (b["lon"] - lon) * kx, (b["lat"] - lat) * ky
    long2 = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.when(long2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * (bx - ax) + ay * (by - ay)) / F.when(long2 != 0, long2))))
    return F.struct((F.pow(ax + t * (bx - ax), 2) + F.pow(ay + t * (by - ay), 2)).alias("d2"), (a["lon"] + t * (b["lon"] - a["lon"])).alias("lon"), (a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"))


def closest_point(geom: Column, lon: Column, lat: Column) -> Column:
    """(d2, lon, lat): the point of a geometry's points and edges that is closest to a point."""
    one = lambda r: F.coalesce(_segments(r, lambda a, b: _closest_on(lon, lat, a, b)), F.transform(r, lambda c: _closest_on(lon, lat, c, c)))
    return F.array_min(F.flatten(F.transform(geom["parts"], one)))


def closest_point_to(a: Column, b: Column) -> Column:
    """(d2, lon, lat): the point of ``a`` that is nearest to the geometry ``b``, for two which do not cross."""
    seen = F.transform(F.flatten(b["parts"]), lambda c: closest_point(a, c["lon"], c["lat"]))
    own = F.transform(F.flatten(a["parts"]), lambda c: F.struct(closest_point(b, c["lon"], c["lat"])["d2"].alias("d2"), c["lon"].alias("lon"), c["lat"].alias("lat")))
    return F.array_min(F.concat(F.transform(seen, lambda c: F.struct(c["d2"].alias("d2"), c["lon"].alias("lon"), c["lat"].alias("lat"))), own))


def distances_to_geo(df: DataFrame, geom: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``dist_m`` from points to a geometry; a line is an error, as only points and areas are measured."""
    known = F.when(geom["kind"].isin("POINT", "POLYGON", "MULTIPOLYGON"), geom).otherwise(F.raise_error(F.concat(F.lit("no distance to a "), geom["kind"])).cast(GEOMETRY))
    at = F.get(F.get("_g.parts", F.lit(0)), F.lit(0))
    return df.withColumn("_g", F.when(geom.isNotNull(), known)).withColumn("dist_m", F.when(F.col("_g.kind") == "POINT", distance_m(F.col(lon), F.col(lat), at["lon"], at["lat"])).otherwise(point_distance_m(F.col("_g"), F.col(lon), F.col(lat)))).drop("_g")


def distances_to_point(df: DataFrame, lon: Column, lat: Column, geom: str = "geom") -> DataFrame:
    """Adds ``dist_m`` from a point to geometries; a line is an error. Null geometries have no distance."""
    return distances_to_geo(df.withColumns({"_lon": lon, "_lat": lat}), F.col(geom), "_lon", "_lat").drop("_lon", "_lat")


def planar_distance_m(geom: Column, lon: Column, lat: Column, kx: Column, ky: Column) -> Column:
    """``point_distance_m`` with the point's scales given as columns (``scale_lon``, ``scale_lat``), which then are not worked out for every edge."""
    edge = lambda a, b: F.struct(((a["lon"] - lon) * kx).alias("x"), ((a["lat"] - lat) * ky).alias("y"), ((b["lon"] - lon) * kx).alias("x2"), ((b["lat"] - lat) * ky).alias("y2"))
    ring = lambda r: F.coalesce(_segments(r, edge), F.transform(r, lambda c: edge(c, c)))
    # one step binds what the next one uses more than once
    step = F.transform(F.flatten(F.transform(geom["parts"], ring)), lambda e: F.struct(e["x"], e["y"], (e["x2"] - e["x"]).alias("u"), (e["y2"] - e["y"]).alias("v")))
    step = F.transform(step, lambda e: F.struct(e["x"], e["y"], e["u"], e["v"], (e["u"] * e["u"] + e["v"] * e["v"]).alias("n")))
    part = lambda e: F.when(e["n"] == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(e["x"] * e["u"] + e["y"] * e["v"]) / F.when(e["n"] != 0, e["n"]))))
    step = F.transform(step, lambda e: F.struct(e["x"], e["y"], e["u"], e["v"], part(e).alias("t")))
    step = F.transform(step, lambda e: F.struct((e["x"] + e["t"] * e["u"]).alias("x"), (e["y"] + e["t"] * e["v"]).alias("y")))
    d2 = F.array_min(F.transform(step, lambda e: e["x"] * e["x"] + e["y"] * e["y"]))
    return F.when(st_covers_point(geom, lon, lat), F.lit(0.0)).otherwise(F.sqrt(d2))


def point_distance_m(geom: Column, lon: Column, lat: Column) -> Column:
    """Metres from a point to a geometry; 0 inside an area."""
    return F.when(st_covers_point(geom, lon, lat), F.lit(0.0)).otherwise(F.sqrt(closest_point(geom, lon, lat)["d2"]))


def st_intersects(g: Column, h: Column) -> Column:
    """Whether two geometries share a point: a vertex of one lies in the other, or edges cross."""
    side = lambda a, b, c: (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])
    apart = lambda s, t: (F.greatest(s["a"]["lon"], s["b"]["lon"]) < F.least(t["a"]["lon"], t["b"]["lon"])) | (F.greatest(t["a"]["lon"], t["b"]["lon"]) < F.least(s["a"]["lon"], s["b"]["lon"])) | (F.greatest(s["a"]["lat"], s["b"]["lat"]) < F.least(t["a"]["lat"], t["b"]["lat"])) | (F.greatest(t["a"]["lat"], t["b"]["lat"]) < F.least(s["a"]["lat"], s["b"]["lat"]))
    cross = lambda s, t: ~apart(s, t) & (side(s["a"], s["b"], t["a"]) * side(s["a"], s["b"], t["b"]) <= 0) & (side(t["a"], t["b"], s["a"]) * side(t["a"], t["b"], s["b"]) <= 0)
    first = lambda x: x["parts"][0][0]
    return F.exists(segments(g), lambda s: F.exists(segments(h), lambda t: cross(s, t))) | st_covers_point(g, first(h)["lon"], first(h)["lat"]) | st_covers_point(h, first(g)["lon"], first(g)["lat"])


def st_within(g: Column, h: Column) -> Column:
    """Whether the area ``h`` covers ``g``, be it concave or with holes.

    The vertices and the middles of the edges of ``g`` lie in ``h``, no edges of the two cross, and no
    boundary of ``h`` starts inside ``g``. What is left out: an edge which leaves ``h`` and comes back through
    vertices of ``h`` exactly, with its middle inside.
    """
    side = lambda a, b, c: (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])
    cross = lambda s, t: (side(s["a"], s["b"], t["a"]) * side(s["a"], s["b"], t["b"]) < 0) & (side(t["a"], t["b"], s["a"]) * side(t["a"], t["b"], s["b"]) < 0)
    corners = F.forall(F.flatten(g["parts"]), lambda c: st_covers_point(h, c["lon"], c["lat"]))
    middles = F.forall(segments(g), lambda s: st_covers_point(h, (s["a"]["lon"] + s["b"]["lon"]) / 2, (s["a"]["lat"] + s["b"]["lat"]) / 2))
    apart = ~F.exists(segments(g), lambda s: F.exists(segments(h), lambda t: cross(s, t)))
    return corners & middles & apart & ~F.exists(F.flatten(h["parts"]), lambda c: _strictly_covers(g, c["lon"], c["lat"]))


def centroid(geom: Column) -> Column:
    """(lon, lat): a point itself, the mean of a line's vertices, the centre of an area over all its parts, holes taken out."""
    flat = F.flatten(geom["parts"])
    o = geom["parts"][0][0]
    mean = lambda k: F.aggregate(flat, F.lit(0.0), lambda s, c: s + c[k]) / F.size(flat)
    twice = lambda a, b: (a["lon"] - o["lon"]) * (b["lat"] - o["lat"]) - (b["lon"] - o["lon"]) * (a["lat"] - o["lat"])
    total = lambda values: F.aggregate(F.coalesce(values, F.array(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    def moment(k: str) -> Column:
        ring = lambda r: F.struct(total(_segments(r, twice)).alias("area"), total(_segments(r, lambda a, b: twice(a, b) * (a[k] + b[k] - 2 * o[k]))).alias("moment"))
        # shells count for, holes against, whichever way round their vertices go
        signed = F.zip_with(F.transform(geom["parts"], ring), geom["outer"], lambda r, outer: F.struct(*[(r[x] * F.signum(r["area"]) * F.when(outer, 1.0).otherwise(-1.0)).alias(x) for x in ("area", "moment")]))
        area, first = (F.aggregate(F.transform(signed, lambda r: r[x]), F.lit(0.0), lambda s, v: s + v) for x in ("area", "moment"))  # noqa: B023
        return F.when(area != 0, o[k] + first / (3 * area)).otherwise(mean(k))

    return F.struct(*[F.when(_areal(geom), moment(k)).otherwise(mean(k)).alias(k) for k in ("lon", "lat")])


def geohash(lon: Column, lat: Column, n: int = 8) -> Column:
    """Base-32 key of interleaved bits of longitude and latitude."""
    bits_lon, bits_lat = (5 * n + 1) // 2, 5 * n // 2
    x = F.floor((lon + 180) / 360 * (1 << bits_lon)).cast("long")
    y = F.floor((lat + 90) / 180 * (1 << bits_lat)).cast("long")

    def digit(k: int) -> Column:
        value = F.lit(0).cast("long")
        for j in range(5):
            i = 5 * k + j  # even bits are longitude
            bit = F.shiftright(x, bits_lon - 1 - i // 2) if i % 2 == 0 else F.shiftright(y, bits_lat - 1 - i // 2)
            value = value * 2 + bit.bitwiseAND(F.lit(1))
        return F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1))

    return F.concat(*[digit(k) for k in range(n)])


def geom_hash(wkt: Column) -> Column:
    return F.md5(wkt)
