"""Spatial joins and lookups as equi-joins on grid cells.

A theta join on distance would be a nested loop. Here both sides get the cells of a
grid whose rows are as high as the search radius and whose columns are as wide at
the row's latitude; inputs are copied to the cells within reach, the join is an
equi-join on the cell, and the exact distance is a residual filter. Spark deals
cells out by hash, and splits hot ones at run time. Inputs near the line of 180 degrees also
look from the other side of it (``_both_ways``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import tables as tb
from geofeat.sources.shared import written

#: Metres of a degree of latitude at least, so that a cell row is never lower than the radius.
MIN_M_PER_LAT, MIN_M_PER_LON = 110_500.0, 111_300.0


def _row(lat: Column, radius: float) -> Column:
    return F.floor(lat * (MIN_M_PER_LAT / radius)).cast("long")


def _columns_per_degree(row: Column, radius: float) -> Column:
    """Cells per degree of longitude in a row, by its latitude that is farthest from the equator."""
    far = F.least(F.lit(89.0), F.greatest(F.abs(row), F.abs(row + 1)) * (radius / MIN_M_PER_LAT))
    return F.cos(F.radians(far)) * (MIN_M_PER_LON / radius)


def _column(lon: Column, row: Column, radius: float) -> Column:
    return F.floor(lon * _columns_per_degree(row, radius)).cast("long")


def _with_cells(df: DataFrame, a: Column, b: Column, c: Column, d: Column, radius: float, reach: int) -> DataFrame:
    """A row per cell of the box a, b, c, d, grown by ``reach`` cells on each side."""
    rows = df.withColumn("gy", F.explode(F.sequence(_row(b, radius) - reach, _row(d, radius) + reach)))
    return rows.withColumn("gx", F.explode(F.sequence(_column(a, F.col("gy"), radius) - reach, _column(c, F.col("gy"), radius) + reach)))


def _up(radius: float) -> float:
    """Degrees of latitude that cover the radius anywhere."""
    return (radius + 1e-6) / MIN_M_PER_LAT


def _aside(lat: Column, radius: float) -> Column:
    """Degrees of longitude that cover the radius around a latitude."""
    return (radius + 1e-6) / MIN_M_PER_LON / F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat) + _up(radius))))


def _both_ways(points: DataFrame) -> DataFrame:
    """Points (q_lon, _aside) with ``_lon``: as they are, and those within reach of the line of 180 degrees once more, a turn away.

    ``_alt`` is the longitude of the other copy, if there are two; ``_copy`` marks the second.
    """
    lon = F.col("q_lon")
    turn = F.when(180 - F.abs(lon) <= F.col("_aside"), F.when(lon < 0, lon + 360).otherwise(lon - 360))
    seen = F.when(turn.isNull(), F.array(F.struct(lon.alias("lon"), turn.alias("alt")))).otherwise(F.array(F.struct(lon.alias("lon"), turn.alias("alt")), F.struct(turn.alias("lon"), lon.alias("alt"))))
    return points.select("*", F.explode(seen).alias("_seen")).select("*", F.col("_seen.lon").alias("_lon"), F.col("_seen.alt").alias("_alt"), (F.col("_seen.lon") != lon).alias("_copy")).drop("_seen")


def _near(q: DataFrame, t: DataFrame, radius: float) -> DataFrame:
    """``dwithin_points`` with ``_lon``, the longitude from which the pair was seen."""
    points = _both_ways(q.withColumnsRenamed({"lon": "q_lon", "lat": "q_lat"}).withColumn("_aside", _aside(F.col("q_lat"), radius)))
    left = _with_cells(points, F.col("_lon"), F.col("q_lat"), F.col("_lon"), F.col("q_lat"), radius, 1)
    right = t.withColumnsRenamed({"lon": "t_lon", "lat": "t_lat"}).withColumn("gy", _row(F.col("t_lat"), radius)).withColumn("gx", _column(F.col("t_lon"), F.col("gy"), radius))
    dist, apart = geo.distance_m(F.col("_lon"), F.col("q_lat"), F.col("t_lon"), F.col("t_lat")), F.col("t_lon") - F.col("_lon")
    # the shorter way round counts, so a pair is seen from one of two copies
    near = (F.abs(F.col("t_lat") - F.col("q_lat")) <= _up(radius)) & (F.abs(apart) <= F.col("_aside")) & (apart > -180) & (apart <= 180)
    return left.hint("merge").join(right, ["gy", "gx"]).where(near).withColumn("dist_m", dist).where(F.col("dist_m") <= radius).drop("gy", "gx", "_aside", "_alt", "_copy")


def dwithin_points(q: DataFrame, t: DataFrame, radius: float) -> DataFrame:
    """All pairs of points (lon, lat) within ``radius`` metres, inclusive, with ``dist_m``; the sides' other columns must differ."""
    return _near(q, t, radius).drop("_lon")


def dwithin_objects(q: DataFrame, t: DataFrame, radius: float, key: tuple[str, str] = ("geom_id", "obj_id")) -> DataFrame:
    """Points (lon, lat) and objects (geom) within ``radius`` metres; radius 0: the object covers the point.

    An object of several cells can meet a point in several of those around it. Of
    these, one counts: the first column of the first row in which they meet. So pairs
    come up once, and no shuffle has to make them distinct. ``key`` names the columns
    that tell rows apart. Upright rectangles that are small beside the radius go by their
    boxes alone (``_dwithin_boxes``).
    """
    boxed = geo.bound(t, "_box", geo.bbox(F.col("geom")))
    boxed = geo.bound(boxed, "_rect", geo.is_box(F.col("geom"), F.col("_box")))
    if not radius:
        return _dwithin_any(q, boxed, radius)
    half = _half()
    small = F.col("_rect") & (half <= max(radius, 50.0) / 4)
    seen = boxed.agg(F.max(F.when(small, half)).alias("half"), F.count(F.when(~F.coalesce(small, F.lit(False)), 1)).alias("others")).first()
    if seen.half is None:
        return _dwithin_any(q, boxed, radius)
    met = _dwithin_boxes(q, boxed.where(small), radius, seen.half)
    return met.unionByName(_dwithin_any(q, boxed.where(~F.coalesce(small, F.lit(False))), radius)) if seen.others else met


def _half() -> Column:
    """Metres from the middle of a ``_box`` to its corners, at most."""
    wide, high = F.col("_box.max_lon") - F.col("_box.min_lon"), F.col("_box.max_lat") - F.col("_box.min_lat")
    return F.sqrt(wide * wide + high * high) * (111_700.0 / 2)


def _dwithin_boxes(q: DataFrame, boxed: DataFrame, radius: float, half: float) -> DataFrame:
    """``dwithin_objects`` of rectangles (``_box``) whose corners are within ``half`` metres of their middles.

    A rectangle stands in the one cell of its middle, so pairs come up once without a test of the cell, and all that is
    worked out of a pair is arithmetic on flat columns; no shape is moved.
    """
    cell = (radius + half) * 1.001 + 0.01
    points = _both_ways(q.withColumnsRenamed({"lon": "q_lon", "lat": "q_lat"}).withColumn("_aside", _aside(F.col("q_lat"), cell)))
    left = _with_cells(points.withColumns({"_kx": geo.scale_lon(F.col("q_lat")), "_ky": geo.scale_lat(F.col("q_lat"))}), F.col("_lon"), F.col("q_lat"), F.col("_lon"), F.col("q_lat"), cell, 1)
    sides = {"_west": "min_lon", "_south": "min_lat", "_east": "max_lon", "_north": "max_lat"}
    flat = boxed.withColumns({n: F.col(f"_box.{k}") for n, k in sides.items()}).drop("_box", "_rect")
    flat = flat.withColumns({"_x": (F.col("_west") + F.col("_east")) / 2, "gy": _row((F.col("_south") + F.col("_north")) / 2, cell)})
    right = flat.withColumn("gx", _column(F.col("_x"), F.col("gy"), cell))
    x = F.greatest(F.col("_west") - F.col("_lon"), F.lit(0.0), F.col("_lon") - F.col("_east")) * F.col("_kx")
    y = F.greatest(F.col("_south") - F.col("q_lat"), F.lit(0.0), F.col("q_lat") - F.col("_north")) * F.col("_ky")
    apart = F.col("_x") - F.col("_lon")  # the shorter way round counts, so a pair is seen from one of two copies
    met = left.hint("merge").join(right, ["gy", "gx"]).where((F.abs(y) <= radius) & (F.abs(x) <= radius) & (apart > -180) & (apart <= 180))
    return met.withColumn("dist_m", F.sqrt(x * x + y * y)).where(F.col("dist_m") <= radius).drop("gy", "gx", "_aside", "_kx", "_ky", "_lon", "_alt", "_copy", "_x", *sides)


def _dwithin_any(q: DataFrame, boxed: DataFrame, radius: float) -> DataFrame:
    """``dwithin_objects`` of shapes of any kind and size, with their ``_box`` and ``_rect``."""
    cell, reach = max(radius, 50.0), 1 if radius else 0
    turns = range(reach, -reach - 1, -1)
    # what depends on one side alone is worked out before the join
    points = _both_ways(q.withColumnsRenamed({"lon": "q_lon", "lat": "q_lat"}).withColumn("_aside", _aside(F.col("q_lat"), radius))).withColumn("_row", _row(F.col("q_lat"), cell))
    scales = {f"_scale{d + 1}": _columns_per_degree(F.col("_row") + d, cell) for d in turns}
    left = _with_cells(points.withColumns(scales | {"_kx": geo.scale_lon(F.col("q_lat")), "_ky": geo.scale_lat(F.col("q_lat"))}), F.col("_lon"), F.col("q_lat"), F.col("_lon"), F.col("q_lat"), cell, reach)
    boxed = boxed.withColumns({"_low": _row(F.col("_box.min_lat"), cell), "_high": _row(F.col("_box.max_lat"), cell)})
    right = _with_cells(boxed, F.col("_box.min_lon"), F.col("_box.min_lat"), F.col("_box.max_lon"), F.col("_box.max_lat"), cell, 0)

    west, east, at = F.col("_box.min_lon"), F.col("_box.max_lon"), lambda lon, d: F.floor(lon * F.col(f"_scale{d + 1}"))
    first, column = F.lit(None).cast("long"), F.lit(None).cast("long")
    for d in turns:  # the lowest row is asked last and wins
        row = F.col("_row") + d
        meets = row.between(F.col("_low"), F.col("_high")) & (at(west, d) <= at(F.col("_lon"), d) + reach) & (at(east, d) >= at(F.col("_lon"), d) - reach)
        first, column = F.when(meets, row).otherwise(first), F.when(meets, F.greatest(at(F.col("_lon"), d) - reach, at(west, d))).otherwise(column)
    # cheaper than the distance: the box grown by the radius, at the latitude where a degree is shortest
    beside = lambda lon: lon.between(west - F.col("_aside"), east + F.col("_aside"))
    near = F.col("q_lat").between(F.col("_box.min_lat") - _up(radius), F.col("_box.max_lat") + _up(radius)) & beside(F.col("_lon"))
    once = (F.col("gy") == first) & (F.col("gx") == column)
    place = lambda lon: (F.col(lon), F.col("q_lat"), F.col("_kx"), F.col("_ky"))
    to = lambda lon: F.when(F.col("_rect"), geo.box_gap_m(F.col("_box"), *place(lon))).otherwise(geo.planar_distance_m(F.col("geom"), *place(lon)))
    other = F.when(F.col("_alt").isNotNull() & beside(F.col("_alt")), to("_alt"))
    met = left.hint("merge").join(right, ["gy", "gx"]).where(near & once)
    # a filter on a generated column stays above it, so that the distance is worked out once
    found = met.select("*", F.explode(F.array(to("_lon"))).alias("_own")).where(F.col("_own") <= radius)
    # an object on both sides of the line: the point as it is answers for both copies
    found = found.where(~(F.col("_copy") & F.coalesce(other <= radius, F.lit(False))))
    dist = F.when(F.col("_alt").isNull(), F.col("_own")).otherwise(F.least(F.col("_own"), other))
    return found.withColumn("dist_m", dist).drop("gy", "gx", "_box", "_rect", "_row", "_low", "_high", "_aside", "_kx", "_ky", "_lon", "_alt", "_copy", "_own", *scales)


def _pieces(df: DataFrame, key: str, length: float, side: str) -> DataFrame:
    """Every edge of the shapes (key, geom), cut into pieces of ``length`` metres at most: ends, and the middle as lon, lat."""
    edges = df.select(key, F.xxhash64("geom.kind", "geom.parts").alias(f"_{side}_shape"), F.explode(geo.segments(F.col("geom"))).alias("_e"))
    a, b = F.col("_e.a"), F.col("_e.b")
    n = F.greatest(F.lit(1), F.ceil(geo.distance_m(a["lon"], a["lat"], b["lon"], b["lat"]) / length).cast("int"))
    cut = edges.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    end = lambda k, i: F.when(i == F.col("_n"), b[k]).otherwise(a[k] + (b[k] - a[k]) * (i / F.col("_n")))
    out = cut.select(key, f"_{side}_shape", *[end(k, F.col("_i") + j).alias(f"_{side}{k}{j}") for j in (0, 1) for k in ("lon", "lat")])
    half = geo.distance_m(F.col(f"_{side}lon0"), F.col(f"_{side}lat0"), F.col(f"_{side}lon1"), F.col(f"_{side}lat1")) / 2
    return out.select("*", half.alias(f"_{side}half"), *[((F.col(f"_{side}{k}0") + F.col(f"_{side}{k}1")) / 2).alias(k) for k in ("lon", "lat")])


def _segment_gap(pairs: DataFrame) -> DataFrame:
    """Adds ``_gap``, the distance of two segments in a plane: _q0x .. _q1y and _t0x .. _t1y.

    It goes by small steps, each a projection of its own, because one large
    expression makes a method that the JVM does not compile.
    """
    c = {n: F.col(f"_{n}") for n in ("q0x", "q0y", "q1x", "q1y", "t0x", "t0y", "t1x", "t1y")}
    step = pairs.select("*", (c["q1x"] - c["q0x"]).alias("_qu"), (c["q1y"] - c["q0y"]).alias("_qv"), (c["t1x"] - c["t0x"]).alias("_tu"), (c["t1y"] - c["t0y"]).alias("_tv"))
    u, v = ({k: F.col(f"_{k}{x}") for k in "qt"} for x in "uv")
    step = step.select("*", *[F.greatest(u[k] * u[k] + v[k] * v[k], F.lit(1e-300)).alias(f"_{k}n") for k in "qt"])
    ends = [("q", "t", j) for j in (0, 1)] + [("t", "q", j) for j in (0, 1)]  # an end of the first beside the second
    x = lambda k, j: (F.col(f"_{k}{j}x"), F.col(f"_{k}{j}y"))
    off = lambda k, o, j: (x(k, j)[0] - x(o, 0)[0], x(k, j)[1] - x(o, 0)[1])
    step = step.select("*", *[((off(k, o, j)[0] * u[o] + off(k, o, j)[1] * v[o]) / F.col(f"_{o}n")).alias(f"_{k}{j}at") for k, o, j in ends])
    step = step.select("*", *[(off(k, o, j)[1] * u[o] - off(k, o, j)[0] * v[o]).alias(f"_{k}{j}side") for k, o, j in ends])
    at = lambda k, j: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"_{k}{j}at")))
    for k, o, j in ends:
        step = step.select("*", (off(k, o, j)[0] - at(k, j) * u[o]).alias(f"_{k}{j}dx"), (off(k, o, j)[1] - at(k, j) * v[o]).alias(f"_{k}{j}dy"))
    for k, o, j in ends:
        step = step.select("*", (F.col(f"_{k}{j}dx") * F.col(f"_{k}{j}dx") + F.col(f"_{k}{j}dy") * F.col(f"_{k}{j}dy")).alias(f"_{k}{j}d2"))
    cross = (F.col("_q0side") * F.col("_q1side") < 0) & (F.col("_t0side") * F.col("_t1side") < 0)
    return step.select(*pairs.columns, F.when(cross, 0.0).otherwise(F.sqrt(F.least(*[F.col(f"_{k}{j}d2") for k, _, j in ends]))).alias("_gap"))


def _inside(areas: DataFrame, key: str, shapes: DataFrame, other: str) -> DataFrame:
    """Keys of areas and of shapes which have a part that starts in the area."""
    starts = shapes.select(*shapes.drop("geom").columns, F.explode(F.transform("geom.parts", lambda p: p[0])).alias("_v"))
    points = starts.select("*", F.col("_v.lon").alias("a_min_lon"), F.col("_v.lat").alias("a_min_lat"), F.col("_v.lon").alias("a_max_lon"), F.col("_v.lat").alias("a_max_lat")).drop("_v")
    met = box_join(points, boxed(areas.where(F.col("geom.kind").endswith("POLYGON")), "b"), 500.0, (other, key))
    return met.where(geo.st_covers_point(F.col("geom"), F.col("a_min_lon"), F.col("a_min_lat"))).select(key, other, "_q_shape", "_t_shape")


def dwithin_shapes(q: DataFrame, t: DataFrame, radius: float, key: tuple[str, str] = ("geom_id", "obj_id")) -> DataFrame:
    """Pairs of shapes of any kind (key, geom) within ``radius`` metres: both keys, ``dist_m`` and ``same_geom``.

    The distance is that of the closest edges, in the plane local to the input's piece, and 0
    where edges cross or one shape starts in the other's area. Both sides are cut
    into pieces of a quarter of the radius at most; the middles of two near pieces are within 5/4 of it,
    so a piece of ``q`` looks into nine cells of that size, one of ``t`` stands in one, and
    no two pieces meet twice, however many cells their shapes cover. Pieces whose own
    lengths do not bridge the gap of their middles go before distances are worked out. The least
    distance of a pair is taken with partial sums; shapes themselves are never copied or shuffled
    but for the test of starts in areas. Null shapes have no pairs.
    """
    a, b = key
    length = max(radius / 4, 25.0)
    q, t = q.where(F.col("geom").isNotNull()).select(a, "geom"), t.where(F.col("geom").isNotNull()).select(b, "geom")
    left = _pieces(q, a, length, "q").withColumns({"_kx": geo.scale_lon(F.col("lat")), "_ky": geo.scale_lat(F.col("lat"))})
    met = _near(left, _pieces(t, b, length, "t"), 1.001 * (radius + length) + 0.01)
    met = met.where(F.col("dist_m") <= (radius + F.col("_qhalf") + F.col("_thalf")) * 1.001 + 0.01)
    turn = F.col("_lon") - F.col("q_lon")  # of a copy seen from beyond the line of 180 degrees
    plane = lambda side, j, shift: ((F.col(f"_{side}lon{j}") + shift - F.col("_lon")) * F.col("_kx"), (F.col(f"_{side}lat{j}") - F.col("q_lat")) * F.col("_ky"))
    ends = {f"_{side}{j}{k}": v for side, shift in (("q", turn), ("t", F.lit(0.0))) for j in (0, 1) for k, v in zip("xy", plane(side, j, shift))}
    met = met.select(a, b, "_q_shape", "_t_shape", *[v.alias(n) for n, v in ends.items()])
    # a filter on a generated column stays above it, so that the distance is worked out once
    apart = _segment_gap(met).select(a, b, "_q_shape", "_t_shape", F.explode(F.array("_gap")).alias("dist_m")).where(F.col("dist_m") <= radius + 1e-7)
    marked = lambda df, side: df.withColumn(f"_{side}_shape", F.xxhash64("geom.kind", "geom.parts"))
    held = _inside(marked(q, "q"), a, marked(t, "t"), b).unionByName(_inside(marked(t, "t"), b, marked(q, "q"), a)).withColumn("dist_m", F.lit(0.0))
    both = apart.unionByName(held)
    return both.groupBy(a, b).agg(F.least(F.min("dist_m"), F.lit(float(radius))).alias("dist_m"), F.max(F.col("_q_shape") == F.col("_t_shape")).alias("same_geom"))


def box_join(a: DataFrame, b: DataFrame, cell: float, key: tuple[str, str]) -> DataFrame:
    """Pairs whose boxes (a_min_lon ...) and (b_min_lon ...) touch, each once, by cells of ``cell`` metres.

    Boxes that touch share the cell where the later of their first rows meets the later
    of their first columns in it; they come up there alone, so no shuffle has to make the
    pairs distinct. ``key`` names the columns that tell rows apart.
    """
    left = _with_cells(a, F.col("a_min_lon"), F.col("a_min_lat"), F.col("a_max_lon"), F.col("a_max_lat"), cell, 0)
    right = _with_cells(b, F.col("b_min_lon"), F.col("b_min_lat"), F.col("b_max_lon"), F.col("b_max_lat"), cell, 0)
    touch = (F.col("a_min_lon") <= F.col("b_max_lon")) & (F.col("b_min_lon") <= F.col("a_max_lon")) & (F.col("a_min_lat") <= F.col("b_max_lat")) & (F.col("b_min_lat") <= F.col("a_max_lat"))
    owner = (F.col("gy") == _row(F.greatest("a_min_lat", "b_min_lat"), cell)) & (F.col("gx") == _column(F.greatest("a_min_lon", "b_min_lon"), F.col("gy"), cell))
    return left.hint("merge").join(right, ["gy", "gx"]).where(touch & owner).drop("gy", "gx")


def boxed(df: DataFrame, prefix: str, geom: str = "geom") -> DataFrame:
    """Adds the columns that ``box_join`` reads, and whether the geometry is an upright rectangle."""
    b = F.col("_b4")
    out = geo.bound(df, "_b4", geo.bbox(F.col(geom))).withColumns({f"{prefix}_{k}": b[k] for k in ("min_lon", "min_lat", "max_lon", "max_lat")})
    return geo.bound(out, f"{prefix}_rect", geo.is_box(F.col(geom), b)).drop("_b4")


def touching(a: Column, b: Column) -> Column:
    """``st_intersects`` for pairs of a ``box_join``: two rectangles whose boxes touch intersect."""
    return F.when(F.col("a_rect") & F.col("b_rect"), F.lit(True)).otherwise(geo.st_intersects(a, b))


def holding(a: Column, b: Column) -> Column:
    """``st_within`` for pairs of a ``box_join``; of rectangles by their boxes."""
    held = (F.col("a_min_lon") >= F.col("b_min_lon")) & (F.col("a_max_lon") <= F.col("b_max_lon")) & (F.col("a_min_lat") >= F.col("b_min_lat")) & (F.col("a_max_lat") <= F.col("b_max_lat"))
    return F.when(F.col("a_rect") & F.col("b_rect"), held).otherwise(geo.st_within(a, b))


#: Candidate polygons of an object on average in the first of several blocks.
FIRST_POLYGONS = 16.0


def candidates(a: DataFrame, b: DataFrame, cell: float) -> float:
    """How many rows of ``b`` share a cell with a row of ``a`` on average, by counts of cells; both are ``boxed``."""
    cells = lambda df, p, n: _with_cells(df.select(*[f"{p}_{k}" for k in ("min_lon", "min_lat", "max_lon", "max_lat")]), F.col(f"{p}_min_lon"), F.col(f"{p}_min_lat"), F.col(f"{p}_max_lon"), F.col(f"{p}_max_lat"), cell, 0).groupBy("gy", "gx").agg(F.count("*").cast("double").alias(n))
    met = cells(a, "a", "n").hint("merge").join(cells(b, "b", "m"), ["gy", "gx"], "left").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("n").alias("n")).first()
    return (met.pairs or 0.0) / (met.n or 1.0)


def objects_from_polygons(polys: DataFrame, layer: DataFrame, intersects: bool = True, cell: float = 500.0) -> DataFrame:
    """Distinct objects (wkt) of many polygons, with the lowest source_idx of a polygon that touches (or holds) them.

    polys: source_idx, geom; layer: obj_id, wkt, geom. Where an object has many candidates,
    they come in blocks by rising source_idx, each twice as large as the one before. An object that
    a block meets is done, as later blocks have no lower source_idx; the others go on until all
    polygons had their turn.
    """
    # read several times, so texts are read and boxes worked out once
    a = written(boxed(layer.select("obj_id", "wkt", F.col("geom").alias("a_geom")), "a", "a_geom"))
    b = boxed(polys.select("source_idx", F.col("geom").alias("b_geom")), "b", "b_geom")
    test = touching(F.col("a_geom"), F.col("b_geom")) if intersects else holding(F.col("a_geom"), F.col("b_geom"))
    met = lambda rows, some: box_join(rows, some, cell, ("obj_id", "source_idx")).where(test).groupBy("wkt").agg(F.min("source_idx").alias("source_idx"))
    mean = candidates(a, b, cell)
    if mean <= 2 * FIRST_POLYGONS:
        return met(a, b)
    b = written(tb.ranked(b, [F.col("source_idx").isNull(), F.col("source_idx")], []))
    n, done, found, rest = b.count(), 0, None, a
    size = max(1, int(n * FIRST_POLYGONS / mean))
    while True:
        some = b.where(F.col("rank").between(done + 1, done + size)).drop("rank")
        near = written(met(rest, some))
        found = near if found is None else found.unionByName(near)
        done, size = done + size, 2 * size
        if done >= n:
            break
        rest = written(rest.join(near.select("wkt"), "wkt", "left_anti"))
        if not rest.limit(1).count():
            break
    # a null text is never done, so it may come up in several blocks
    return found.groupBy("wkt").agg(F.min("source_idx").alias("source_idx"))


#: Areas of a cell that a point is tested against before all others: where many overlap, few points are left then.
FIRST_AREAS = 16


def points_in(points: DataFrame, polys: DataFrame, key: str, cell: float = 500.0) -> DataFrame:
    """Keys of points (key, lon, lat) covered by some polygon (geom).

    A point is in one cell. It meets the ``FIRST_AREAS`` largest areas of it first, and only
    points which none of these covers meet the others, all of them.
    """
    p = points.select(key, F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")).withColumn("gy", _row(F.col("p_lat"), cell))
    p = p.withColumn("gx", _column(F.col("p_lon"), F.col("gy"), cell))
    b = boxed(polys.select("geom"), "b")
    b = _with_cells(b, F.col("b_min_lon"), F.col("b_min_lat"), F.col("b_max_lon"), F.col("b_max_lat"), cell, 0)
    size = (F.col("b_max_lon") - F.col("b_min_lon")) * (F.col("b_max_lat") - F.col("b_min_lat"))
    b = written(b.withColumn("_turn", F.row_number().over(W.partitionBy("gy", "gx").orderBy(size.desc())) <= FIRST_AREAS))

    def met(left: DataFrame, areas: DataFrame) -> DataFrame:
        pairs = left.hint("merge").join(areas, ["gy", "gx"])
        pairs = pairs.where(F.col("p_lon").between(F.col("b_min_lon"), F.col("b_max_lon")) & F.col("p_lat").between(F.col("b_min_lat"), F.col("b_max_lat")))
        return pairs.where(F.col("b_rect") | geo.st_covers_point(F.col("geom"), F.col("p_lon"), F.col("p_lat"))).select(key).distinct()

    found, others = met(p, b.where("_turn")), b.where("NOT _turn")
    if not others.limit(1).count():
        return found
    found = written(found)
    return found.unionByName(met(p.join(found, key, "left_anti"), others))


def label_within(points: DataFrame, polys: DataFrame, key: str) -> DataFrame:
    """Adds ``inside``: whether the point lies in any polygon."""
    found = points_in(points, polys, key).withColumn("inside", F.lit(True))
    return points.join(found, key, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def points_outside(points: DataFrame, polys: DataFrame, key: str) -> DataFrame:
    return points.join(points_in(points, polys, key), key, "left_anti")


#: No two places are farther apart in degrees times metres a degree.
FARTHEST_M = 5e7


#: Width of a cell of a nearest search in radii: an input is copied to 2.25 cells on average, where cells of one radius take nine.
WIDE_CELLS = 4.0
#: Rows of a side that a task of a nearest search may take on average, so that its memory does not grow with the input.
NEAREST_ROWS = 500_000


def _near_in_wide_cells(q: DataFrame, t: DataFrame, radius: float, tasks: int) -> DataFrame:
    """``dwithin_points`` of few pairs: an input meets more points in its few cells, but far fewer copies of inputs are moved."""
    cell, aside, up = WIDE_CELLS * radius, F.col("_aside"), _up(radius)
    points = _both_ways(q.withColumnsRenamed({"lon": "q_lon", "lat": "q_lat"}).withColumn("_aside", _aside(F.col("q_lat"), radius)))
    left = _with_cells(points, F.col("_lon") - aside, F.col("q_lat") - up, F.col("_lon") + aside, F.col("q_lat") + up, cell, 0).drop("_alt", "_copy")
    right = t.withColumnsRenamed({"lon": "t_lon", "lat": "t_lat"}).withColumn("gy", _row(F.col("t_lat"), cell)).withColumn("gx", _column(F.col("t_lon"), F.col("gy"), cell))
    if tasks > int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(tasks, "gy", "gx"), right.repartition(tasks, "gy", "gx")
    apart = F.col("t_lon") - F.col("_lon")  # the shorter way round counts, so a pair is seen from one of two copies
    near = (F.abs(F.col("t_lat") - F.col("q_lat")) <= up) & (F.abs(apart) <= aside) & (apart > -180) & (apart <= 180)
    met = left.hint("merge").join(right, ["gy", "gx"]).where(near)
    return met.withColumn("dist_m", geo.distance_m(F.col("_lon"), F.col("q_lat"), F.col("t_lon"), F.col("t_lat"))).where(F.col("dist_m") <= radius).drop("gy", "gx", "_aside", "_lon")


def first_radius(q: DataFrame, t: DataFrame, wanted: float, radius: float) -> float:
    """A radius, of at most the given one, within which an input has about so many of the points ``t``, by counts of cells."""
    cells = lambda df, n: df.select(_row(F.col("lat"), radius).alias("gy"), "lon").select("gy", _column(F.col("lon"), F.col("gy"), radius).alias("gx")).groupBy("gy", "gx").agg(F.count("*").cast("double").alias(n))
    met = cells(q, "n").hint("merge").join(cells(t, "m"), ["gy", "gx"], "left").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("n").alias("n")).first()
    mean = 3.14 * (met.pairs or 0.0) / (met.n or 1.0)
    return max(0.5, radius * (wanted / mean) ** 0.5) if mean > wanted else radius


def k_nearest(q: DataFrame, t: DataFrame, k: int, start_m: float = 250.0, max_rounds: int = 12, limit_m: float = FARTHEST_M) -> DataFrame:
    """The k nearest points of ``t`` for each of ``q`` within ``limit_m``, ranked by metres, then obj_id: geom_id, obj_id, dist_m, rank.

    The search starts where an input has about 2k points (at ``start_m`` at most). The radius doubles
    for the inputs that found fewer than k; a found set is
    final because every point within the radius has been seen. After ``max_rounds``
    rounds it grows by sixteen a round. It ends at a radius that has every point; inputs
    that still have fewer than k then keep what they have.
    """
    q, t = q.select("geom_id", "lon", "lat"), t.select("obj_id", "lon", "lat")
    found, rest, radius, turn = None, q, first_radius(q, t, 2.0 * k, min(start_m, limit_m)), 0
    tasks = -(-max(3 * q.count(), t.count()) // NEAREST_ROWS)
    order = W.partitionBy("geom_id").orderBy("dist_m", "obj_id")
    while True:
        near = _near_in_wide_cells(rest, t, radius, tasks).select("geom_id", "obj_id", "dist_m")
        pairs = written(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if radius >= limit_m:
            return pairs if found is None else found.unionByName(pairs)
        done = pairs.groupBy("geom_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        done = written(done.select("geom_id"))
        ready = pairs.join(done, "geom_id", "left_semi")
        found = ready if found is None else found.unionByName(ready)
        rest = written(rest.join(done, "geom_id", "left_anti"))
        if not rest.limit(1).count():
            return found
        turn += 1
        radius = min(limit_m, radius * (2 if turn < max_rounds else 16))


def nearest_object(q: DataFrame, t: DataFrame, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(geom_id, dist_m): metres from each point to the nearest object (obj_id, geom) within ``radius``, by growing radii.

    ``keep`` names further columns of that object; ties go to the smaller obj_id.
    """
    best = F.min(F.struct("dist_m", "obj_id", *keep)).alias("_x") if keep else F.min("dist_m").alias("dist_m")
    corner = F.get(F.get("geom.parts", F.lit(0)), F.lit(0))
    found, rest, r = None, q, first_radius(q, t.select(corner["lon"].alias("lon"), corner["lat"].alias("lat")), 4.0, radius)
    while True:
        near = dwithin_objects(rest, t, r).groupBy("geom_id").agg(best)
        near = written(near.select("geom_id", "_x.dist_m", *[f"_x.{k}" for k in keep]) if keep else near)
        found = near if found is None else found.unionByName(near)
        if r >= radius:
            return found
        rest, r = written(rest.join(near.select("geom_id"), "geom_id", "left_anti")), min(2 * r, radius)
        if not rest.limit(1).count():
            return found


def closest(pairs: DataFrame, by: str = "geom_id") -> DataFrame:
    """The closest object of each input; ties go to the smaller obj_id."""
    return pairs.groupBy(by).agg(F.min_by("obj_id", F.struct("dist_m", "obj_id")).alias("obj_id"), F.min("dist_m").alias("dist_m"))


def closest_to(points: DataFrame, lon: float, lat: float) -> DataFrame:
    """(obj_id, dist_m) of the point (obj_id, lon, lat) closest to one place; ties go to the smaller obj_id, nothing where there are no points."""
    d = geo.distance_m(F.lit(float(lon)), F.lit(float(lat)), F.col("lon"), F.col("lat"))
    best = points.where("lon IS NOT NULL AND lat IS NOT NULL").agg(F.min(F.struct(d.alias("dist_m"), F.col("obj_id"))).alias("_x"))
    return best.where("_x IS NOT NULL").select("_x.obj_id", "_x.dist_m")


def objects_in_radius(inputs: DataFrame, layer: DataFrame, radius: float, excluded: DataFrame | None = None) -> DataFrame:
    """(geom_id, wkt): the distinct objects (obj_id, wkt, geom) within a radius of inputs of any kind (geom_id, geom).

    Objects that touch one of the ``excluded`` areas (source_idx, geom) are left out.
    """
    if excluded is not None:
        layer = layer.join(objects_from_polygons(excluded, layer).select("wkt"), "wkt", "left_anti")
    near = dwithin_shapes(inputs, layer, radius).select("geom_id", "obj_id")
    return near.join(layer.select("obj_id", "wkt"), "obj_id").select("geom_id", "wkt").distinct()


#: How much the planes of two places within a search may differ, as a share of a distance.
NEARLY = 1e-3


def nearest_pairs(inputs: DataFrame, objects: DataFrame, radius: float) -> DataFrame:
    """The one nearest object (obj_id, geom) of each input (geom_id, geom) of any kind within the radius, as the ends of a route to it.

    Returns geom_id, obj_id, dist_m, source (the input's centroid) and destination (the input's point nearest to the
    object), both (lon, lat). Ties go to the smaller obj_id; inputs with no object are left out.
    """
    # the plane of a piece differs from piece to piece, so what is about as near is measured anew, a point in its own plane
    near = dwithin_shapes(inputs, objects, radius * (1 + 2 * NEARLY))
    least = near.groupBy("geom_id").agg(F.min("dist_m").alias("_least"))
    near = near.join(least, "geom_id").where(F.col("dist_m") <= F.col("_least") * (1 + NEARLY) + 1e-3).drop("_least")
    both = near.join(inputs.select("geom_id", F.col("geom").alias("_q")), "geom_id").join(objects.select("obj_id", F.col("geom").alias("_t")), "obj_id")
    at = F.get(F.get("_t.parts", F.lit(0)), F.lit(0))
    turn = F.when(at["lon"] - geo.bbox(F.col("_q"))["min_lon"] > 180, -360.0).when(at["lon"] - geo.bbox(F.col("_q"))["min_lon"] < -180, 360.0).otherwise(0.0)
    own = geo.point_distance_m(F.col("_q"), at["lon"] + turn, at["lat"])
    both = both.withColumn("dist_m", F.when(F.col("_t.kind") == "POINT", own).otherwise(F.col("dist_m"))).where(F.col("dist_m") <= radius)
    both = both.groupBy("geom_id").agg(F.min_by(F.struct("obj_id", "dist_m", "_q", "_t"), F.struct("dist_m", "obj_id")).alias("_x")).select("geom_id", "_x.*")
    end = geo.closest_point_to(F.col("_q"), F.col("_t"))
    return both.select("geom_id", "obj_id", "dist_m", geo.centroid(F.col("_q")).alias("source"), F.struct(end["lon"].alias("lon"), end["lat"].alias("lat")).alias("destination"))
