"""Map features: what lies within radii of each input geometry.

Per layer there is one distance join at the largest radius any feature asks for;
smaller radii are conditions on ``dist_m``, and all features of the layer are one
conditional aggregation over it. Inputs without pairs take each feature's default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import blocks, pyramid, spatial
from geofeat.operators import tables as tb
from geofeat.sources.shared import written

# Named tag predicates.
ROAD = "highway IS NOT NULL"
PRIMARY_ROAD = "highway = 'primary'"
SECONDARY_ROAD = "highway = 'secondary'"
TERTIARY_ROAD = "highway = 'tertiary'"
MAJOR_ROAD = f"{PRIMARY_ROAD} OR {SECONDARY_ROAD} OR {TERTIARY_ROAD}"
RESIDENTIAL_ROAD = "highway = 'residential'"
SERVICE_ROAD = "highway = 'service'"
TRACK_ROAD = "highway = 'track'"
PATH_ROAD = "highway = 'path'"
MINOR_ROAD = f"{RESIDENTIAL_ROAD} OR {SERVICE_ROAD} OR {TRACK_ROAD} OR {PATH_ROAD}"
BUILDING = "building IS NOT NULL"
SHOP = "shop IS NOT NULL"
PARK = "leisure IS NOT NULL"
AMENITY = "amenity IS NOT NULL"
BOUNDARY = "boundary IS NOT NULL"
JUNCTIONS = ALL = "1=1"

RADII = (0, 50, 100, 250, 500, 1000, 3000)
#: Square feet per square metre; the measure that area features have always been divided by.
AREA_DIVISOR = 10.764
WALK_KMH, DRIVE_KMH = 4, 50


def flag_columns(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """One 0/1 column per named predicate."""
    return df.withColumns({name: F.when(F.expr(sql), 1).otherwise(0) for name, sql in filters.items()})


def any_filter(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows that match at least one predicate."""
    return df.where(" OR ".join(f"({sql})" for sql in filters.values()))


def height_columns(df: DataFrame) -> DataFrame:
    """``absolute_height`` where the layer has ``height`` and ``ground``; any other layer is returned as it is."""
    return df.withColumn("absolute_height", F.col("ground") + F.col("height")) if tb.has_column(df, "height") and tb.has_column(df, "ground") else df


@dataclass(frozen=True)
class Feature:
    """One feature: what it asks of a layer, its radius, output columns and defaults.

    A subclass gives ``aggregates``: named aggregate columns over the pairs, for the
    rows that ``hit`` marks (flagged and within the radius).
    """

    filter: str
    layer: str
    object_name: str
    radius: float = 0.0

    def names(self) -> list[str]:
        raise NotImplementedError

    def defaults(self) -> dict[str, float]:
        return {n: 0.0 for n in self.names()}

    def aggregates(self, hit: Column) -> list[Column]:
        raise NotImplementedError

    def named(self, name: str) -> str:
        return f"{name}_{self.radius:g}m"


class NumberOf(Feature):
    def names(self):
        return [self.named(f"number_of_{self.object_name}")]

    def aggregates(self, hit):
        return [F.sum(F.when(hit, F.col("coverage")))]


class AreaOf(Feature):
    def names(self):
        return [self.named(f"area_of_{self.object_name}")]

    def aggregates(self, hit):
        return [F.sum(F.when(hit, F.coalesce("area_m2", F.lit(0.0)) * F.col("coverage"))) / AREA_DIVISOR]


class TotalLength(Feature):
    def names(self):
        return [self.named(f"length_of_{self.object_name}")]

    def aggregates(self, hit):
        return [F.sum(F.when(hit, F.col("length_m") * F.col("coverage")))]


class DistanceTo(Feature):
    """Metres to the nearest object that is not the input itself; by default the radius."""

    def names(self):
        return [self.named(f"distance_to_{self.object_name}")]

    def defaults(self):
        return {self.names()[0]: float(self.radius)}

    def aggregates(self, hit):
        return [F.min(F.when(hit & ~F.col("same_geom"), F.col("dist_m")))]


class AreaOfNearest(Feature):
    """Size of the nearest object: its area if it is a single polygon, else its length (of several polygons, as of points, 0)."""

    def names(self):
        return [self.named(f"area_of_nearest_{self.object_name}")]

    def aggregates(self, hit):
        return [F.min_by(F.when(hit, F.col("size_m")), F.when(hit, F.struct("dist_m", "obj_id")))]


STATISTICS = {"avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp}


class Heights(Feature):
    def names(self):
        return [self.named(f"{kind}_of_{self.object_name}_{s}") for kind in ("height", "absolute_height") for s in STATISTICS]

    def aggregates(self, hit):
        return [f(F.when(hit, F.col(c))) for c in ("height", "absolute_height") for f in STATISTICS.values()]


class BuildingScores(Feature):
    """Statistics of the stored scores of nearby objects; the pairs carry ``scores``."""

    def names(self):
        return [self.named(f"building_scores_{s}") for s in STATISTICS]

    def aggregates(self, hit):
        return [f(F.when(hit, F.col("scores"))) for f in STATISTICS.values()]


def size_columns() -> dict[str, Column]:
    """What features ask of the size of an object (geom)."""
    sizes = {"area_m2": geo.area_m2(F.col("geom")), "length_m": geo.length_m(F.col("geom"))}
    return sizes | {"size_m": F.when(F.col("geom.kind") == "POLYGON", sizes["area_m2"]).otherwise(sizes["length_m"])}


def pairs(inputs: DataFrame, layer: DataFrame, features: list[Feature]) -> DataFrame:
    """The pair table of one layer: one join at the largest radius, with a flag column per predicate.

    Inputs are points (lon, lat), or shapes of any kind (geom). ``same_geom`` marks an input's
    own geometry: the same shape; of points the same place in a layer of points, the
    same text (``geom_wkt`` and ``wkt``, where there are both) in one of lines and areas.
    """
    filters = {f.object_name: f.filter for f in features}  # a later feature of the same name wins
    sizes = size_columns()
    objects = height_columns(flag_columns(any_filter(layer, filters), filters)).withColumn("coverage", F.lit(1.0))
    radius = max(f.radius for f in features)
    if "geom" in inputs.columns:
        shapes = objects if "geom" in layer.columns else objects.withColumn("geom", geo.point(F.col("lon"), F.col("lat"))).drop("lon", "lat")
        measured = shapes.withColumns(sizes)
        return spatial.dwithin_shapes(inputs, shapes, radius).join(measured.drop("geom", "wkt"), "obj_id")
    if "geom" in layer.columns:
        measured = objects.withColumns(sizes)
        same = F.coalesce(F.col("geom_wkt") == F.col("wkt"), F.lit(False)) if "geom_wkt" in inputs.columns and "wkt" in layer.columns else F.lit(False)
        return spatial.dwithin_objects(inputs, measured, radius).withColumn("same_geom", same)
    flat = objects.withColumns({"area_m2": F.lit(0.0), "length_m": F.lit(0.0), "size_m": F.lit(0.0)})
    met = spatial.dwithin_points(inputs, flat, radius)
    return met.withColumn("same_geom", (F.col("q_lon") == F.col("t_lon")) & (F.col("q_lat") == F.col("t_lat")))


def aggregate(met: DataFrame, features: list[Feature]) -> DataFrame:
    """All features of one layer in one aggregation."""
    columns = []
    for f in features:
        hit = (F.col(f.object_name) == 1) & (F.col("dist_m") <= f.radius)
        columns += [c.alias(n) for n, c in zip(f.names(), f.aggregates(hit))]
    return met.groupBy("geom_id").agg(*columns)


def around_shapes(inputs: DataFrame, layer: DataFrame, features: list[Feature]) -> DataFrame:
    """Features of points in a layer of shapes.

    What asks for the nearest object searches by growing radii, so that all that goes by pairs are sums, which need no sort of them.
    """
    if "geom_wkt" not in inputs.columns and all(type(f) in (NumberOf, TotalLength, DistanceTo) and f.radius > 0 for f in features):
        return around_lines(inputs, layer, features)
    return by_pairs_and_search(inputs, layer, features)


def by_pairs_and_search(inputs: DataFrame, layer: DataFrame, features: list[Feature]) -> DataFrame:
    nearest = [f for f in features if isinstance(f, AreaOfNearest) and f.radius > 0]
    other = [f for f in features if f not in nearest]
    filters = {f.object_name: f.filter for f in features}  # a later feature of the same name wins
    out = inputs.select("geom_id")
    if other:
        out = out.join(aggregate(pairs(inputs, layer, other), other), "geom_id", "left")
    for name in dict.fromkeys(f.object_name for f in nearest):
        own = [f for f in nearest if f.object_name == name]
        objects = written(layer.where(filters[name]).withColumns(size_columns()).select("obj_id", "geom", "size_m"))
        near = spatial.nearest_object(inputs.select("geom_id", "lon", "lat"), objects, max(f.radius for f in own), ("size_m",))
        found = {f.names()[0]: F.when(F.col("dist_m") <= f.radius, F.col("size_m")) for f in own}
        out = out.join(near, "geom_id", "left").withColumns(found).drop("dist_m", "size_m")
    return out.select("geom_id", *dict.fromkeys(n for f in features for n in f.names()))


def around_lines(inputs: DataFrame, layer: DataFrame, features: list[Feature]) -> DataFrame:
    """Sums and distances of a layer of lines: those that are short beside the radius by blocks of arrays, without pairs, all other shapes as in any layer."""
    filters = {f.object_name: f.filter for f in features}  # a later feature of the same name wins
    widest = max(f.radius for f in features)
    vertices = F.flatten("geom.parts")
    box = geo.bbox(F.col("geom"))
    wide, high = box["max_lon"] - box["min_lon"], box["max_lat"] - box["min_lat"]
    size = F.sqrt(wide * wide + high * high) * 111_700.0
    whole = F.forall("geom.parts", lambda p: F.size(p) > 1) & F.forall(vertices, lambda c: c["lon"].isNotNull() & c["lat"].isNotNull())
    short = F.coalesce(F.col("geom.kind").endswith("LINESTRING") & (F.size(vertices) > 0) & whole & (size <= 2 * widest), F.lit(False))
    flagged = flag_columns(any_filter(layer, filters), filters)
    lengths = {f"_m_{n}": F.when(F.col(n) == 1, geo.length_m(F.col("geom"))).otherwise(0.0) for n in filters}
    marked = written(flagged.select("obj_id", "geom", *filters, short.alias("_short"), F.when(short, size).alias("_size")))
    seen = marked.agg(F.max("_size").alias("hold"), F.count(F.when(~F.col("_short"), 1)).alias("others")).first()
    if seen.hold is None or widest > blocks.WIDEST_M:
        return by_pairs_and_search(inputs, layer, features)
    near_q = inputs.select("geom_id", "lon", "lat")
    lines = written(marked.where("_short").withColumns(lengths).select("obj_id", F.col("geom.parts").alias("parts"), *filters, *lengths))
    counted, distant = ([f for f in features if isinstance(f, kind)] for kind in ((NumberOf, TotalLength), DistanceTo))
    weights = list(dict.fromkeys(f.object_name if isinstance(f, NumberOf) else f"_m_{f.object_name}" for f in counted))
    radii = sorted({f.radius for f in counted})
    asked = {f.object_name: f.radius for f in sorted(distant, key=lambda f: f.radius)}  # the largest radius of each
    corner = F.get(F.get("parts", F.lit(0)), F.lit(0))
    corners = lines.select(corner["lon"].alias("lon"), corner["lat"].alias("lat"), *filters)
    near = {n: spatial.first_radius(near_q, corners.where(F.col(n) == 1), FIRST_NEAREST, radius) for n, radius in asked.items()}
    density = pyramid.pairs_per_input(near_q, corners, [widest])[widest] / (3.14 * widest * widest)
    hold = seen.hold * 1.001 + 0.01
    met = written(blocks.around_lines(near_q, lines, radii, weights, near, hold, density))
    out, found = near_q.select("geom_id").join(met, "geom_id", "left"), {}
    for f in counted:
        weight = f.object_name if isinstance(f, NumberOf) else f"_m_{f.object_name}"
        found[f.names()[0]] = F.col(f"n_{radii.index(f.radius)}_{weights.index(weight)}")
    for name, radius in asked.items():
        dist = F.col(f"d_{name}")
        if near[name] < radius:
            rest = written(near_q.join(met.where(dist.isNotNull()).select("geom_id"), "geom_id", "left_anti"))
            if rest.limit(1).count():
                more = blocks.around_lines(rest, lines.where(F.col(name) == 1), [], [], {name: radius}, hold, density).withColumnRenamed(f"d_{name}", f"_d_{name}")
                out, dist = out.join(more, "geom_id", "left"), F.coalesce(dist, F.col(f"_d_{name}"))
        found |= {f.names()[0]: F.when(dist <= f.radius, dist) for f in distant if f.object_name == name}
    names = list(dict.fromkeys(n for f in features for n in f.names()))
    out = out.select("geom_id", *[found[n].alias(n) for n in names])
    if not seen.others:
        return out
    rest = layer.join(marked.where("NOT _short").select("obj_id").distinct(), "obj_id", "left_semi").where(~short)
    other = by_pairs_and_search(inputs, rest, features).withColumnsRenamed({n: f"_o_{n}" for n in names})
    least = {f.names()[0] for f in distant}
    both = lambda n: F.least(n, f"_o_{n}") if n in least else F.when(F.col(n).isNotNull() | F.col(f"_o_{n}").isNotNull(), F.coalesce(n, F.lit(0.0)) + F.coalesce(f"_o_{n}", F.lit(0.0)))
    return out.join(other.dropDuplicates(["geom_id"]), "geom_id", "left").select("geom_id", *[both(n).alias(n) for n in names])


#: Pairs of an input on average up to which they are not too many for a join.
FEW_PAIRS = 200
#: Objects of a name around an input, on average, in its first look for the nearest.
FIRST_NEAREST = 16.0


def around_points(inputs: DataFrame, layer: DataFrame, features: list[Feature]) -> DataFrame:
    """``NumberOf`` and ``DistanceTo`` of a layer of points.

    Where the largest radius has few pairs (``FEW_PAIRS``, from counts of cells), all goes by pairs, else by blocks of
    objects in arrays (``blocks``). Radii too wide for a block go by pairs where these are few, and the others by
    counts from a pyramid of cells, and the nearest objects by growing radii
    for the inputs which have none among the pairs. All ways give the same.
    """
    filters = {f.object_name: f.filter for f in features}  # a later feature of the same name wins
    flagged = flag_columns(any_filter(layer, filters), filters)
    q, out = inputs.select("geom_id", "lon", "lat"), inputs.select("geom_id")
    radii = sorted({f.radius for f in features})
    expected = pyramid.pairs_per_input(q, flagged, radii)
    widest = radii[-1]
    if FEW_PAIRS < expected[widest] and widest <= blocks.WIDEST_M:
        return by_blocks(q, flagged, features, expected[widest] / (3.14 * widest * widest))
    near = max((r for r in radii if expected[r] <= FEW_PAIRS), default=0.0)
    close, far = [f for f in features if f.radius <= near], [f for f in features if f.radius > near]
    asked = {f.object_name: f.radius for f in sorted(far, key=lambda f: f.radius) if isinstance(f, DistanceTo)}  # the largest radius of each
    found = {n: DistanceTo(filters[n], "", n, near) for n in asked}
    if near:
        made = list(dict.fromkeys([(type(f), f.object_name, f.radius) for f in [*close, *found.values()]]))
        made = [cls(filters[n], "", n, r) for cls, n, r in made]
        paired = aggregate(pairs(inputs, layer, made), made)
        paired = written(paired) if far else paired
        out = out.join(paired, "geom_id", "left")
    counted = [f for f in far if isinstance(f, NumberOf)]
    if counted:
        sums = pyramid.counts_around(q, flagged.select("lon", "lat", *filters), sorted({f.radius for f in counted}), sorted({f.object_name for f in counted}))
        columns = [F.max(F.when(F.col("radius") == f.radius, F.when(F.col(f.object_name) > 0, F.col(f.object_name).cast("double")))).alias(f.names()[0]) for f in counted]
        out = out.join(sums.groupBy("geom_id").agg(*columns), "geom_id", "left")
    for name, radius in asked.items():
        have = found[name].names()[0]
        rest = q.join(paired.where(F.col(have).isNotNull()).select("geom_id"), "geom_id", "left_anti") if near else q
        first = 2 * near if near else min(radii)
        more = pyramid.nearest_within(rest, flagged.where(F.col(name) == 1).select("lon", "lat"), radius, first).withColumnRenamed("dist_m", "_d")
        dist = F.coalesce(F.col(have), F.col("_d")) if near else F.col("_d")
        names = {f.names()[0]: F.when(dist <= f.radius, dist) for f in far if isinstance(f, DistanceTo) and f.object_name == name}
        out = out.join(more, "geom_id", "left").withColumns(names).drop("_d")
    return out.select("geom_id", *dict.fromkeys(n for f in features for n in f.names()))


def by_blocks(q: DataFrame, flagged: DataFrame, features: list[Feature], density: float) -> DataFrame:
    """``around_points`` without pairs; an input without an object in a first short look goes on by growing radii."""
    counted, distant = ([f for f in features if isinstance(f, cls)] for cls in (NumberOf, DistanceTo))
    names = sorted({f.object_name for f in features})
    radii = sorted({f.radius for f in counted})
    asked = {f.object_name: f.radius for f in sorted(distant, key=lambda f: f.radius)}  # the largest radius of each
    objects = {n: flagged.where(F.col(n) == 1).select("lon", "lat") for n in asked}
    near = {n: spatial.first_radius(q, objects[n], FIRST_NEAREST, radius) for n, radius in asked.items()}
    met = written(blocks.around(q, flagged, radii, names, near, density))
    out, found = q.select("geom_id").join(met, "geom_id", "left"), {}
    for f in counted:
        n = F.col(f"n_{radii.index(f.radius)}_{names.index(f.object_name)}")
        found[f.names()[0]] = F.when(n > 0, n.cast("double"))
    for name, radius in asked.items():
        have = f"d_{names.index(name)}"
        dist = F.col(have)
        if near[name] < radius:
            rest = written(q.join(met.where(F.col(have).isNotNull()).select("geom_id"), "geom_id", "left_anti"))
            if rest.limit(1).count():
                more = pyramid.nearest_within(rest, objects[name], radius, 2 * near[name]).withColumnRenamed("dist_m", f"_{have}")
                out, dist = out.join(more, "geom_id", "left"), F.coalesce(dist, F.col(f"_{have}"))
        found |= {f.names()[0]: F.when(dist <= f.radius, dist) for f in distant if f.object_name == name}
    return out.select("geom_id", *[found[n].alias(n) for n in dict.fromkeys(n for f in features for n in f.names())])


def fill_defaults(inputs: DataFrame, frame: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """One row per input; missing rows and nulls take the defaults."""
    return inputs.select("geom_id").join(frame, "geom_id", "left").fillna(defaults)


def assemble(inputs: DataFrame, frames: list[DataFrame]) -> DataFrame:
    """Feature frames side by side, one row per input, null where a frame has none. Frames are grouped by geom_id already, so they only meet."""
    out = inputs.select("geom_id")
    for frame in frames:
        out = out.join(frame, "geom_id", "left")
    return out


@dataclass
class FeatureBuilder:
    """Features over named layers: ``transform`` gives one row per input (geom_id, with lon and lat or geom), columns in declared order."""

    features: list[Feature]
    layers: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, inputs: DataFrame) -> DataFrame:
        """Refuses inputs of which two are the same."""
        assert_distinct(inputs)
        frames, defaults = [], {}
        for name in dict.fromkeys(f.layer for f in self.features):
            own = [f for f in self.features if f.layer == name]
            if all(type(f) in (NumberOf, DistanceTo) and f.radius > 0 for f in own) and not {"geom"} & {*inputs.columns, *self.layers[name].columns}:
                found = around_points(inputs, self.layers[name], own)
            elif "geom" in self.layers[name].columns and "geom" not in inputs.columns:
                found = around_shapes(inputs, self.layers[name], own)
            else:
                found = aggregate(pairs(inputs, self.layers[name], own), own)
            frames.append(found)
        for f in self.features:
            defaults |= f.defaults()
        return assemble(inputs, frames).fillna(defaults).select("geom_id", *[n for f in self.features for n in f.names()])

    def transform_stored(self, inputs: DataFrame, store: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
        """``transform`` of inputs with ``geom_wkt``, by way of a store; returns the frame and the store afterwards.

        Features that are complete in the store are read from it, the others computed
        and put in with the time ``now``.
        """
        assert_distinct(inputs)
        cached, rest = split_cached(self.features, inputs, store)
        stored, new = [n for f in cached for n in f.names()], [n for f in rest for n in f.names()]
        out = inputs.select("geom_id")
        if stored:
            out = out.join(tb.load_features(inputs, store, stored), "geom_id", "left")
        if new:
            computed = written(FeatureBuilder(rest, self.layers).transform(inputs))
            out = out.join(computed, "geom_id", "left")
            store = tb.save_features(store, computed.join(inputs.select("geom_id", "geom_wkt"), "geom_id"), new, now)
        return out.select("geom_id", *[n for f in self.features for n in f.names()]), store

    def extract_coordinates(self, coordinates: DataFrame) -> DataFrame:
        """From rows of (geom_id, lon, lat)."""
        return self.transform(coordinates.select("geom_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")))


def split_cached(features: list[Feature], inputs: DataFrame, store: DataFrame) -> tuple[list[Feature], list[Feature]]:
    """Features whose columns are all stored, and not null, for all inputs (geom_wkt), and those that must be computed."""
    names = [n for f in features for n in f.names()]
    missing = {r.feature_name for r in tb.missing_features(inputs, store, names).select("feature_name").collect()}
    cached = [f for f in features if not missing & set(f.names())]
    return cached, [f for f in features if f not in cached]


def assert_distinct(inputs: DataFrame) -> None:
    same = ["geom"] if "geom" in inputs.columns else ["lon", "lat"]
    n = inputs.groupBy(*same).count().where("count > 1").limit(1).count()
    if n:
        raise ValueError("input geometries must be distinct")


# The classes of features that suit points, ways and areas.
SUITED: dict[str, list[type[Feature]]] = {
    "point": [DistanceTo, NumberOf],
    "way": [DistanceTo, TotalLength, AreaOfNearest],
    "area": [DistanceTo, NumberOf, AreaOf, AreaOfNearest],
}


def bundle(elements: list[tuple], level: int = 10) -> list[Feature]:
    """Expands (filter, layer, name, radii, classes, importance) into features of importance up to ``level``."""
    return [cls(flt, layer, name, float(r)) for flt, layer, name, radii, classes, importance in elements if importance <= level for r in radii for cls in classes]


def feature_filter(df: DataFrame, features: list[Feature], keys: list[str]) -> DataFrame:
    """The keys and those columns that belong to the features of a bundle; features without a column are ignored."""
    wanted = {n for f in features for n in f.names()}
    return df.select(*keys, *[c for c in df.columns if c in wanted])


DEFAULT_BUNDLE = [
    (MAJOR_ROAD, "lines", "major_road", [r for r in RADII if 100 <= r <= 1000], SUITED["way"], 1),
    (MINOR_ROAD, "lines", "minor_road", [r for r in RADII if 50 <= r <= 250], SUITED["way"], 1),
    (BUILDING, "polygons", "building", [r for r in RADII if 50 <= r <= 250], SUITED["area"], 1),
    (BUILDING, "polygons", "building", [0], [AreaOf], 3),
]


def object_distances(met: DataFrame, name: str, radius: float) -> DataFrame:
    """Statistics of the distances between all ordered pairs of flagged objects around one input."""
    near = met.where((F.col(name) == 1) & (F.col("dist_m") <= radius))
    other = near.select("geom_id", F.col("obj_id").alias("obj_id2"), F.col("t_lon").alias("lon2"), F.col("t_lat").alias("lat2"))
    both = near.join(other, "geom_id").where("obj_id <> obj_id2")
    d = geo.distance_m(F.col("t_lon"), F.col("t_lat"), F.col("lon2"), F.col("lat2"))
    return both.groupBy("geom_id").agg(*[f(d).alias(f"object_distances_{name}_{s}_{radius:g}m") for s, f in STATISTICS.items()])


def object_distances_around(inputs: DataFrame, layer: DataFrame, sql: str, name: str, radius: float) -> DataFrame:
    """``object_distances`` of the objects of a layer of points that match a predicate, around inputs (geom_id, lon, lat), without a row for each pair.

    Of inputs that share a geom_id the objects count together, which goes by pairs.
    """
    objects = layer.where(sql)
    shared = written(inputs.groupBy("geom_id").count().where("count > 1 AND geom_id IS NOT NULL").select("geom_id"))
    alone = inputs.where("geom_id IS NOT NULL").join(shared, "geom_id", "left_anti")
    found = blocks.pair_statistics(alone, objects, radius)
    out = found.select("geom_id", *[F.col(s).alias(f"object_distances_{name}_{s}_{radius:g}m") for s in STATISTICS])
    if not shared.limit(1).count():
        return out
    met = pairs(inputs.join(shared, "geom_id", "left_semi"), layer, [NumberOf(sql, "points", name, radius)])
    return out.unionByName(object_distances(met, name, radius))


def area_of_self(inputs: DataFrame) -> DataFrame:
    return inputs.select("geom_id", F.coalesce(geo.area_m2(F.col("geom")), F.lit(0.0)).alias("area_of_self_0m"))
