"""Summaries of counts, scores, times and rasters: masks, means, frames, channel images."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.operators import spatial as sp
from geofeat.operators import tables as tb
from geofeat.sources.shared import written


def quantile_of(df: DataFrame, col: str, p: float) -> DataFrame:
    """One row (q): the exact quantile with linear steps between values, null without any.

    Equal values are counted first, and their places come from a running sum by ranges, so no task holds all values.
    """
    counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = tb.running_total(counted, "_v", "_n").select("_v", (F.col("_total") - F.col("_n")).alias("_from"), "_total")
    at = counted.agg(((F.sum("_n") - 1) * F.lit(float(p))).alias("_at"))
    holds = lambda place: (F.col("_from") <= place) & (place < F.col("_total"))
    low, high = F.floor("_at"), F.ceil("_at")
    ends = placed.join(F.broadcast(at), F.lit(True)).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"), F.max("_at").alias("_at"))
    return ends.select((F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("q"))


def dense_mask(counts: DataFrame, filters: dict[str, tuple[float | None, float | None]], keys: list[str]) -> DataFrame:
    """The keys, and 1 for each column's value that is at least ``min_count`` and at least the column's own quantile, else 0.

    filters: column -> (min_count, quantile), either None for no such condition; null values are not dense.
    """
    cuts = [quantile_of(counts, c, p).withColumnRenamed("q", f"_q_{c}") for c, (_, p) in filters.items() if p is not None]
    wide = reduce(lambda df, cut: df.crossJoin(F.broadcast(cut)), cuts, counts)

    def mask(c: str) -> Column:
        least, p = filters[c]
        enough = F.col(c).isNotNull()
        enough = enough if least is None else enough & (F.col(c) >= least)
        return F.when(enough if p is None else enough & (F.col(c) >= F.col(f"_q_{c}")), 1).otherwise(0)

    return wide.select(*keys, *[mask(c).alias(c) for c in filters])


#: Cells along the longer side of an area in which points are counted, at least.
CELLS_ACROSS = 16


def object_counts(polys: DataFrame, points: DataFrame, filters: dict[str, str], cell: float = 1.0) -> DataFrame:
    """(source_idx, one count a filter) of the points (obj_id, lon, lat, tags) which each area (source_idx, geom) covers; 0 where there are none.

    Cells of 2^-level degrees, the level by the size of the area, which lie wholly in it answer with
    their counts; only the points of the cells on its rim meet the area. Cells are ``cell`` metres high at least.
    """
    shapes = sp.boxed(polys.select("source_idx", "geom"), "b")
    size = F.greatest(F.col("b_max_lon") - F.col("b_min_lon"), F.col("b_max_lat") - F.col("b_min_lat"))
    level = F.when(size > 0, F.least(F.lit(max(0, math.floor(math.log2(110_500 / cell)))), F.greatest(F.lit(0), F.ceil(F.log2(CELLS_ACROSS / F.when(size > 0, size)))))).otherwise(0).cast("int")
    shapes = geo.bound(shapes, "level", level)
    levels = sorted(r[0] for r in shapes.select("level").distinct().collect())
    scale, key = F.pow(F.lit(2.0), F.col("level")), ["level", "cx", "cy"]
    place = lambda c: F.floor(F.col(c) * scale).cast("long")
    flagged = points.select("lon", "lat", *[F.expr(f).alias(n) for n, f in filters.items()]).withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    placed = flagged.withColumns({"cx": place("lon"), "cy": place("lat")})
    sums = placed.groupBy(*key).agg(*[F.count(F.when(F.col(n), 1)).alias(n) for n in filters])
    cells = shapes.withColumn("cx", F.explode(F.sequence(place("b_min_lon"), place("b_max_lon")))).withColumn("cy", F.explode(F.sequence(place("b_min_lat"), place("b_max_lat"))))
    west, south, east, north = F.col("cx") / scale, F.col("cy") / scale, (F.col("cx") + 1) / scale, (F.col("cy") + 1) / scale
    held = (west >= F.col("b_min_lon")) & (east <= F.col("b_max_lon")) & (south >= F.col("b_min_lat")) & (north <= F.col("b_max_lat"))
    cells = geo.bound(cells, "_full", F.when(F.col("b_rect") | ~held, held).otherwise(geo.st_within(geo.box(west, south, east, north), F.col("geom"))))
    full = cells.where("_full").select("source_idx", *key).hint("merge").join(sums, key).select("source_idx", *filters)
    # the points of a cell meet the areas whose rim crosses it
    met = cells.where("NOT _full").select("source_idx", "geom", "b_rect", "b_min_lon", "b_max_lon", "b_min_lat", "b_max_lat", *key).hint("merge").join(placed, key)
    met = met.where(F.col("lon").between(F.col("b_min_lon"), F.col("b_max_lon")) & F.col("lat").between(F.col("b_min_lat"), F.col("b_max_lat")))
    met = met.where(F.col("b_rect") | geo.st_covers_point(F.col("geom"), F.col("lon"), F.col("lat"))).groupBy("source_idx").agg(*[F.count(F.when(F.col(n), 1)).alias(n) for n in filters])
    counts = full.unionByName(met).groupBy("source_idx").agg(*[F.sum(n).alias(n) for n in filters])
    return polys.select("source_idx").join(counts, "source_idx", "left").fillna(0, list(filters))


def coverage_ratio(area: DataFrame, polys: DataFrame, step: float) -> DataFrame:
    """(ratio): the share of one box (min_lon .. max_lat) that the union of areas (geom) covers, by points of a grid of ``step`` degrees."""
    grid = tb.grid_in_range(area, step).withColumn("id", F.concat_ws(":", "ix", "iy")).select("id", "lon", "lat")
    return sp.label_within(grid, polys, "id").agg(F.avg(F.col("inside").cast("double")).alias("ratio"))


def mean_score_by_model(scores: DataFrame, score: str = "auc") -> DataFrame:
    """Mean over the folds of each model; null and NaN scores do not count."""
    return scores.groupBy("model").agg(F.avg(F.when(~F.isnan(score), F.col(score))).alias(score))


def heatmap_frames(df: DataFrame, ts: str, unit: str = "hour", cell: float | None = None) -> DataFrame:
    """Frames of a time-ordered heat map: (frame, points), the (lat, lon) of all centroids (geom, or lon and lat) in each, sorted.

    With ``cell`` in degrees the points of a frame are counted in cells (lat, lon, n), so that a frame stays bounded
    by the area, whatever the number of rows.
    """
    at = geo.centroid(F.col("geom")) if tb.has_column(df, "geom") else F.struct("lat", "lon")
    rows = df.select(tb.time_bucket(F.col(ts), unit).alias("frame"), at["lat"].alias("lat"), at["lon"].alias("lon")).where("frame IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    if cell is None:
        return rows.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("lat", "lon"))).alias("points"))
    near = [(F.floor(F.col(c) / cell) * cell).alias(c) for c in ("lat", "lon")]
    counted = rows.groupBy("frame", *near).agg(F.count("*").alias("n"))
    return counted.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("lat", "lon", "n"))).alias("points"))


def tile_samples(pixels: DataFrame, by: str, value: str, min_entropy: float) -> DataFrame:
    """(by, entropy) of the tiles whose entropy reaches a threshold."""
    return tb.image_entropy(pixels, by, value).where(F.col("entropy") >= min_entropy)


def feature_image(stored: DataFrame, names: list[str], step_m: float, order: str, area: Column | None = None) -> DataFrame:
    """One image of stored features (geom_wkt, feature_name, feature_value, order): (ix, iy, one channel a feature, mask).

    The features of geometries within ``area`` (all without one) lie at their centroids, in one grid for all channels;
    each is scaled to [0, 1] by its own range, and the last by ``order`` stays in a cell. ``mask`` is 1 where a cell
    has a value of any channel; channels without value are 0. The grid is whole, from the least to the largest cell.
    """
    placed = tb.select_features(stored, names).where("feature_value IS NOT NULL AND NOT isnan(feature_value)")
    placed = geo.bound(placed, "_g", geo.from_wkt(F.col("geom_wkt")))
    placed = placed if area is None else placed.where(geo.st_within(F.col("_g"), area))
    at = geo.bound(placed, "_c", geo.centroid(F.col("_g"))).select("feature_name", "feature_value", F.col(order).alias("_o"), "_c.lon", "_c.lat")
    at = written(at)  # its range, its corner, its cells and its grid read it
    corner = at.agg(F.min("lon").alias("_x"), F.min("lat").alias("_y"))
    ranges = at.groupBy("feature_name").agg(F.min("feature_value").alias("_a"), F.max("feature_value").alias("_b"))
    scaled = F.coalesce((F.col("feature_value") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)), F.lit(0.0))
    cell = lambda c, o: F.rint((F.col(c) - F.col(o)) / (step_m * geo.DEGREES_PER_METRE)).cast("int")
    cells = at.join(F.broadcast(ranges), "feature_name").crossJoin(F.broadcast(corner)).select(cell("lon", "_x").alias("ix"), cell("lat", "_y").alias("iy"), "feature_name", "_o", scaled.alias("_v"))
    channels = [F.coalesce(F.max_by(F.when(F.col("feature_name") == n, F.col("_v")), F.when(F.col("feature_name") == n, F.col("_o"))), F.lit(0.0)).alias(n) for n in names]
    filled = cells.groupBy("ix", "iy").agg(*channels).withColumn("mask", F.lit(1))
    ends = at.agg(*[F.rint((F.max(c) - F.min(c)) / (step_m * geo.DEGREES_PER_METRE)).cast("int").alias(n) for c, n in (("lon", "_w"), ("lat", "_h"))]).where("_w IS NOT NULL")
    grid = ends.withColumn("ix", F.explode(F.sequence(F.lit(0), "_w"))).withColumn("iy", F.explode(F.sequence(F.lit(0), "_h"))).select("ix", "iy")
    return grid.join(filled, ["ix", "iy"], "left").fillna(0, [*names, "mask"])


def pixels_to_points(pixels: DataFrame, box: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """Adds lon and lat of pixels (row, col) of an image over min_lon, max_lon, min_lat, max_lat; the first and last lie on the box."""
    a, b, c, d = box
    step = lambda k, low, high, n: low + F.col(k) * F.lit((high - low) / max(n - 1, 1))
    return pixels.withColumns({"lon": step("col", a, b, width), "lat": step("row", c, d, height)})


def label_by_band(images: DataFrame, tile: list[str], channel: str, value: str) -> DataFrame:
    """(tile, bands): the values of each tile's channels in the channels' order."""
    stacked = images.groupBy(*tile).agg(F.array_sort(F.collect_list(F.struct(channel, value))).alias("bands"))
    return stacked.withColumn("bands", F.transform("bands", lambda x: x[value]))
