"""Uniform points of polygons, an exact number for each, without rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.functions.hashed import unit

#: Points that one row spreads into at a time.
DRAWS = 4_096


def trapezoids(polys: DataFrame, key: str) -> DataFrame:
    """Areas (key, geom) cut into trapezoids at the longitudes of their vertices.

    Returns key, a and b (the sides' longitudes), low_a, low_b, high_a and high_b (latitudes
    of the lower and upper edge at either side). Between two neighbouring
    longitudes no ring has a vertex, so edges sorted by latitude enclose the area between the first and
    second, third and fourth, and so on; holes and further parts follow by themselves.
    Rings must not cross each other. An edge goes to the slabs it spans, so no edge meets all the others.
    """
    left = F.col("_e.a.lon") < F.col("_e.b.lon")
    ends = {f"{c}{i}": F.when(left, F.col(f"_e.{p}.{n}")).otherwise(F.col(f"_e.{q}.{n}")) for i, p, q in ((1, "a", "b"), (2, "b", "a")) for c, n in (("x", "lon"), ("y", "lat"))}
    areal = polys.where(F.col("geom.kind").endswith("POLYGON"))
    edges = areal.select(key, F.posexplode(geo.segments(F.col("geom"))).alias("_i", "_e")).where("_e.a.lon <> _e.b.lon").select(key, "_i", *[c.alias(n) for n, c in ends.items()])
    cuts = edges.withColumn("x", F.explode(F.array("x1", "x2"))).withColumn("n", F.dense_rank().over(W.partitionBy(key).orderBy("x")))
    spans = cuts.groupBy(key, "_i", *ends).agg(F.min("n").alias("_from"), F.max("n").alias("_to"))
    slabs = cuts.groupBy(key, "n").agg(F.min("x").alias("a")).withColumn("b", F.lead("a").over(W.partitionBy(key).orderBy("n"))).where("b IS NOT NULL")
    at = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) * ((F.col(x) - F.col("x1")) / (F.col("x2") - F.col("x1")))
    sides = spans.withColumn("n", F.explode(F.sequence("_from", F.col("_to") - 1))).join(slabs, [key, "n"]).select(key, "n", "a", "b", "_i", at("a").alias("low_a"), at("b").alias("low_b"))
    upwards = W.partitionBy(key, "n").orderBy(F.col("low_a") + F.col("low_b"), "_i")
    paired = sides.withColumns({"_r": F.row_number().over(upwards), "high_a": F.lead("low_a").over(upwards), "high_b": F.lead("low_b").over(upwards)})
    return paired.where((F.col("_r") % 2 == 1) & F.col("high_a").isNotNull()).select(key, "a", "b", "low_a", "low_b", "high_a", "high_b")


def sample_in_polygons(polys: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly n points (key, i, lon, lat), uniform in longitude and latitude, of each area (key, geom) with distinct keys.

    A trapezoid is drawn by its share of the area and a point by the trapezoid's heights,
    so thin and ragged areas cost no more than boxes. The trapezoids of an area are found by a guide
    of as many equal steps as it has trapezoids: every point meets two of them on average, at
    any number of vertices and points, and points of one area spread over the steps.
    Geometries without area, null ones and lines give no points.
    """
    inner = W.partitionBy(key)
    rise = inner.orderBy("a", "low_a", "low_b")
    height = lambda s: F.col(f"high_{s}") - F.col(f"low_{s}")
    sized = trapezoids(polys, key).withColumn("_area", (F.col("b") - F.col("a")) * (height("a") + height("b"))).where("_area > 0")
    summed = sized.withColumns({"_hi": F.sum("_area").over(rise.rowsBetween(W.unboundedPreceding, 0)), "_steps": F.count("*").over(inner)})
    shares = summed.withColumns({"_hi": F.col("_hi") / F.max("_hi").over(inner), "_lo": F.coalesce(F.lag("_hi").over(rise), F.lit(0.0)) / F.max("_hi").over(inner)})
    guide = shares.withColumn("_step", F.explode(F.sequence(F.floor(F.col("_lo") * F.col("_steps")), F.floor(F.col("_hi") * F.col("_steps"))))).drop("_steps")
    blocks = shares.groupBy(key).agg(F.count("*").alias("_steps")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // DRAWS))))
    drawn = blocks.withColumn("i", F.explode(F.sequence(F.col("_block") * DRAWS + 1, F.least(F.lit(n), (F.col("_block") + 1) * DRAWS))))
    drawn = drawn.withColumns({"_u": unit(seed, key, "i"), "_v": unit(seed + 1, key, "i"), "_w": unit(seed + 2, key, "i")}).withColumn("_step", F.floor(F.col("_u") * F.col("_steps")))
    met = drawn.join(guide, [key, "_step"]).where((F.col("_lo") <= F.col("_u")) & (F.col("_u") < F.col("_hi")))
    ha, hb = height("a"), height("b")
    along = F.col("_v") * (ha + hb) / (ha + F.sqrt(ha * ha + F.col("_v") * (hb * hb - ha * ha)))
    placed = met.withColumn("_s", F.when(F.col("_v") > 0, along).otherwise(0.0))
    low, high = (F.col(f"{e}_a") + (F.col(f"{e}_b") - F.col(f"{e}_a")) * F.col("_s") for e in ("low", "high"))
    return placed.select(key, "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("_s")).alias("lon"), (low + (high - low) * F.col("_w")).alias("lat"))
