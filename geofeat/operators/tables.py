"""Table operators: stores with upserts, pivots, samples, folds, labels, metrics, rasters, time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geofeat.functions import geo
from geofeat.functions.hashed import digest, unit
from geofeat.sources.shared import written

# --- scans, sinks, versions


def read_layer(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An object layer; a ``wkt`` column becomes ``geom``."""
    df = spark.read.parquet(path)
    df = df.select(*[c for c in columns if c in df.columns]) if columns else df
    return df.withColumn("geom", geo.from_wkt(F.col("wkt"))) if "wkt" in df.columns else df


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key of both: ``update_cols`` from its last write, the other columns from its first.

    Rows of ``updates`` are later than those of ``target``, and among themselves go by
    ``order``, or else by the values written, of which the largest counts as the last.
    One aggregation over both tables; null keys are one key.
    """
    order = order or update_cols
    rest = [c for c in target.columns if c not in {*keys, *update_cols}]
    both = target.withColumn("_later", F.lit(0)).unionByName(updates.select(*target.columns, F.lit(1).alias("_later")))
    at = F.struct("_later", *order)
    last = F.max_by(F.struct(*update_cols), at).alias("_last")
    first = [F.min_by(F.struct(*rest), at).alias("_first")] if rest else []
    out = both.groupBy(*keys).agg(last, *first)
    return out.select(*[F.col(f"_last.{c}") if c in update_cols else F.col(f"_first.{c}") if c in rest else F.col(c) for c in target.columns])


def stage_inputs(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Gives every row a dense geom_id 0..n-1 in the given order.

    Rows are dealt out by ranges of the order, once, into a written table, as ranges
    drawn a second time could differ; each range counts its own rows, and a table of
    one row per range gives the offsets, so no task sees all rows.
    """
    dealt = written(df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order_by)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("geom_id", (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def running_total(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``_total``, the sum of a column of whole numbers up to each row in the order of another, which has no ties; by ranges, as ``stage_inputs``."""
    dealt = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.sum(value).alias("_n_part"))
    offsets = sizes.select("_part", (F.sum("_n_part").over(W.orderBy("_part")) - F.col("_n_part")).alias("_before"))
    own = F.sum(value).over(W.partitionBy("_part").orderBy(order))
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("_total", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def replicate_table(src: DataFrame, geom_col: str, drop: list[str], limit: int | None = None) -> DataFrame:
    df = src.drop(*drop).withColumnRenamed(geom_col, "way")
    return df.limit(limit) if limit else df


def read_point_csv(spark: SparkSession, path: str, lon: str, lat: str, features: list[str], target: str, encoding: str = "ISO-8859-1") -> DataFrame:
    df = spark.read.csv(path, header=True, encoding=encoding)
    return df.select(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("target"))


def dedupe_lines(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return df.groupBy(col).agg(F.min(F.struct(*order)).alias("first")).select(col, *[F.col(f"first.{c}").alias(c) for c in order])


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *df.columns)


def save_experiment(df: DataFrame, path: str, ts: str) -> None:
    df.withColumn("experiment_ts", F.lit(ts)).write.mode("append").partitionBy("experiment_ts").parquet(path)


def load_experiment(df: DataFrame, ts: str | None = None) -> DataFrame:
    """Rows of one time stamp, or of the latest."""
    if ts is not None:
        return df.where(F.col("experiment_ts") == ts)
    return df.join(F.broadcast(df.agg(F.max("experiment_ts").alias("experiment_ts"))), "experiment_ts", "left_semi")


def existing_models(df: DataFrame) -> DataFrame:
    return df.select("model").distinct()


def load_model_results(spark: SparkSession, path: str, ts: str | None = None) -> DataFrame:
    """Results of all models of one time stamp, or of the latest; without any row where nothing is stored at the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "model string, experiment_ts string")
    stored = spark.read.parquet(path)
    return load_experiment(stored.withColumn("experiment_ts", F.col("experiment_ts").cast("string")), ts)


def pair_tiles(images: DataFrame, features: DataFrame, on: str, values: str, nan_value: float = 1e3) -> DataFrame:
    """Image rows with their feature rows; NaN features become ``nan_value``."""
    return images.join(features, on).withColumn(values, nan_to(F.col(values), nan_value))


def nan_to(values: Column, v: float) -> Column:
    return F.transform(values, lambda x: F.when(F.isnan(x), F.lit(v)).otherwise(x))


# --- stores


def pivot_features(long: DataFrame, names: list[str], by: list[str] = ["geom_wkt_hash", "geom_wkt"]) -> DataFrame:
    return long.groupBy(*by).pivot("feature_name", names).agg(F.first("feature_value"))


def unpivot_features(wide: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return wide.unpivot(keys, names, "feature_name", "feature_value")


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def select_features(store: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Stored rows of the named features, or of all for None; of none for an empty list."""
    return store if names is None else store.where(F.col("feature_name").isin(names))


def load_features(inputs: DataFrame, store: DataFrame, names: list[str]) -> DataFrame:
    """Stored features of the inputs (geom_id, geom_wkt), null where missing."""
    hashed = inputs.withColumn("geom_wkt_hash", geo.geom_hash(F.col("geom_wkt")))
    wanted = select_features(store, names).join(hashed.select("geom_wkt_hash").distinct(), "geom_wkt_hash", "left_semi")
    wide = wanted.groupBy("geom_wkt_hash").pivot("feature_name", names).agg(F.first("feature_value"))
    return hashed.join(wide, "geom_wkt_hash", "left").select("geom_id", *names)


def save_features(store: DataFrame, wide: DataFrame, names: list[str], now: Column) -> DataFrame:
    """The store after wide rows (geom_wkt and features) were put in."""
    keyed = wide.withColumn("geom_wkt_hash", geo.geom_hash(F.col("geom_wkt")))
    rows = unpivot_features(keyed, names, ["geom_wkt_hash", "geom_wkt"]).withColumn("modification_date", now)
    return upsert(store, rows, ["geom_wkt_hash", "feature_name"], ["feature_value", "modification_date"])


def missing_features(inputs: DataFrame, store: DataFrame, names: list[str]) -> DataFrame:
    """Requested features which are not stored for all inputs; a null counts as missing."""
    spark = inputs.sparkSession
    hashed = inputs.select(geo.geom_hash(F.col("geom_wkt")).alias("geom_wkt_hash")).distinct()
    stored = store.where(F.col("feature_value").isNotNull()).join(hashed, "geom_wkt_hash", "left_semi").groupBy("feature_name").agg(F.countDistinct("geom_wkt_hash").alias("n"))
    total = hashed.agg(F.count("*").alias("total"))
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("feature_name"))
    full = stored.join(F.broadcast(total), F.col("n") == F.col("total"))
    return asked.join(full, "feature_name", "left_anti")


#: What a stored score is known by; the hash is that of the rows which the model was trained on.
SCORE_KEYS = ["geom_wkt_hash", "experiment", "model", "train_hash"]


def save_scores(store: DataFrame, probas: DataFrame, models: list[str], experiment: str, train_hash: str, now: Column) -> DataFrame:
    """The store (``SCORE_KEYS``, geom_wkt, score, modification_date) after probabilities (geom_wkt, one column a model) were put in.

    A score of the same geometry, experiment, model and training rows is replaced.
    """
    keyed = probas.select(geo.geom_hash(F.col("geom_wkt")).alias("geom_wkt_hash"), "geom_wkt", *models)
    rows = keyed.unpivot(["geom_wkt_hash", "geom_wkt"], models, "model", "score")
    rows = rows.withColumns({"experiment": F.lit(experiment), "train_hash": F.lit(train_hash), "modification_date": now})
    return upsert(store, rows, SCORE_KEYS, ["geom_wkt", "score", "modification_date"])


def score_join(met: DataFrame, store: DataFrame, experiment: str, model: str, train_hash: str) -> DataFrame:
    """Pairs (wkt, ...) with the stored ``scores`` of their objects by one experiment, model and set of training rows; pairs without are left out."""
    known = store.where((F.col("experiment") == experiment) & (F.col("model") == model) & (F.col("train_hash") == train_hash))
    # sizes are guessed from files, so no side may be taken for a small one
    return met.hint("merge").join(known.select(F.col("geom_wkt").alias("wkt"), F.col("score").alias("scores")), "wkt")


#: Lines, or digests, under one digest of ``hash_geoms``.
HASHED = 1_024


def hash_geoms(df: DataFrame, wkt: str = "wkt") -> DataFrame:
    """md5 of a set of geometries, the same for any order and any repetition.

    The distinct texts are sorted and numbered, each a line. Up to ``HASHED`` lines give
    the md5 of all of them; more give a tree, in which each ``HASHED`` neighbours are
    hashed and their digests are the next level's lines. Every level is an aggregation, so no task
    and not the driver holds more than one node's lines.
    """
    quoted = lambda x: F.when(x.contains(","), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)
    numbered = stage_inputs(df.select(F.col(wkt).alias("wkt")).where("wkt IS NOT NULL").distinct(), ["wkt"])
    rows = numbered.select(F.col("geom_id").alias("at"), F.concat(F.col("geom_id").cast("string"), F.lit(","), quoted(F.col("wkt")), F.lit("\n")).alias("line"))
    n = numbered.count()
    while True:
        block = rows.groupBy(F.floor(F.col("at") / HASHED).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
        rows, n = block.select("at", F.md5(F.array_join(F.col("lines.line"), "")).alias("line")), -(-n // HASHED)
        if n <= 1:
            return rows.agg(F.coalesce(F.max("line"), F.md5(F.lit(""))).alias("hash"))


# --- folds, samples, labels


def kfold(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Contiguous folds; the first n mod k have one row more."""
    staged = stage_inputs(df, order).withColumnRenamed("geom_id", "_at")
    n = df.agg(F.count("*").alias("_n"))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    long_rows = more * (size + 1)
    fold = F.when(F.col("_at") < long_rows, F.floor(F.col("_at") / (size + 1))).otherwise(more + F.floor((F.col("_at") - long_rows) / F.greatest(size, F.lit(1))))
    return staged.join(F.broadcast(n), F.lit(True)).withColumn("fold", fold.cast("int")).drop("_at", "_n")


def ranked(df: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """Adds ``rank`` 1..n by a total order, without a single-task window."""
    named = [c.alias(f"_k{i}") for i, c in enumerate(order)]
    sort = df.select("*", *named)
    names = [f"_k{i}" for i in range(len(order))] + keys
    return stage_inputs(sort, names).withColumn("rank", F.col("geom_id") + 1).drop("geom_id", *names[: len(order)])


def top_percent(df: DataFrame, score: str, pct: float, key: str) -> DataFrame:
    n = df.agg(F.floor(F.count("*") * pct / 100).alias("_keep"))
    return ranked(df, [-F.col(score)], [key]).join(F.broadcast(n), F.lit(True)).where(F.col("rank") <= F.col("_keep")).drop("rank", "_keep")


def latest_version(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The row of the latest time of each key; of several of one time that with the largest values, column by column."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("_ts"), *rest)).alias("_x"))
    return newest.select(*[F.col(f"_x.{c}") if c in rest else F.col(c) for c in df.columns])


def expand_folds(objects: DataFrame, folds: DataFrame, key: str = "source_idx") -> DataFrame:
    """Objects with the ``fold`` of the area (key, fold) that they come from; objects of no fold are left out."""
    return objects.join(folds.select(key, "fold"), key)


def union_samples(positive: DataFrame, negative: DataFrame, label: str = "label") -> DataFrame:
    """Positives with label 1 above negatives with label 0; columns are matched by name, an old label is replaced."""
    return positive.withColumn(label, F.lit(1.0)).unionByName(negative.withColumn(label, F.lit(0.0)))


def random_rank(key: str, seed: int) -> list[Column]:
    """A repeatable random order that does not depend on partitions."""
    return [digest(seed, key), F.col(key)]


def negative_sampling(df: DataFrame, ratio: float, seed: int, key: str, label: str = "label") -> DataFrame:
    """All positives, and ``int(ratio * positives)`` random negatives at most."""
    positives, negatives = df.where(F.col(label) > 0), df.where(F.col(label) <= 0)
    n = positives.agg(F.floor(F.count("*") * ratio).alias("_n"))
    picked = ranked(negatives, random_rank(key, seed)[:1], [key]).join(F.broadcast(n), F.lit(True)).where(F.col("rank") <= F.col("_n")).drop("rank", "_n")
    return positives.unionByName(picked)


def train_test_split(df: DataFrame, test_size: float, seed: int, key: str) -> DataFrame:
    """Adds ``is_test``; ceil(n * test_size) random rows are test rows."""
    n = df.agg(F.ceil(F.count("*") * test_size).alias("_n"))
    return ranked(df, random_rank(key, seed)[:1], [key]).join(F.broadcast(n), F.lit(True)).withColumn("is_test", F.col("rank") <= F.col("_n")).drop("rank", "_n")


def soft_label(dist_m: Column, radius: float) -> Column:
    """1 at a true geometry, falling to 0 at the radius; 0 without one."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - dist_m / radius), F.lit(0.0))


def sample_in_range(spark: SparkSession, box: tuple[float, float, float, float], n: int, seed: int) -> DataFrame:
    """n uniform points (id from 0, lon, lat) of min_lon, max_lon, min_lat, max_lat."""
    a, b, c, d = box
    if not (a < b and c < d):
        raise ValueError("empty range")
    return spark.range(n).select("id", (a + (b - a) * unit(seed, "id")).alias("lon"), (c + (d - c) * unit(seed + 1, "id")).alias("lat"))


def grid_in_range(df: DataFrame, step: float) -> DataFrame:
    """Grid points (ix, iy, lon, lat) of boxes min_lon .. max_lat; ends excluded."""
    count = lambda a, b: F.ceil((F.col(b) - F.col(a)) / step).cast("int")
    cells = lambda a, b: F.when(count(a, b) > 0, F.sequence(F.lit(0), count(a, b) - 1)).otherwise(F.array().cast("array<int>"))
    xs = df.withColumn("ix", F.explode(cells("min_lon", "max_lon")))
    ys = xs.withColumn("iy", F.explode(cells("min_lat", "max_lat")))
    return ys.withColumn("lon", F.col("min_lon") + F.col("ix") * step).withColumn("lat", F.col("min_lat") + F.col("iy") * step)


# --- metrics


def soft_prf(df: DataFrame, threshold: float = 0.5, y: str = "y", proba: str = "proba") -> DataFrame:
    hit = F.when(F.col(proba) >= threshold, 1.0).otherwise(0.0)
    sums = df.agg(F.sum(F.col(y) * hit).alias("both"), F.sum(hit).alias("predicted"), F.sum(y).alias("true"), F.count("*").alias("n"))
    p, r = F.col("both") / F.nullif(F.col("predicted"), F.lit(0.0)), F.col("both") / F.nullif(F.col("true"), F.lit(0.0))
    return sums.select(p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f_score"), "n")


def soft_pr_curve(df: DataFrame, by: list[str] = [], y: str = "y", proba: str = "proba") -> DataFrame:
    """Precision and recall at 201 thresholds, from one pass: each row counts how many thresholds it reaches."""
    reached = F.aggregate(F.sequence(F.lit(0), F.lit(200)), F.lit(0), lambda s, i: s + F.when(i * F.lit(0.005) <= F.col(proba), 1).otherwise(0))
    binned = df.withColumn("at", reached - 1).groupBy(*by, "at").agg(F.sum(y).alias("y"), F.count("*").alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.crossJoin(F.broadcast(df.sparkSession.range(201).select(F.col("id").cast("int").alias("i")))) if by else df.sparkSession.range(201).select(F.col("id").cast("int").alias("i"))
    total = binned.groupBy(*by).agg(F.sum("y").alias("all_y"))
    cells = grid.join(binned.withColumnRenamed("at", "i"), [*by, "i"], "left").fillna(0, ["y", "n"])
    down = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(F.col("i").desc())
    summed = cells.withColumn("both", F.sum("y").over(down)).withColumn("predicted", F.sum("n").over(down))
    joined = summed.join(total, by) if by else summed.crossJoin(F.broadcast(total))
    return joined.select(*by, "i", (F.col("i") * F.lit(0.005)).alias("threshold"), F.coalesce(F.col("both") / F.nullif(F.col("predicted"), F.lit(0)), F.lit(0.0)).alias("precision"), (F.col("both") / F.nullif(F.col("all_y"), F.lit(0.0))).alias("recall"))


def soft_auc(curve: DataFrame, by: list[str] = []) -> DataFrame:
    """Area under precision over recall by trapezoids."""
    along = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("i")
    steps = curve.withColumn("r0", F.lag("recall").over(along)).withColumn("p0", F.lag("precision").over(along))
    area = F.sum((F.col("r0") - F.col("recall")) * (F.col("precision") + F.col("p0")) / 2).alias("auc")
    return steps.groupBy(*by).agg(area) if by else steps.agg(area)


def rmse_by_head(df: DataFrame, by: str, pred: str, y: str) -> DataFrame:
    return df.groupBy(by).agg(F.sqrt(F.avg(F.pow(F.col(pred) - F.col(y), 2))).alias("rmse"))


def vector_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


#: Rows of either side whose distances are worked out at once, so that they stay in a cache.
CORRELATED_AT_ONCE = 256
#: Multiplications of one matrix product: so few that the numerics library stays in the task's own thread, where it would else spin on the cores of others.
MULTIPLIED_AT_ONCE = 1 << 18


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y; |x|^2 + |y|^2 - 2xy, and where that cancels the difference itself."""
    lengths = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :]
    d2, z = np.empty((len(x), len(y))), np.ascontiguousarray(y.T) * -2.0
    step = max(1, MULTIPLIED_AT_ONCE // max(1, z.size))
    for k in range(0, len(x), step):
        np.matmul(x[k : k + step], z, out=d2[k : k + step])
    d2 += lengths
    i, j = np.nonzero(~(d2 > 1e-6 * lengths))
    for k in range(0, len(i), 65_536):
        at = slice(k, k + 65_536)
        gap = x[i[at]] - y[j[at]]
        d2[i[at], j[at]] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(d2, out=d2)


def distance_correlation(df: DataFrame, key: str, a: str, b: str, block: int = 16_384) -> DataFrame:
    """Pearson correlation of the two full pairwise distance matrices of vectors ``a`` and ``b`` (both orders and the diagonal included).

    Rows are dealt into blocks of ``block`` at most on average, smaller ones where there are few rows; each pair of
    blocks is a task's group, in one order only, which returns the sums of its distances, and the sums add up. A row goes
    to as many groups as there are blocks, and a task holds two blocks and the distances of a slice.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"), key)
    count = rows.count()
    n = max(1, -(-count // block), min(8, -(-count // 1_024)))
    sums = ("k", "u", "v", "uu", "vv", "uv")

    def run(table: pa.Table) -> pa.Table:
        own, i, j = (table.column(c).to_numpy() for c in ("own", "row", "column"))
        i, j = i[0], j[0]
        sides = []
        for name in ("a", "b"):
            lists = table.column(name).combine_chunks()
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            width = len(x) // len(own)
            if (lists.value_lengths().to_numpy() != width).any():
                raise ValueError("vectors differ in length")
            x = x.reshape(len(own), width)
            x = x - x.mean(0)  # distances stay, and lengths are not large beside them
            sides.append((x[own == i], x[own == j]))
        total, weight = np.zeros(6), 1.0 if i == j else 2.0
        for k in range(0, len(sides[0][0]), CORRELATED_AT_ONCE):
            for m in range(0, len(sides[0][1]), CORRELATED_AT_ONCE):
                u, v = (_distances(x[k : k + CORRELATED_AT_ONCE], y[m : m + CORRELATED_AT_ONCE]).ravel() for x, y in sides)
                total += weight * np.array([len(u), u.sum(), v.sum(), *(np.einsum("i,i->", s, t) for s, t in ((u, u), (v, v), (u, v)))])
        return pa.table({s: [float(x)] for s, x in zip(sums, total)})

    dealt = rows.withColumn("own", F.pmod(F.xxhash64(key), F.lit(n)))
    each = dealt.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    each = each.select("own", F.least("own", "_k").alias("row"), F.greatest("own", "_k").alias("column"), "a", "b")
    # a group is much work for few bytes, so partitions are not put together by their sizes
    parts = each.repartition(n * (n + 1) // 2, "row", "column").groupBy("row", "column").applyInArrow(run, ", ".join(f"{s} double" for s in sums))
    k, u, v, uu, vv, uv = (F.sum(s) for s in sums)
    spread = F.sqrt((k * uu - u * u) * (k * vv - v * v))
    return parts.agg(((k * uv - u * v) / F.nullif(spread, F.lit(0.0))).alias("correlation"))


def scaled_loss(pred: Column, y: Column) -> Column:
    return F.abs(F.log((pred + 1) / (y + 1)))


def multihead_loss(df: DataFrame, weights: dict[str, float], s: dict[str, float]) -> DataFrame:
    """Sum over heads (head, loss) of weight * exp(-s) * loss + s; heads without parameters are left out."""
    given = df.sparkSession.createDataFrame([(h, float(weights[h]), float(s[h])) for h in weights], "head string, _w double, _s double")
    terms = df.join(F.broadcast(given), "head")
    return terms.agg(F.sum(F.col("_w") * F.exp(-F.col("_s")) * F.col("loss") + F.col("_s")).alias("loss"))


def extreme_examples(df: DataFrame, by: str, key: str, pred: str, y: str) -> DataFrame:
    """Per head the keys of the largest and smallest pred - y (over, under) and pred + y (high, low); ties go to the smaller key."""
    gap, size = F.col(pred) - F.col(y), F.col(pred) + F.col(y)
    first = lambda c, name: F.min_by(key, F.struct(c.alias("a"), F.col(key).alias("b"))).alias(name)
    return df.groupBy(by).agg(first(-gap, "over"), first(gap, "under"), first(-size, "high"), first(size, "low"))


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = df.crossJoin(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in cols}
    return joined.withColumns(scaled).select(*df.columns)


def minmax(df: DataFrame, col: str) -> DataFrame:
    """Values scaled to [0, 1]; 0 where all are one value, null where null."""
    stats = df.agg(F.min(col).alias("_a"), F.max(col).alias("_b"))
    scaled = (F.col(col) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).withColumn(col, F.when(F.col(col).isNotNull(), F.coalesce(scaled, F.lit(0.0)))).select(*df.columns)


def sign_scale(df: DataFrame, col: str) -> DataFrame:
    """Positive values by their largest, negative ones by their largest size, then to [0, 1]."""
    stats = df.agg(F.max(F.when(F.col(col) > 0, F.col(col))).alias("_p"), F.max(F.when(F.col(col) < 0, -F.col(col))).alias("_n"))
    scaled = F.when(F.col(col) > 0, F.col(col) / F.col("_p")).when(F.col(col) < 0, F.col(col) / F.col("_n")).otherwise(0.0)
    return df.crossJoin(F.broadcast(stats)).withColumn(col, scaled / 2 + 0.5).select(*df.columns)


def score_histogram(df: DataFrame, label: str, value: str, bins: int = 20) -> DataFrame:
    """Density per label over equal bins of the shared range."""
    stats = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    binned = df.crossJoin(F.broadcast(stats)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("_a")) / width), F.lit(bins - 1)).cast("int")).withColumn("_w", width)
    counts = binned.groupBy(label, "bin", "_w").agg(F.count("*").alias("n"))
    totals = df.groupBy(label).agg(F.count("*").alias("total"))
    return counts.join(totals, label).select(label, "bin", (F.col("n") / (F.col("total") * F.col("_w"))).alias("density"))


# --- rasters and time


def rasterize(df: DataFrame, score: str, step_m: float, order: str) -> DataFrame:
    """Grid cells (ix, iy) of points with the scaled score of the last point written to each."""
    clean = minmax(df.where(F.col(score).isNotNull() & ~F.isnan(score)), score)
    step = step_m * geo.DEGREES_PER_METRE
    corner = clean.agg(F.min("lon").alias("_x"), F.min("lat").alias("_y"))
    cell = lambda a, o: F.rint((F.col(a) - F.col(o)) / step).cast("int")
    return clean.crossJoin(F.broadcast(corner)).groupBy(cell("lon", "_x").alias("ix"), cell("lat", "_y").alias("iy")).agg(F.max_by(score, order).alias(score))


def image_to_tiles(pixels: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Pixels (row, col) of whole tiles, with the tile's place and their place in it."""
    whole = pixels.where((F.col("row") < height // size * size) & (F.col("col") < width // size * size))
    return whole.select("*", F.expr(f"row div {size}").cast("int").alias("tile_row"), F.expr(f"col div {size}").cast("int").alias("tile_col"), (F.col("row") % size).cast("int").alias("in_row"), (F.col("col") % size).cast("int").alias("in_col"))


def tiles_to_image(tiles: DataFrame, size: int) -> DataFrame:
    return tiles.withColumn("row", F.col("tile_row") * size + F.col("in_row")).withColumn("col", F.col("tile_col") * size + F.col("in_col"))


def image_entropy(pixels: DataFrame, by: str, value: str, bins: int = 256) -> DataFrame:
    """Entropy in bits of each image's histogram over its own range."""
    of = W.partitionBy(by)
    low, high = F.min(value).over(of), F.max(value).over(of)
    ranged = pixels.withColumn("_a", low).withColumn("_b", high)
    b = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col(value) - F.col("_a")) * bins / (F.col("_b") - F.col("_a"))), F.lit(bins - 1))).otherwise(0)
    counts = ranged.groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(of)
    return counts.withColumn("p", p).groupBy(by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def time_bucket(ts: Column, unit: str = "minute") -> Column:
    if unit not in ("minute", "hour", "day"):
        raise ValueError(f"unit {unit} is not minute, hour or day")
    return F.date_trunc(unit, ts)


def time_intervals(df: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Consecutive intervals from start to end, the last one clipped."""
    step = F.expr(f"interval {minutes} minutes")
    starts = df.withColumn("from_ts", F.explode(F.sequence(F.col(start), F.col(end), step))).where(F.col("from_ts") < F.col(end))
    return starts.withColumn("to_ts", F.least(F.col("from_ts") + step, F.col(end)))


def parse_ts(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# --- grids of parameters


def param_grid(spark: SparkSession, spec: dict[str, list]) -> DataFrame:
    """All combinations of hyper-parameters; ``a_x__b`` counts only where a is x, and is null elsewhere."""
    out = spark.range(1).select()
    columns: list[str] = []
    for name, choices in spec.items():
        own = spark.createDataFrame([(str(c),) for c in choices], f"`{name}` string")
        condition = F.lit(True)
        owner = name.rpartition("__")[0]
        while owner:
            head, _, value = owner.rpartition("__")[2].rpartition("_")
            parent = next((c for c in columns if c == head or c.rpartition("__")[2] == head), None)
            condition &= (F.col(f"`{parent}`") == value) if parent else F.lit(False)
            owner = owner.rpartition("__")[0]
        out = out.crossJoin(own).withColumn(name, F.when(condition, F.col(f"`{name}`"))).distinct()
        columns.append(name)
    return out
