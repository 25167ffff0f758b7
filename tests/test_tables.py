import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofeat.operators import tables as tb
from geofeat.plans import registry


def test_read_layer_and_append(spark, tmp_path):
    path = str(tmp_path / "layer")
    df = spark.createDataFrame([(1, "POINT (1 2)", "yes")], "obj_id long, wkt string, shop string")
    tb.append(df, path)
    tb.append(df.withColumn("obj_id", F.lit(2).cast("long")), path)
    got = tb.read_layer(spark, path, ["obj_id", "wkt", "height"]).orderBy("obj_id").collect()
    assert [r.obj_id for r in got] == [1, 2] and got[0].geom.kind == "POINT" and got[0].geom.parts[0][0].lat == 2


def test_experiments(spark, tmp_path):
    path = str(tmp_path / "experiments")
    for ts in ("2020-01-01", "2020-02-01"):
        tb.save_experiment(spark.createDataFrame([(f"bla{ts}", "m")], "x string, model string"), path, ts)
    df = spark.read.parquet(path).withColumn("experiment_ts", F.col("experiment_ts").cast("string"))
    assert [r.x for r in tb.load_experiment(df).collect()] == ["bla2020-02-01"]
    assert [r.x for r in tb.load_experiment(df, "2020-01-01").collect()] == ["bla2020-01-01"]
    assert tb.existing_models(df).collect() == [("m",)]


def test_point_csv(spark, tmp_path):
    path = tmp_path / "houses.csv"
    path.write_bytes("long,lat,rooms,price,name\n1.5,2.5,3,100,caf\xe9\n".encode("latin-1"))
    assert tuple(tb.read_point_csv(spark, str(path), "long", "lat", ["rooms"], "price").first()) == (1.5, 2.5, 3.0, 100.0)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, name string, v double")
    updates = spark.createDataFrame([(2, "x", None), (3, "c", 3.0)], "k long, name string, v double")
    assert sorted(map(tuple, tb.upsert(target, updates, ["k"], ["v"]).collect())) == [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)]
    assert sorted(map(tuple, tb.upsert(target, updates.where("false"), ["k"], ["v"]).collect())) == sorted(map(tuple, target.collect()))


def test_upsert_keeps_one_row_of_a_key(spark):
    """The last of several updates, by its order or its value, whatever the partitions; the columns that are not updated are those of the first write."""
    target = spark.createDataFrame([(1, "a", 1.0), (None, "n", 0.0)], "k long, name string, v double")
    updates = spark.createDataFrame([(1, "x", 2.0), (1, "y", 3.0), (2, "p", 5.0), (2, "q", 4.0), (None, "z", 9.0)], "k long, name string, v double")
    for parts in (1, 4):
        got = tb.upsert(target, updates.repartition(parts), ["k"], ["v"], ["name"])
        assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", 3.0), (2, "p", 4.0), (None, "n", 9.0)]
    assert sorted(map(tuple, tb.upsert(target, updates, ["k"], ["v"]).collect()), key=str) == [(1, "a", 3.0), (2, "q", 5.0), (None, "n", 9.0)]


def test_latest_version_breaks_ties(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, 1, None)], "k long, ts long, v string")
    for parts in (1, 3):
        assert sorted(map(tuple, tb.latest_version(rows.repartition(parts), ["k"], "ts").collect())) == [(1, 5, "b"), (2, 1, None)]


def test_hash_of_more_geometries_is_a_tree(spark, monkeypatch):
    monkeypatch.setattr(tb, "HASHED", 8)
    texts = sorted(f"POINT ({i} 2)" for i in range(100))
    rows = [f"{i},{x}\n" for i, x in enumerate(texts)]
    while len(rows) > 1:
        rows = [hashlib.md5("".join(rows[i : i + 8]).encode()).hexdigest() for i in range(0, len(rows), 8)]
    assert tb.hash_geoms(spark.createDataFrame([(x,) for x in texts[::-1]], "wkt string").repartition(5)).collect() == [(rows[0],)]


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (3, 5), (0, 2)])
def test_kfold_sizes(spark, n, k):
    folds = [r.fold for r in tb.kfold(spark.range(n), k, ["id"]).orderBy("id").collect()]
    assert folds == [f for f in range(k) for _ in range(n // k + (f < n % k))]


def test_negative_sampling(spark):
    df = spark.range(20).withColumn("label", F.when(F.col("id") < 4, 1.0).otherwise(0.0))
    got = tb.negative_sampling(df, 1.5, 3, "id")
    assert got.where("label = 1").count() == 4 and got.where("label = 0").count() == 6
    assert sorted(got.collect()) == sorted(tb.negative_sampling(df.repartition(5), 1.5, 3, "id").collect())


def test_tiles(spark):
    pixels = spark.range(60).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").alias("v"))
    tiles = tb.image_to_tiles(pixels, 5, 6, 10)
    assert tiles.groupBy("tile_row", "tile_col").count().collect() and tiles.count() == 50
    again = tb.tiles_to_image(tiles.drop("row", "col"), 5)
    assert again.where("row * 10 + col <> v").count() == 0


def test_distance_correlation_of_all_rows(spark, tmp_path):
    x = np.random.default_rng(3).random((620, 12)) * np.linspace(0.2, 3, 620)[:, None]
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    far = lambda y: np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)).ravel()
    expected = np.corrcoef(far(x), far(2 * x[:, :8]))[0, 1]
    assert registry.queries()["x6_distance_correlation"](spark, str(tmp_path)).first()[0] == round(expected, 4)
    rows = spark.read.parquet(str(tmp_path / "embeddings.parquet")).select("vec_id", F.col("embedding").alias("a"), F.transform(F.slice("embedding", 1, 8), lambda y: y * 2).alias("b"))
    assert abs(tb.distance_correlation(rows, "vec_id", "a", "b", 150).first()[0] - expected) < 1e-9


def test_distance_correlation_of_copies_far_from_zero(spark):
    """Blocks in one order, copies of a row in two blocks, and vectors whose lengths dwarf their distances."""
    x = np.random.default_rng(4).random((90, 5)) + 1e5
    x = np.concatenate([x, x])
    far = lambda y: np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)).ravel()
    rows = spark.createDataFrame([(i, r.tolist(), r[:2].tolist()) for i, r in enumerate(x)], "k long, a array<double>, b array<double>")
    assert abs(tb.distance_correlation(rows, "k", "a", "b", 40).first()[0] - np.corrcoef(far(x), far(x[:, :2]))[0, 1]) < 1e-9


def test_distance_correlation_meets_two_blocks_once(spark, monkeypatch):
    """The sixteen pairs of four blocks are ten groups."""
    x = np.random.default_rng(5).random((4000, 3))
    rows = spark.createDataFrame([(i, r.tolist(), r[:2].tolist()) for i, r in enumerate(x)], "k long, a array<double>, b array<double>")
    plan = tb.distance_correlation(rows, "k", "a", "b", 1_000)._jdf.queryExecution().toString()
    assert "hashpartitioning(row" in plan and ", 10)" in plan


def test_hash_of_geometries_gathers_no_array(spark, monkeypatch):
    monkeypatch.delattr(tb.F, "collect_set")
    texts = [f"POINT ({i} 2)" for i in range(300)] + [f"LINESTRING ({i} 2, 3 4)" for i in range(300)]
    df = spark.createDataFrame([(x,) for x in [*texts, *texts[::-3], None]], "wkt string")
    lines = (f'{i},"{x}"\n' if "," in x else f"{i},{x}\n" for i, x in enumerate(sorted(texts)))
    assert tb.hash_geoms(df.repartition(7)).collect() == [(hashlib.md5("".join(lines).encode()).hexdigest(),)]
    assert tb.hash_geoms(df.where("false")).collect() == [(hashlib.md5(b"").hexdigest(),)]
