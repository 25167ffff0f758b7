"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only where that setting is unset, as in tests on one machine, a local temporary
    folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the frame as Parquet to the shared folder and reads it again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Rounds:
    """Writes the table of each round of an iteration, as ``written`` does, and deletes the one before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def __call__(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        df.write.parquet(path)
        if self.path:
            delete(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables which are deleted when the block ends; what outlives it has to be written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)
