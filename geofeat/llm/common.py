"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofeat.sources.shared import written

__all__ = ["SLICE", "held_out", "passing", "place", "read", "slices", "written"]

#: Rows of one Arrow batch which Python handles at once; bounds the memory of a task.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batch, size: int = SLICE):
    """Cuts an Arrow batch into smaller ones."""
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def place(df: DataFrame, name: str) -> int:
    """Where a column stands; its name counts as Spark counts names, without regard to case."""
    return [c.lower() for c in df.columns].index(name.lower())


def passing(df: DataFrame, new: list[str]) -> list[int]:
    """Places of the columns which pass through beside new ones; those of a new one's name do not."""
    taken = {c.lower() for c in new}
    return [i for i, c in enumerate(df.columns) if c.lower() not in taken]
