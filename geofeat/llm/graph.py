"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofeat.sources.shared import Scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round a node takes the smallest label among its neighbours' and then the
    label of its label, so paths shrink at least by half; it ends when no label
    changes. Labels are written to the shared folder every round. A node with very many
    edges is a minimum with partial sums and a join that Spark may split, never a
    gathered list. Null nodes and loops are left out.
    """
    spark = edges.sparkSession
    with Scratch(spark) as keep:
        ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
        both = keep(ends.union(ends.select("v", "u")).distinct())
        labels = keep(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component")))
        while True:
            near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("near"))
            closer = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
            jump = labels.select(F.col("node").alias("next"), F.col("component").alias("root"))
            moved = keep(closer.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("root", "next")).alias("next")))
            labels = moved.select("node", F.col("next").alias("component"))
            if not moved.where("component <> next").limit(1).count():
                return written(labels)
