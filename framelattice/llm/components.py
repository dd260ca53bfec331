"""Connected components of an edge table by alternating stars; state is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node with an edge a - b. Longs; self edges and repeats are ignored.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest; rounds end when all edges point at
    roots. Neighbour sets are only ever aggregated to their minimum, so a node with very many is no single row.
    """
    now = base.stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u")))
        after = base.stored(small.where("u < v").distinct(), "edges")
        # Stable when no node has two smaller neighbours and no smaller neighbour has one itself.
        loose = after.groupBy("v").count().where("count > 1").limit(1).count() or after.join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        now = after
        if not loose:
            break
    roots = now.select("u").distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
