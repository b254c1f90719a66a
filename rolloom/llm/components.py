"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.session import materialize, remove, scratch_path


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema("v bigint, u bigint").parquet(path), path


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = pairs.select(F.col("u").alias("x"), F.col("v").alias("n")).union(pairs.select("v", "u"))
    least = both.groupBy("x").agg(F.min("n").alias("m"))
    least = least.select("x", F.least("x", "m").alias("m"))
    moved = pairs.join(least, pairs["u"] == least["x"]).select("v", F.col("m").alias("u"))
    return moved.distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "x")
    moved = pairs.join(least, pairs["v"] == least["x"])
    up = moved.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return up.union(least.select("x", "m")).distinct()


def _is_stars(pairs: DataFrame) -> bool:
    """Every node hangs on one centre, and no centre hangs on another."""
    many = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v")
    chained = pairs.select(F.col("u").alias("v")).join(pairs.select("v"), "v", "left_semi")
    return many.union(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the links ``(a, b)``; label is the smallest node reached.

    Links and labels stay in tables; the driver only learns whether a round changed anything. A
    round's table is written to the shared folder, which cuts the lineage, and the one before it is
    removed. The number of rounds grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    pairs = links.filter("a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")
    )
    pairs, path = _written(pairs.distinct(), "links")
    while not _is_stars(pairs):
        large, large_path = _written(_large_star(pairs), "links")
        pairs, next_path = _written(_small_star(large), "links")
        remove(spark, path, large_path)
        path = next_path
    members = pairs.select(F.col("v").alias("node"), F.col("u").alias("label"))
    centres = pairs.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    result = materialize(members.union(centres), "components")
    remove(spark, path)
    return result


def component_minimum(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component_id)``: the smallest ``min_id`` of any node reached, for all ``nodes``.

    ``nodes`` holds (node, min_id), ``links`` (a, b). Only linked nodes take part in the search.
    """
    labels = components(links)
    linked = nodes.join(labels, "node")
    best = linked.groupBy("label").agg(F.min("min_id").alias("component_id"))
    found = labels.join(best, "label").select("node", "component_id")
    alone = nodes.join(labels, "node", "left_anti")
    return found.union(alone.select("node", "min_id"))
