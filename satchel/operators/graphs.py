"""Connected components by contraction to stars, in rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.session import work_folder


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours, those above it (large) or below it, to its least neighbour or itself.

    Neighbours of a node are counted and joined by key, never gathered, so that a node of any degree is spread by the join."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        out = down.join(least, "a").select("b", "least").toDF("a", "b").unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its least node, for every node of ``edges`` (a, b) that has a neighbour. Each round is
    checkpointed; their number grows with the logarithm of the longest path."""
    work_folder(edges.sparkSession)  # checkpoints need a folder
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        new = _stars(_stars(now, True), False).checkpoint()
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            break
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
