"""Connected components of a table of links, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.store import drop, materialize, new_path

MAX_ROUNDS = 50


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("least").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("least"))
    near = links.join(least, F.col("b") == F.col("node")).select(F.col("least").alias("a"), F.col("a").alias("b"))
    return near.union(least.select(F.col("least").alias("a"), F.col("node").alias("b"))).where("a < b").distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node of its component, for every node that is not its component's least.

    links: columns a < b (long). Rounds are few, as they are logarithmic in the number of nodes; each is written to the
    shared folder. MAX_ROUNDS is far beyond what any number of nodes needs: reaching it is an error, and raises one.
    No links give no rows.
    """
    spark = links.sparkSession
    state, path, sign = links.select("a", "b"), None, None
    for _ in range(MAX_ROUNDS):
        target = new_path(spark, "stars")
        new = materialize(_small_star(_large_star(state)), "stars", target)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if path:
            drop(spark, path)
        state, path = new, target
        if sign == now:
            return state.select(F.col("b").alias("node"), F.col("a").alias("component"))
        sign = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
