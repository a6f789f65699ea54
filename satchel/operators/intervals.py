"""Points in intervals by equality joins, however long the intervals and however fine the scale.

Blocks have 2**level units and begin at a multiple of their length. An interval is covered by blocks of one level, about an
eighth of it long, so that a stay of a year in milliseconds is nine rows at most, not thirty thousand million. A point lies in
one block of each level that intervals have. Both sides meet in level and block, and the bounds are compared where they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An interval has 2**FINE + 1 blocks at most. Blocks that are broadcast; where there are more, points and blocks are shuffled.
FINE, BROADCAST = 3, 1 << 17


def dyadic(low: Column, high: Column) -> Column:
    """Array of (level, block) that cover the whole numbers from ``low`` to ``high``, each once; empty if there are none."""
    low, high = low.cast("long"), high.cast("long")

    def at(k: Column) -> Column:
        first, end = -F.call_function("shiftright", -low, k), F.call_function("shiftright", high + 1, k)
        left = F.when((first < end) & (first % 2 != 0), first)
        right = F.when((first < end) & (end % 2 != 0), end - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda b: F.struct(k.alias("level"), b.alias("block")))

    levels = F.sequence(F.lit(0), F.length(F.bin(high - low + 1)))
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    return F.when(low <= high, F.flatten(F.transform(levels, at))).otherwise(none)


def _blocks(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Intervals by the blocks that cover them: the columns but the bounds, __low, __high, __level, __block."""
    bounds = intervals.select(*[c for c in intervals.columns if c not in (low, high)], F.col(low).cast("long").alias("__low"), F.col(high).cast("long").alias("__high")).where("__low <= __high")
    placed = bounds.withColumn("__level", F.greatest(F.length(F.bin(F.col("__high") - F.col("__low") + 1)) - FINE, F.lit(0)))
    first, last = (F.call_function("shiftright", F.col(c), F.col("__level")) for c in ("__low", "__high"))
    return placed.withColumn("__block", F.explode(F.sequence(first, last)))


def within(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of ``points`` with those of ``intervals`` that hold their whole number ``at``, ends included; the columns of both
    but the bounds. Rows with nulls there meet nothing. The driver sees how many blocks each level has, of 64 at most; it never
    holds more than BROADCAST of them. With more, the range of the points is read first, and intervals outside it are left out."""
    own = points.where(F.col(at).isNotNull()).withColumn("__at", F.col(at).cast("long"))

    def counted() -> dict[int, int]:
        return {r["__level"]: r.n for r in blocks.groupBy("__level").agg(F.count("*").alias("n")).collect()}

    blocks = _blocks(intervals, low, high)
    levels = counted()
    if sum(levels.values()) > BROADCAST:
        least, most = own.agg(F.min("__at"), F.max("__at")).first()
        blocks = _blocks(intervals.where((F.col(high) >= least) & (F.col(low) <= most)), low, high)
        levels = counted()
    if not levels:
        return points.join(blocks.drop("__low", "__high", "__level", "__block"), F.lit(False))
    places = F.array(*(F.struct(F.lit(k).alias("__level"), F.shiftright("__at", k).alias("__block")) for k in sorted(levels)))
    placed = own.select("*", F.explode(places).alias("__p")).select("*", "__p.*").drop("__p")
    blocks = blocks.hint("broadcast" if sum(levels.values()) <= BROADCAST else "merge")
    met = placed.join(blocks, ["__level", "__block"]).where("__at BETWEEN __low AND __high")
    return met.drop("__level", "__block", "__at", "__low", "__high")
