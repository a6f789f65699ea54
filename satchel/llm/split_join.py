"""Joins of whole documents with few keys, without shuffling the documents that surely have no partner.

A bitmap of the keys, of bounded size, is broadcast. Documents that miss it pass through; only the others are joined.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.anchors import bit_filter
from satchel.llm.store import broadcast, materialize


def split_by(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``key`` may be in the first column of ``keys``, and rows whose key surely is not."""
    name = keys.columns[0]
    shared = broadcast(docs.sparkSession, bit_filter(keys.select(F.xxhash64(name).alias("hash")), "hash"))

    @F.arrow_udf("boolean")
    def maybe(hashes: pa.Array) -> pa.Array:
        return pa.array(shared.value.test(hashes.to_numpy()))

    flagged = docs.withColumn("__maybe", maybe(F.xxhash64(key)))
    return flagged.where("__maybe").drop("__maybe"), flagged.where("not __maybe").drop("__maybe")


def without_keys(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in the first column of ``keys``; a null key equals a null key."""
    gone = keys.select(F.col(keys.columns[0]).alias("__gone")).distinct()
    maybe, rest = split_by(docs, F.col(key), gone)
    return rest.unionByName(maybe.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti"))


#: Rows of a key from which on they are spread over tasks, and the number of these.
HOT_ROWS, SALTS = 4096, 64


def spread_join(many: DataFrame, one: DataFrame, on: list[str], count: str) -> DataFrame:
    """``many`` joined with ``one``, which has one row a key and, as ``count``, how many rows that key has in ``many``. Those
    of a hot key are dealt to SALTS tasks, each of which gets its row of ``one``."""
    hot = materialize(one.where(F.col(count) > HOT_ROWS).select(F.xxhash64(*on).alias("hash")), "hot-keys")
    one = one.drop(count)
    if hot.isEmpty():
        return many.join(one, on)
    (hot_many, many), (hot_one, one) = (split_by(rows, F.xxhash64(*on), hot) for rows in (many, one))
    hot_many = hot_many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)))
    hot_one = hot_one.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return many.join(one, on).unionByName(hot_many.join(hot_one, [*on, "__salt"]).drop("__salt"))


def with_spans(work: DataFrame, spans: DataFrame) -> DataFrame:
    """``ord``, ``th``, ``text`` and ``spans`` (array of start, end) of the texts that have spans.

    spans: ord, th, start, stop. Texts that surely have none are filtered before the shuffle by a bitmap of bounded size.
    The spans of one text are no more than its windows.
    """
    of_text = spans.groupBy("ord", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    maybe, _ = split_by(work.select("ord", "th", "text"), F.col("th"), spans.select("th").distinct())
    return maybe.join(of_text, ["ord", "th"])
