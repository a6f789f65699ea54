"""Substring search in texts by an index of their three-letter pieces, kept up batch by batch.

A segment holds the pieces of a batch of texts as rows (piece, id), in buckets of pieces and sorted, so that a search opens the
buckets and row groups of its own pieces only, and how many texts have each piece. A text that holds the phrase holds all
its pieces: the rarest ones name the candidates, and the texts themselves decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators.mail import page
from satchel.session import spread

BUCKETS = 64
#: So many of a phrase's pieces are looked up, the rarest ones.
LOOKED_UP = 4
#: Postings that leave a task in one batch.
AT_ONCE = 1 << 16


def pieces(text: str) -> set[str]:
    low = text.lower()
    return {low[i : i + 3] for i in range(len(low) - 2)}


def bucket(piece: str, buckets: int) -> int:
    return zlib.crc32(piece.encode()) % buckets


class Buckets(dict):
    """Buckets of the pieces that a task has met, each worked out once."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, piece: str) -> int:
        self[piece] = found = bucket(piece, self.buckets)
        return found


class TextIndex:
    """Segments under one folder: ``postings/label=<l>/bucket=<b>`` and ``counts/label=<l>``. A segment that is added again
    replaces itself; texts are in one segment each."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def add(self, texts: DataFrame, label: str, key: str = "id", text: str = "body_text") -> None:
        """Rows of very common pieces are dealt out by piece and key, so that no task gets a piece whole."""
        buckets, kind = self.buckets, texts.schema[key].dataType.simpleString()

        def told(keys: pa.Array, own: list[int], found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([numbers[p] for p in found], pa.int32()), pa.array(found), keys.take(pa.array(own))], names=["bucket", "piece", "key"])

        numbers = Buckets(buckets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    of_text = pieces(t or "")
                    own += [i] * len(of_text)
                    found += of_text
                    if len(found) >= AT_ONCE:
                        yield told(batch.column(0), own, found)
                        own, found = [], []
                if found:
                    yield told(batch.column(0), own, found)

        rows = spread(texts.select(key, text).where(F.col(key).isNotNull())).mapInArrow(run, f"bucket int, piece string, key {kind}")
        path = f"{self.root}/postings/label={label}"
        rows.repartitionByRange("bucket", "piece", "key").sortWithinPartitions("bucket", "piece", "key").write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(f"piece string, key {kind}, bucket int").parquet(path)
        written.groupBy("bucket", "piece").agg(F.count("*").alias("n")).repartitionByRange("bucket", "piece").sortWithinPartitions("bucket", "piece").write.mode("overwrite").parquet(f"{self.root}/counts/label={label}")

    def rarest(self, phrase: str) -> list[str]:
        """The pieces of a phrase that are looked up; the driver reads a count for each piece of it."""
        own = sorted(pieces(phrase))
        found = self.spark.read.parquet(f"{self.root}/counts").where(F.col("bucket").isin([bucket(p, self.buckets) for p in own]) & F.col("piece").isin(own))
        counts = {r.piece: r.n for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        return sorted(own, key=lambda p: (counts.get(p, 0), p))[:LOOKED_UP]

    def candidates(self, phrase: str) -> DataFrame:
        """Keys of the texts that have the rarest pieces of a phrase of three letters or more."""
        own = self.rarest(phrase)
        rows = self.spark.read.option("basePath", f"{self.root}/postings").parquet(f"{self.root}/postings")
        hits = rows.where(F.col("bucket").isin(sorted({bucket(p, self.buckets) for p in own})) & F.col("piece").isin(own)).select("key", "piece")
        if len(own) == 1:
            return hits.select("key").distinct()
        return hits.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select("key")

    def search(self, texts: DataFrame, phrase: str, limit: int = 20, offset: int = 0, key: str = "id", text: str = "body_text") -> DataFrame:
        """As mail.search(): a page of the texts that hold a phrase in any case, with total and has_more. Texts that are in no
        segment are not found; phrases of fewer than three letters look at all texts."""
        if len(phrase.lower()) >= 3:
            texts = texts.join(self.candidates(phrase).withColumnRenamed("key", key), key, "left_semi")
        found = texts.where(F.contains(F.lower(text), F.lit(phrase.lower())))
        total = found.agg(F.count("*").alias("total"))
        return page(found, None, limit, offset).crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))
