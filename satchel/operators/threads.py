"""Mail threads by References and In-Reply-To, kept up batch by batch.

A message names the messages before it; those that we lack are nodes too, so that two answers to a message that never came
are one thread. A thread is named by its least node. A new batch is merged by a graph of its own nodes and of the threads
that they touch, not of all messages: old members keep the name under which they came, and a table of renamed threads tells
what that is now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators.graphs import components

MEMBERS = "node string, known boolean, thread string"
RENAMED = "thread string, now string"


def links(messages: DataFrame) -> DataFrame:
    """``a`` (message) and ``b`` (a message it names) of messages (message_id, in_reply_to, references as an array)."""
    named = F.array_union(F.coalesce("references", F.array().cast("array<string>")), F.array("in_reply_to"))
    return messages.where("message_id is not null").select(F.col("message_id").alias("a"), F.explode(named).alias("b")).where("b is not null and b <> ''").distinct()


def nodes(messages: DataFrame) -> DataFrame:
    """``node`` and whether it is a message that we have."""
    own = messages.where("message_id is not null").select(F.col("message_id").alias("node"), F.lit(True).alias("known"))
    return own.unionByName(links(messages).select(F.col("b").alias("node"), F.lit(False).alias("known"))).groupBy("node").agg(F.bool_or("known").alias("known"))


def threads(messages: DataFrame) -> DataFrame:
    """``node``, ``known`` and ``thread`` of all messages at once."""
    found = components(links(messages))
    return nodes(messages).join(found, "node", "left").select("node", "known", F.coalesce("component", "node").alias("thread"))


class ThreadStore:
    """Members and renamed threads under one folder, a directory for each batch. A batch that is merged again replaces what it
    wrote; it must be the last one. Batches are merged by one writer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{table}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _renamed(self, before: int | None = None) -> DataFrame:
        """What each renamed thread is called now: the newest row of a name. merge() writes rows of all names that lead to a
        renamed one, so that no chain has to be followed."""
        return self._read("renamed", RENAMED, before).groupBy("thread").agg(F.max_by("now", "batch").alias("now"))

    def threads(self, before: int | None = None) -> DataFrame:
        """``node``, ``known`` and ``thread`` as of now; a node that a later batch brought is known."""
        rows = self._read("members", MEMBERS, before).join(self._renamed(before), "thread", "left")
        return rows.groupBy("node").agg(F.bool_or("known").alias("known"), F.min(F.coalesce("now", "thread")).alias("thread"))

    def merge(self, messages: DataFrame, batch: int) -> None:
        own = nodes(messages)
        # nodes that came before, with the thread that they are in now
        old = self._read("members", MEMBERS, batch).join(own.select("node"), "node", "left_semi").select("node", "thread").distinct()
        renamed = self._renamed(batch)
        touched = old.join(renamed, "thread", "left").select("node", F.coalesce("now", "thread").alias("thread")).distinct()
        graph = links(messages).unionByName(touched.select(F.col("node").alias("a"), F.col("thread").alias("b")))
        found = components(graph)
        rows = own.join(found, "node", "left").select("node", "known", F.coalesce("component", "node").alias("thread"))
        rows.write.mode("overwrite").parquet(f"{self.root}/members/batch={batch}")
        # touched threads whose least node is another now, and the older names that led to them
        moved = touched.select("thread").distinct().join(found.select(F.col("node").alias("thread"), "component"), "thread").where("component <> thread").select("thread", F.col("component").alias("now"))
        led = renamed.select(F.col("thread").alias("older"), F.col("now").alias("thread")).join(moved, "thread").select(F.col("older").alias("thread"), "now")
        moved.unionByName(led).write.mode("overwrite").parquet(f"{self.root}/renamed/batch={batch}")
