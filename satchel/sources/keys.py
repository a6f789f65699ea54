"""Uniqueness over batches: which keys of a new batch are in no earlier one.

Every batch leaves its keys and a bitmap of their hashes. A new key whose bit is not set is surely new and meets no history;
only the others are compared with the keys themselves. The bitmaps have a bound, however long the history: 32,768 bits in a
row, BITS in all; once they are full more keys are compared, and the outcome is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 30


class KeyIndex:
    """Keys of the columns ``key`` under one folder; null is a value like others. One writer at a time adds batches, each
    under a ``label`` of its own; a batch that is added again replaces what it left."""

    def __init__(self, spark: SparkSession, root: str, key: tuple[str, ...], bits: int = BITS):
        self.spark, self.root, self.key, self.bits = spark, root.rstrip("/"), key, bits

    def _read(self, table: str, schema: str, label: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, label string").parquet(f"{self.root}/{table}").where(F.col("label") != label).drop("label")

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.bits)) + 1

    def _schema(self, rows: DataFrame) -> str:
        return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in self.key)

    def suspects(self, rows: DataFrame, label: str = "") -> tuple[DataFrame, DataFrame]:
        """Rows whose key may have come in another batch than ``label``, and rows whose key surely has not."""
        maps = self._read("bitmaps", "bucket long, bits binary", label).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        at = F.bitmap_bit_position("__slot")
        byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        slotted = rows.withColumn("__slot", self._slot()).withColumn("bucket__", F.bitmap_bucket_number("__slot"))
        told = slotted.join(maps.withColumnRenamed("bucket", "bucket__"), "bucket__", "left")
        hit = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1, F.lit(False))
        told = told.withColumn("__hit", hit).drop("bits", "bucket__", "__slot")
        return told.where("__hit").drop("__hit"), told.where("not __hit").drop("__hit")

    def seen(self, label: str, like: DataFrame) -> DataFrame:
        """The keys of other batches."""
        return self._read("keys", self._schema(like), label)

    def add(self, rows: DataFrame, label: str) -> DataFrame:
        """The rows of a batch that are new: of rows of one key the least by all columns, and none whose key came before. Their
        keys are in the index afterwards; the result is what was written, so that it can be read any number of times."""
        columns = rows.columns
        rest = [c for c in columns if c not in self.key]
        order = [F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]
        one = rows.groupBy(*self.key).agg(F.min(F.struct(*order)).alias("__row")).select(*self.key, *([f"__row.`{c}`" for c in rest]))
        maybe, sure = self.suspects(one, label)
        if not maybe.isEmpty():
            old = self.seen(label, rows).distinct().toDF(*(f"old_{i}" for i in range(len(self.key))))
            same = [F.col(f"`{k}`").eqNullSafe(F.col(f"old_{i}")) for i, k in enumerate(self.key)]
            sure = sure.unionByName(maybe.join(old, same, "left_anti"))
        path = f"{self.root}/new/label={label}"
        sure.select(*[f"`{c}`" for c in columns]).write.mode("overwrite").parquet(path)
        new = self.spark.read.schema(rows.schema).parquet(path)
        new.select(*self.key).write.mode("overwrite").parquet(f"{self.root}/keys/label={label}")
        slots = new.select(self._slot().alias("slot"))
        maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        maps.write.mode("overwrite").parquet(f"{self.root}/bitmaps/label={label}")
        return new
