"""What keyed stream processors share: a state store that they can use, and a run over everything that is there."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in the store that keyed processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def written(stream: DataFrame, folder: str) -> DataFrame:
    """All that the stream gives for what is there now, from ``folder``/out; its checkpoint is beside it."""
    spark = stream.sparkSession
    with keyed_state(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
