"""Intermediate tables in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


_paths: list[str] = []
_broadcasts: list[Broadcast] = []


class Made:
    """Intermediate tables and broadcasts, to be dropped once the plans that read them have run."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.broadcasts: list[Broadcast] = []
        self.application = ""  # in which they were made, for those who keep them for long

    def drop(self, spark: SparkSession) -> None:
        for path in self.paths:
            drop(spark, path)
        for made in self.broadcasts:
            made.destroy()
        self.paths, self.broadcasts = [], []


@contextmanager
def recorded() -> Iterator[Made]:
    """What is made inside and not yet dropped is named in the result at the end."""
    paths, broadcasts, made = len(_paths), len(_broadcasts), Made()
    yield made
    made.paths, made.broadcasts = _paths[paths:], _broadcasts[broadcasts:]
    del _paths[paths:], _broadcasts[broadcasts:]


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Drops the tables and the broadcasts that are made inside; plans that read them must have run by then."""
    with recorded() as made:
        yield
    made.drop(spark)


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that temporary() or Made.drop() ends."""
    _broadcasts.append(spark.sparkContext.broadcast(value))
    return _broadcasts[-1]


#: Bytes of a batch of rows that goes to Python; Spark's own bound is eight times as large, and a task holds several.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows with long texts to Python in small batches. Results are lazy, so that this has to
    last as long as the session; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def gives_back(run: Run) -> Run:
    """A function for mapInArrow after whose end the worker, which Spark keeps for other tasks, returns what it freed to the
    system: the C library and Arrow would hold it, and an executor's memory counts that of all its workers."""

    @wraps(run)
    def run_and_return(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run_and_return


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one is set only where the session names none (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="satchel-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/satchel/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    _paths.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: the lineage is cut, and a lost executor
    costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
