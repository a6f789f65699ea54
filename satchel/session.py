"""Spark sessions for local work. On a cluster, pass the session that the cluster gives."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str, cores: int | str | None = None) -> SparkSession:
    """A local session with adaptive execution, UTC and one shuffle partition per core."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, which driver and executors share; where none is set, in local mode, one is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="satchel-"))
    return f"{folder or context._jsc.sc().getCheckpointDir().get()}/work-{uuid.uuid4().hex}"


def spread(rows: DataFrame, tasks: int = 3) -> DataFrame:
    """Rows dealt over so many tasks a core, ahead of work that is dear for a row: a scan gives a small file to one task."""
    return rows.repartition(tasks * rows.sparkSession.sparkContext.defaultParallelism)
