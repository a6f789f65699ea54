"""Parquet tables with appends, state logs and deletes. Parquet has no updates: a change of state is an appended row, and
the latest row of a key is its state; deletes rewrite a table without the rows, in a new directory that replaces the old."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.schemas import TABLES, schema


class Store:
    """Tables under one folder; ``versions`` are directories v<n>, of which the largest complete one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _folders(self, table: str) -> list[int]:
        fs, target = self._fs(f"{self.root}/{table}")
        names = [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _versions(self, table: str) -> list[int]:
        """Versions that were written to the end."""
        done = ((n, *self._fs(f"{self.root}/{table}/v{n}/_SUCCESS")) for n in self._folders(table))
        return [n for n, fs, mark in done if fs.exists(mark)]

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}/v{self._versions(table)[-1]}"

    def create_all(self) -> None:
        """Creates every table that is not there; running it again changes nothing."""
        for table in TABLES:
            if not self.exists(table):
                self.spark.createDataFrame([], schema(table)).write.parquet(f"{self.root}/{table}/v0")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(schema(table)).parquet(self.path(table))

    def _claim(self, table: str, n: int) -> int:
        """The first of ``n`` ids that no other writer has or gets: a claim is a file that can be made once only."""
        while True:
            last = self.read(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            fs, folder = self._fs(f"{self.root}/{table}/_ids")
            claims = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
            last = max([last, *(int(c.split("-")[1]) for c in claims if c.count("-") == 1)])
            if fs.createNewFile(self._fs(f"{self.root}/{table}/_ids/{last + 1}-{last + n}")[1]):
                return last + 1

    def _numbered(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows with ids in the order of all columns. The sorted rows are written aside; a row's id follows from its file's
        place among the files and its place in the file."""
        aside = f"{self.root}/{table}/_aside/{uuid.uuid4().hex}"
        own = rows.drop("id")
        own.sort(*own.columns).write.parquet(aside)
        read = self.spark.read.schema(own.schema).parquet(aside).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
        sizes = {r["__file"]: r["count"] for r in read.groupBy("__file").count().collect()}  # a row a file
        first, offsets = self._claim(table, sum(sizes.values())) if sizes else 1, {}
        for name in sorted(sizes):
            offsets[name], first = first, first + sizes[name]
        starts = self.spark.createDataFrame(list(offsets.items()), "__file string, __first long")
        return read.join(F.broadcast(starts), "__file").withColumn("id", F.col("__first") + F.col("__at")).drop("__file", "__at", "__first")

    def append(self, table: str, rows: DataFrame, number: bool = False) -> None:
        """Appends rows; missing columns are null. ``number`` gives dense ids after the largest so far, in the order of all
        columns; writers at the same time get different ones, and those of a writer that fails are left out."""
        wanted = schema(table)
        if number:
            rows = self._numbered(table, rows)
        have = set(rows.columns)
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        rows.select(*columns).write.mode("append").parquet(self.path(table))

    def transition(self, table: str, key: int, **changes) -> None:
        """Appends the key's latest row with changes."""
        now = self.latest(table).where(F.col("id") == key)
        self.append(table, now.withColumns({k: F.lit(v) for k, v in changes.items()}))

    def latest(self, table: str) -> DataFrame:
        """The latest row of each id, by the times that the table has; rows of equal times compare by their other columns."""
        rows = self.read(table)
        times = [c for c in ("updated_at", "completed_at", "ended_at", "created_at", "started_at") if c in rows.columns]
        order = F.struct(*(F.coalesce(c, F.lit(-1)) for c in times), F.to_json(F.struct(*rows.columns)))
        return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")

    def delete(self, table: str, gone: DataFrame, key: str = "id") -> None:
        """Rewrites a table without the keys of ``gone``. The new version counts once it is written to the end; readers of the
        old one are not disturbed."""
        kept = self.read(table).join(gone.select(key).distinct(), key, "left_anti").select(*schema(table).names)
        kept.write.parquet(f"{self.root}/{table}/v{self._folders(table)[-1] + 1}")

    def delete_job(self, job_id: int) -> None:
        """A job and its items go; its mail stays."""
        gone = self.spark.createDataFrame([(job_id,)], "id bigint")
        self.delete("download_items", gone.withColumnRenamed("id", "job_id"), "job_id")
        self.delete("download_jobs", gone)

    def delete_session(self, session_id: int) -> None:
        """A session goes with its messages and tool calls."""
        gone = self.spark.createDataFrame([(session_id,)], "id bigint")
        for table in ("agent_messages", "agent_tool_calls"):
            self.delete(table, gone.withColumnRenamed("id", "session_id"), "session_id")
        self.delete("agent_sessions", gone)
