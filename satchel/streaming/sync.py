"""Incremental mailbox sync and event windows on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from satchel.functions.scalars import search_cutoff
from satchel.operators.mime import AttachmentStore
from satchel.sources.keys import KeyIndex
from satchel.sources.mailbox import Mailbox, parsed


def strategy(rows: DataFrame, kind: str, folders: tuple[str, ...] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """Messages that a sync strategy wants: all-folders, inbox-only, folders, unseen-only or date-range."""
    if kind == "inbox-only":
        return rows.where(F.upper("folder") == "INBOX")
    if kind == "folders":
        return rows.where(F.col("folder").isin(*folders))
    if kind == "unseen-only":
        return rows.where(~F.col("is_read"))
    if kind == "date-range":
        return rows.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date")))
    if kind == "all-folders":
        return rows
    raise ValueError(f"unknown sync strategy {kind}")


def search(rows: DataFrame, as_of: str, months: int | None = 12, after_uid: int = 0, limit: int | None = None) -> DataFrame:
    """Messages newer than the bound and after the cursor, in order of UID."""
    cutoff = search_cutoff(as_of, months)
    found = rows.where((F.col("uid") > after_uid) & (F.lit(True) if months is None else F.col("date") >= cutoff)).orderBy("uid")
    return found if limit is None else found.limit(limit)


def last_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The newest offset of the first source in a stream's checkpoint; None where no batch was begun."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = [int(n) for n in (x.getPath().getName() for x in fs.listStatus(folder)) if n.isdigit()] if fs.exists(folder) else []
    if not numbers:
        return None
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{max(numbers)}").collect()]
    return next((x for x in lines[2:3] if x != "-"), None)


def sync(spark: SparkSession, mailbox: str, target: str, checkpoint: str, batch: int = 50, available_now: bool = True, admit: int = 1000, job: str | None = None) -> StreamingQuery:
    """Reads new messages into ``target``/emails and ``target``/download_items.

    A micro-batch writes its own directory of both tables and overwrites it if it runs again, so that no message comes
    twice. Attachments go to ``target``/attachments and their contents, each once, to ``target``/contents. Cursors are the
    stream's offsets in the checkpoint. A micro-batch takes at most ``admit`` messages of a folder; with ``available_now`` one
    is run. Jobs that share a mailbox write to ``target``/job=<job>, and a message that one of them has is not taken by the
    others: ``target``/keys holds folder and UID of all.
    """
    spark.dataSource.register(Mailbox)
    stream = spark.readStream.format("mailbox").option("path", mailbox).option("batch", batch).option("admit", admit).option("resume", last_offset(spark, checkpoint) or "{}").load()
    shared, target = target, target if job is None else f"{target}/job={job}"
    store, keys = AttachmentStore(spark, target), KeyIndex(spark, f"{shared}/keys", ("folder", "uid"))

    def write(rows: DataFrame, batch_id: int) -> None:
        if job is not None:
            rows = rows.join(keys.add(rows.select("folder", "uid"), f"{job}-{batch_id}"), ["folder", "uid"]).persist()
        messages = parsed(rows).persist()
        messages.write.mode("overwrite").parquet(f"{target}/emails/batch={batch_id}")
        item = messages.select("folder", "uid", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "size_bytes", F.col("error").alias("error_message"))
        item.write.mode("overwrite").parquet(f"{target}/download_items/batch={batch_id}")
        messages.unpersist()
        store.add(rows, batch_id, ("folder", "uid"))
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="5 minutes").start()


def sync_all(spark: SparkSession, mailbox: str, target: str, checkpoint: str, batch: int = 50, admit: int = 1000, job: str | None = None) -> int:
    """Syncs until nothing is new; the number of runs."""
    runs = 0
    while True:
        query = sync(spark, mailbox, target, checkpoint, batch, admit=admit, job=job)
        query.awaitTermination()
        runs += 1
        if not query.lastProgress or not query.lastProgress["numInputRows"]:
            return runs


class Running:
    """Active syncs by job; a query that has ended no longer counts as running."""

    def __init__(self):
        self._queries: dict[int, StreamingQuery] = {}

    def start(self, job_id: int, start) -> StreamingQuery:
        if self.active(job_id):
            raise RuntimeError(f"job {job_id} is running")
        self._queries[job_id] = query = start()
        return query

    def active(self, job_id: int) -> bool:
        query = self._queries.get(job_id)
        if query is not None and not query.isActive:
            del self._queries[job_id]
            return False
        return query is not None

    def pause(self, job_id: int) -> None:
        query = self._queries.pop(job_id, None)
        if query is not None and query.isActive:
            query.stop()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of event types in tumbling windows; works on streams and tables. An extension of our own."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions_of(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users by gaps between their events. An extension of our own."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
