"""Attachments out of raw messages: the tree of a message's parts becomes rows, and contents are stored once by checksum.

Only the walk through the tree runs in Python, a message at a time in Arrow batches; routing, storing and counting are joins
and groupings. An attachment's content is known by the SHA-256 of its decoded bytes, so that one file in a million messages
is one content with a million references.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.message import Message

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators import attachments as A

PARTS = "part string, content_type string, charset string, filename string, content_id string, is_inline boolean, is_attachment boolean, content binary, size_bytes long, checksum string, error string"
_KINDS = {"part": pa.string(), "content_type": pa.string(), "charset": pa.string(), "filename": pa.string(), "content_id": pa.string(), "is_inline": pa.bool_(), "is_attachment": pa.bool_(), "content": pa.binary(), "size_bytes": pa.int64(), "checksum": pa.string(), "error": pa.string()}
#: Parts deeper than this are not opened: the part that holds them is one attachment of bytes.
DEPTH = 20
#: Parts leave a task together until their contents have so many bytes.
AT_ONCE = 1 << 20


def _leaf(part: Message, path: str) -> dict:
    """A part without parts. It is an attachment if it says so, has a file name, or is neither text nor inline."""
    row = {"part": path, "content_type": part.get_content_type()}
    try:
        kind = part.get_content_disposition()
        row["filename"], row["charset"] = part.get_filename(), part.get_content_charset()
        own = part.get("content-id")
        row["content_id"] = str(own).strip().strip("<>") or None if own is not None else None
        row["is_inline"] = kind == "inline" or kind is None and row["content_id"] is not None
        row["is_attachment"] = kind == "attachment" or row["filename"] is not None or part.get_content_maintype() != "text"
        content = part.as_bytes() if part.is_multipart() else part.get_payload(decode=True) or b""
        row["content"], row["size_bytes"], row["checksum"] = content, len(content), hashlib.sha256(content).hexdigest()
    except Exception as error:  # a broken part is reported in its row; the others go on
        row["error"] = f"{type(error).__name__}: {error}"[:200]
    return row


def _walk(part: Message, path: str, depth: int = 0) -> Iterator[dict]:
    inner = part.get_payload() if part.is_multipart() and depth < DEPTH else None
    if isinstance(inner, list) and inner:
        # the part of a message in a message has no number of its own
        place = lambda n: path if part.get_content_maintype() == "message" else f"{path}.{n}".lstrip(".")
        for n, own in enumerate(inner, 1):
            yield from _walk(own, place(n), depth + 1)
    else:
        yield _leaf(part, path or "1")


def _rows(raw: bytes | None) -> list[dict]:
    """The parts of one message. A part that is numbered as one before it, as broken nesting gives, gets a suffix."""
    try:
        rows, seen = list(_walk(message_from_bytes(raw or b"", policy=policy.compat32), "")), {}
    except Exception as error:
        return [{"part": "1", "error": f"{type(error).__name__}: {error}"[:200]}]
    for row in rows:
        n = seen[row["part"]] = seen.get(row["part"], 0) + 1
        row["part"] += f"#{n}" if n > 1 else ""
    return rows


def parts(messages: DataFrame, key: tuple[str, ...] = ("email_id",), raw: str = "raw") -> DataFrame:
    """A row for each leaf of each message's tree, with ``key`` kept: ``part`` (1, 2.1, ...), content_type, charset, filename,
    content_id, is_inline, is_attachment, decoded content, size_bytes, checksum, error.

    Messages in messages are walked into. An empty or null message has one empty text part."""
    kept = messages.select(*key, F.col(raw).alias("__raw"))
    schema = ", ".join([*(f"`{k}` {messages.schema[k].dataType.simpleString()}" for k in key), PARTS])

    def told(batch: pa.RecordBatch, own: list[int], found: list[dict]) -> pa.RecordBatch:
        keys = batch.select(range(len(key))).take(pa.array(own, pa.int64()))
        return pa.RecordBatch.from_arrays([*keys.columns, *(pa.array([r.get(c) for r in found], kind) for c, kind in _KINDS.items())], names=[*key, *_KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found, held = [], [], 0
            for i in range(batch.num_rows):  # a message's parts at a time, as they may be large
                one = _rows(batch.column(len(key))[i].as_py())
                own += [i] * len(one)
                found += one
                held += sum(r.get("size_bytes") or 0 for r in one)
                if held >= AT_ONCE:
                    yield told(batch, own, found)
                    own, found, held = [], [], 0
            if found:
                yield told(batch, own, found)

    return kept.mapInArrow(run, schema)


def attachment_rows(found: DataFrame) -> DataFrame:
    """The attachments among parts(), under a file name in any case, without their contents."""
    name = F.coalesce("filename", F.concat(F.lit("part-"), F.col("part")))
    return found.where("is_attachment and error is null").withColumn("filename", name).drop("content", "is_attachment", "error", "charset")


def contents(found: DataFrame) -> DataFrame:
    """``checksum``, ``content`` and ``size_bytes`` of each different attachment. Copies fall together before the shuffle, so
    that a content in most messages loads no task."""
    return found.where("is_attachment and error is null").groupBy("checksum").agg(F.first("content").alias("content"), F.first("size_bytes").alias("size_bytes"))


def references(attachments: DataFrame) -> DataFrame:
    """How many attachments hold each content, and in how many bytes of mail."""
    return attachments.groupBy("checksum").agg(F.count("*").alias("references"), F.max("size_bytes").alias("size_bytes"), F.sum("size_bytes").alias("bytes_in_mail"))


def text_of(content: Column, charset: Column) -> Column:
    """Decoded text; what names no character set that Spark decodes is read as UTF-8."""
    kind = F.lower(F.coalesce(charset, F.lit("utf-8")))
    return F.when(kind.isin("iso-8859-1", "latin1"), F.decode(content, "ISO-8859-1")).when(kind.isin("utf-16", "utf-16le", "utf-16be"), F.decode(content, "UTF-16")).otherwise(content.cast("string"))


def files(found: DataFrame) -> DataFrame:
    """Attachments that an extractor takes, as attachments.extracted() wants them: key columns, filename, content_type and
    content as text."""
    known = found.where("is_attachment and error is null").where(A.route(F.col("filename"), F.col("content_type")).isNotNull())
    return known.withColumn("content", text_of(F.col("content"), F.col("charset"))).drop("charset", "is_attachment", "is_inline", "content_id", "size_bytes", "error")


def entities(found: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Events and contacts out of the attachments of parts(), as attachments.extracted()."""
    whole = F.to_json(F.struct(*key, "part"))
    own = A.extracted(files(found).withColumn("__file", whole), "__file")
    kinds = ", ".join(f"`{k}` {found.schema[k].dataType.simpleString()}" for k in (*key, "part"))
    return own.select(F.from_json("__file", kinds).alias("__k"), *[c for c in own.columns if c != "__file"]).select("__k.*", *[c for c in own.columns if c != "__file"])


def statuses(found: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key, part and ``extraction_status`` of every attachment: completed with a valid calendar or card, failed with a broken
    one, skipped if no extractor takes it."""
    own = files(found)
    kind = A.route(F.col("filename"), F.col("content_type"))
    cal, card = (read(own.where(kind == name)).select(*key, "part", "file_valid") for read, name in ((A.calendar_events, A.CALENDAR), (A.contacts, A.CARD)))
    valid = cal.unionByName(card).groupBy(*key, "part").agg(F.bool_and("file_valid").alias("file_valid"))
    rows = attachment_rows(found).select(*key, "part", A.route(F.col("filename"), F.col("content_type")).isNotNull().alias("taken"))
    status = F.when(~F.col("taken"), "skipped").when(F.coalesce("file_valid", F.lit(False)), "completed").otherwise("failed")
    return rows.join(valid, [*key, "part"], "left").select(*key, "part", status.alias("extraction_status"))


class AttachmentStore:
    """Attachments of batches of messages under one folder: ``attachments/batch=<n>`` and, each once, ``contents/batch=<n>``.

    A batch that is written again replaces what it wrote before. Contents of other batches are looked up by checksum alone,
    so that no stored byte is read. Batches are added by one writer, as a stream does."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")

    def attachments(self) -> DataFrame:
        return self._read("attachments", "part string, content_type string, filename string, content_id string, is_inline boolean, size_bytes long, checksum string, file_path string, batch int")

    def contents(self) -> DataFrame:
        return self._read("contents", "checksum string, content binary, size_bytes long, batch int")

    def add(self, messages: DataFrame, batch: int, key: tuple[str, ...] = ("email_id",)) -> None:
        """Contents first, so that no attachment points to one that is not there."""
        found = parts(messages, key).persist(StorageLevel.DISK_ONLY)  # messages are opened once for both tables
        try:
            new = contents(found).join(self.contents().where(F.col("batch") != batch).select("checksum").distinct(), "checksum", "left_anti")
            new.write.mode("overwrite").parquet(f"{self.root}/contents/batch={batch}")
            rows = attachment_rows(found).withColumn("file_path", F.concat(F.lit("contents/"), F.col("checksum")))
            rows.write.mode("overwrite").parquet(f"{self.root}/attachments/batch={batch}")
        finally:
            found.unpersist()

    def unreferenced(self) -> DataFrame:
        """Contents that no attachment holds any more, as after deletes."""
        return self.contents().select("checksum", "size_bytes").join(self.attachments().select("checksum").distinct(), "checksum", "left_anti")


def _base64(content: Column) -> Column:
    return F.regexp_replace(F.base64(content), "(.{76})", "$1\r\n")


def _part(headers: list[str | Column], body: Column) -> Column:
    return F.concat(F.concat_ws("\r\n", *(F.lit(h) if isinstance(h, str) else h for h in headers)), F.lit("\r\n\r\n"), body)


def _multipart(boundary: str, kind: str, inner: list[Column], headers: list[str | Column] = ()) -> Column:
    """Null parts are left out."""
    between = [F.concat(F.lit(f"--{boundary}\r\n"), p, F.lit("\r\n")) for p in inner]
    body = F.concat_ws("", *between, F.lit(f"--{boundary}--\r\n"))
    return _part([*headers, f'Content-Type: multipart/{kind}; boundary="{boundary}"'], body)


def attached(body: Column, content_type: str, filename: Column, disposition: str = "attachment", content_id: Column | None = None) -> Column:
    """A part with a file, in base64."""
    headers = [f"Content-Type: {content_type}", "Content-Transfer-Encoding: base64", F.concat(F.lit(f'Content-Disposition: {disposition}; filename="'), filename, F.lit('"'))]
    return _part(headers + ([F.concat(F.lit("Content-ID: <"), content_id, F.lit(">"))] if content_id is not None else []), _base64(body))


def composed(subject: Column, sender: Column, message_id: Column, text: Column, files: list[Column], boundary: str = "outer") -> Column:
    """Bytes of a message with a text, the same as a page, and files made by attached(); null files are left out. A message
    in a message needs a ``boundary`` of its own."""
    body = _multipart(f"{boundary}-body", "alternative", [_part(['Content-Type: text/plain; charset="utf-8"', "Content-Transfer-Encoding: base64"], _base64(F.encode(text, "UTF-8"))), _part(["Content-Type: text/html"], F.lit("<p>see the text</p>"))])
    top = [F.concat(F.lit("Subject: "), subject), F.concat(F.lit("From: "), sender), F.concat(F.lit("Message-ID: "), message_id), F.lit("MIME-Version: 1.0")]
    return F.encode(_multipart(boundary, "mixed", [body, *files], top), "UTF-8")


def forwarded(message: Column) -> Column:
    """A part with a whole message."""
    return _part(["Content-Type: message/rfc822"], message.cast("string"))
