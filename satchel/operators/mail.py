"""Mail: pages, search, attachments, duplicates, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.scalars import addresses
from satchel.session import work_folder

ADDRESS = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def page(emails: DataFrame, folder: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of mail, newest first, ties by id."""
    if folder is not None:
        emails = emails.where(F.col("folder") == folder)
    return emails.orderBy(F.desc("date_received"), "id").offset(offset).limit(limit)


def by_id(emails: DataFrame, email_id: int, arrays: tuple[str, ...] = ("to_addresses", "cc_addresses", "bcc_addresses"), lists: tuple[str, ...] = ("labels",)) -> DataFrame:
    """One message. Addresses and labels that are kept as JSON text become arrays, empty ones where the text is null or broken."""
    row = emails.where(F.col("id") == email_id)
    text = {c for c, kind in row.dtypes if kind == "string"}
    row = row.withColumns({c: addresses(F.col(c)) for c in arrays if c in text})
    return row.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in lists if c in text})


def search(emails: DataFrame, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the mail that holds a text in any case, with the total and whether there is more."""
    found = emails.where(F.contains(F.lower("body_text"), F.lit(text.lower())))
    total = found.agg(F.count("*").alias("total"))
    return page(found, None, limit, offset).crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def addresses_in_text(emails: DataFrame) -> DataFrame:
    """Distinct mail addresses in texts and how many messages have them."""
    found = emails.where(F.contains("body_text", F.lit("@"))).select("id", F.explode(F.regexp_extract_all("body_text", F.lit(ADDRESS), F.lit(0))).alias("address"))
    return found.groupBy("address").agg(F.count_distinct("id").alias("messages"))


def checksum_duplicates(emails: DataFrame) -> DataFrame:
    """Contents that come more than once."""
    return emails.groupBy(F.sha2("body_text", 256).alias("checksum")).agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


def attachments_of(attachments: DataFrame, email_id: int) -> DataFrame:
    return attachments.where(F.col("email_id") == email_id).orderBy("id")


def threads(messages: DataFrame) -> DataFrame:
    """Messages (message_id, in_reply_to) with ``thread``, the first message of their thread.

    Replies point to what they answer; pointers are doubled until each reaches a message that answers nothing we have, so
    that rounds grow with the logarithm of a thread's length. Each round is checkpointed. Replies in a circle belong to
    its least message.
    """
    work_folder(messages.sparkSession)  # checkpoints need a folder
    known = messages.select(F.col("message_id").alias("parent")).distinct()
    own = messages.select("message_id", "in_reply_to").groupBy("message_id").agg(F.min("in_reply_to").alias("parent"))
    now = own.join(known.withColumn("there", F.lit(True)), "parent", "left")
    answers = F.coalesce(F.col("there") & (F.col("parent") != F.col("message_id")), F.lit(False))
    now = now.select("message_id", F.when(answers, F.col("parent")).otherwise(F.col("message_id")).alias("thread"), F.col("message_id").alias("least"), answers.alias("answers")).checkpoint()
    first = now.select(F.col("message_id").alias("thread"), F.col("answers").alias("circle"))
    now = now.drop("answers")
    for _ in range(max(1, (now.count() + 1).bit_length())):
        ahead = now.select(F.col("message_id").alias("thread"), F.col("thread").alias("next"), F.col("least").alias("least_ahead"))
        new = now.join(ahead, "thread").select("message_id", F.col("next").alias("thread"), F.least("least", "least_ahead").alias("least"), (F.col("next") != F.col("thread")).alias("moved")).checkpoint()
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    # a message at the end that answers one itself is on a circle
    return now.join(first, "thread").select("message_id", F.when(F.col("circle"), F.col("least")).otherwise(F.col("thread")).alias("thread"))
