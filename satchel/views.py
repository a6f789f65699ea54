"""Personal-data views over the raw star-schema tables: each function gives one view as a lazy DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators import attachments as A
from satchel.operators import mime
from satchel.session import spread

EPOCH = 1704067200  # 2024-01-01, from which synthetic times count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    """Epoch milliseconds of a timestamp, whatever the session's zone is: without time zone also of hours that its clocks skip,
    with one the instant. Rounded to the nearest, halves away from 1970, as epoch_ms() of the SQL does."""
    minutes = f"unix_date(CAST({column} AS DATE)) * 1440L + hour({column}) * 60 + minute({column})"
    local = f"({minutes}) * 60000000 + CAST(extract(SECOND FROM {column}) * 1000000 AS BIGINT)"
    micros = f"(CASE WHEN typeof({column}) = 'timestamp' THEN unix_micros(CAST({column} AS TIMESTAMP)) ELSE {local} END)"
    return F.expr(f"({micros} + CASE WHEN {micros} < 0 THEN -500 ELSE 500 END) DIV 1000")


def messages(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"), (F.lit(EPOCH) + F.col("conv_id") + F.col("turn")).alias("created_at"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """A session for each conversation; its prompt is the first user turn."""
    prompt = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(prompt.alias("user_prompt")).select("id", "user_prompt", (F.lit(EPOCH) + F.col("id")).alias("started_at"), F.lit("completed").alias("status"), F.lit('{"temperature":0}').alias("config"))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "executing").otherwise("completed")
    t = table(spark, d, "events")
    return t.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("tool_name"), F.col("props").alias("request"), F.col("value").alias("execution_time_ms"), status.alias("status"), millis("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, "broken {").when(F.col("event_id") % 3 == 1, F.col("props")).alias("response"))


JOB_STATES = {"F": "completed", "O": "running"}


def jobs(spark: SparkSession, d: str, state: str | None = None) -> DataFrame:
    """Download jobs; those of one ``state`` are chosen by the raw column, so that the scan skips the others."""
    raw = F.col("o_orderstatus")
    t = table(spark, d, "orders")
    if state is not None:
        code = next((c for c, s in JOB_STATES.items() if s == state), None)
        others = raw.isNull() | ~raw.isin(*JOB_STATES)
        t = t.where(raw == code if code else others if state == "pending" else F.lit(False))
    status = F.when(raw == "F", JOB_STATES["F"]).when(raw == "O", JOB_STATES["O"]).otherwise("pending")
    return t.select(F.col("o_orderkey").alias("id"), F.lit("imap").alias("source_type"), F.col("o_custkey").alias("credential_id"), status.alias("status"), millis("o_orderdate").alias("created_at"))


def items(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "skipped").otherwise("completed")
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("source_identifier"), F.col("l_partkey").alias("email_id"), F.col("l_quantity").cast("long").alias("size_bytes"), status.alias("status"), millis("l_shipdate").alias("created_at"))


def credentials(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer")
    return t.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("identifier"), (F.col("c_acctbal") >= 0).alias("is_active"))


def emails(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("folder"), F.col("text").alias("body_text"), F.lit(EPOCH * 1000) + F.col("doc_id") * 60000).toDF("id", "folder", "body_text", "date_received")


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of messages: each document is the text file of one, beside an invitation, a picture that all share, and in every
    third a forwarded message with a contact card. They are dealt over all cores before they are made."""
    t = spread(table(spark, d, "documents").select("doc_id", "text"))
    number = F.col("doc_id").cast("string")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyyMMdd'T'090000")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    invitation = F.encode(A.calendar_file(number, day, F.concat(F.lit("Meeting "), number), [F.lit("mailto:a@example.com")]), "UTF-8")
    card = F.encode(A.contact_card(F.concat(F.lit("Person "), number), F.lit("p@example.com"), number, F.lit("Org")), "UTF-8")
    inner = mime.composed(F.lit("inner"), F.lit("b@example.com"), F.concat(F.lit("<f"), number, F.lit("@x>")), F.lit("see card"), [mime.attached(card, "text/vcard", F.lit("card.vcf"))], "forwarded")
    files = [
        mime.attached(text, "text/plain", F.concat(F.lit("doc-"), number, F.lit(".txt"))),
        mime.attached(invitation, "text/calendar", F.lit("invite.ics")),
        mime.attached(F.encode(F.lit("picture of all"), "UTF-8"), "image/png", F.lit("logo.png"), "inline", F.concat(F.lit("logo@"), number)),
        F.when(F.col("doc_id") % 3 == 0, mime.forwarded(inner)),
    ]
    sender = F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"), F.lit("@example.com"))
    return t.select(F.col("doc_id").alias("email_id"), mime.composed(F.concat(F.lit("Document "), number), sender, F.concat(F.lit("<"), number, F.lit("@x>")), F.lit("see files"), files).alias("raw"))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "checking").when(F.col("c_mktsegment") == "MACHINERY", "savings").when(F.col("c_mktsegment") == "AUTOMOBILE", "credit_card").otherwise("other")
    t = table(spark, d, "customer")
    return t.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("account_name"), kind.alias("account_type"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    return t.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("kind"))


def account_changes(spark: SparkSession, d: str) -> DataFrame:
    """Transactions as changes of a balance at a time: every third brings money, the others cost it."""
    t = table(spark, d, "orders")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return t.select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("timestamp").alias("at"), F.when(F.col("o_orderkey") % 3 == 0, amount).otherwise(-amount).cast("decimal(18,2)").alias("change"))


def job_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands to a job for each order: it is made, started twice, ended by the order's status, and paused."""
    t = table(spark, d, "orders")
    at = F.to_date("o_orderdate").cast("timestamp")
    end = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "fail").otherwise("reset by hand")
    steps = F.array(*(F.struct(F.lit(i).alias("step"), c.alias("command")) for i, c in enumerate((F.lit("create"), F.lit("start"), F.lit("start"), end, F.lit("pause")))))
    rows = t.select(F.col("o_orderkey").alias("job_id"), at.alias("day"), F.explode(steps).alias("s"))
    return rows.select("job_id", (F.col("day") + F.make_dt_interval(mins=F.col("s.step"))).alias("at"), "s.command", F.when(F.col("s.command") == "fail", "no route").alias("error"))


def destinations(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("country"), ((F.col("n_nationkey") + 1) * 1000).cast("decimal(18,2)").alias("budget"))


def activities(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier")
    return t.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("destination_id"), F.col("s_name").alias("activity_name"), F.col("s_acctbal").cast("decimal(18,2)").alias("cost"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "in-progress").otherwise("todo")
    level = F.substring("o_orderpriority", 1, 1)
    priority = F.when(level == "1", "critical").when(level == "2", "high").when(level.isin("3", "4"), "medium").otherwise("low")
    t = table(spark, d, "orders")
    return t.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), status.alias("status"), priority.alias("priority"), F.to_date("o_orderdate").alias("due_date"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.to_date("ts").alias("date"), F.col("user_id").alias("project_id"))


VIEWS = {"agent_messages": messages, "agent_sessions": sessions, "agent_tool_calls": tool_calls, "download_jobs": jobs, "download_items": items, "credentials_metadata": credentials, "emails": emails, "finance_accounts": accounts, "finance_transactions": transactions, "travel_destinations": destinations, "travel_activities": activities, "tasks": tasks, "projects": projects, "calendar_events": calendar}


def register(spark: SparkSession, d: str, statement: str | None = None) -> None:
    """Registers the views for SQL: all of them, or those whose names stand in a statement."""
    words = None if statement is None else set(re.findall(r"\w+", statement.lower()))
    for name, view in VIEWS.items():
        if words is None or name in words:
            view(spark, d).createOrReplaceTempView(name)
