"""Registered queries of the library and the SQL that gives the same rows on the raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satchel import views as V
from satchel.functions import scalars as S
from satchel.operators import attachments as A
from satchel.operators import downloads as D
from satchel.operators import finance as M
from satchel.operators import keywords as K
from satchel.operators import mail as E
from satchel.operators import mime
from satchel.operators import patterns as P
from satchel.operators import planning as C
from satchel.operators import resolution as R
from satchel.operators import sessions as X
from satchel.operators.extractors import extract
from satchel.operators.intervals import within
from satchel.operators.recurrence import expanded
from satchel.operators.threads import ThreadStore
from satchel.plans.guard import guarded
from satchel.session import work_folder
from satchel.sources.files import wanted
from satchel.sources.keys import KeyIndex
from satchel.sources.mailbox import archive, searched
from satchel.sources.store import Store
from satchel.sources.text_index import TextIndex
from satchel.sources.workbooks import import_workbooks, workbooks
from satchel.streaming import jobs as J
from satchel.streaming import sync as Y
from satchel.streaming.alerts import balance_alerts as alerts
from satchel.streaming.state import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

JOB = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END"
ITEM = "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'completed' END"
TASK = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in-progress' ELSE 'todo' END"
PRIORITY = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'medium' ELSE 'low' END"
MONEY = "CAST({} AS DECIMAL(18,2))"
AS_OF = "1998-06-15"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# sessions

@query("sessions_recent", "SELECT conv_id AS id, 1704067200 + conv_id AS started_at, arg_min(text, turn) FILTER (role = 'user') AS user_prompt FROM conversations GROUP BY conv_id ORDER BY started_at DESC, id LIMIT 100")
def sessions_recent(spark, d):
    return X.recent(V.sessions(spark, d), "completed").select("id", "started_at", "user_prompt")


@query("session_by_id", "SELECT conv_id AS id, 1704067200 + conv_id AS started_at, '{\"temperature\":0}' AS config FROM conversations WHERE conv_id = 7 GROUP BY conv_id")
def session_by_id(spark, d):
    return X.by_id(V.sessions(spark, d), 7).select("id", "started_at", "config")


@query("session_messages", "SELECT turn, role, text AS content FROM conversations WHERE conv_id = 7 ORDER BY turn")
def session_messages(spark, d):
    return X.messages_of(V.messages(spark, d), 7).select("turn", "role", "content")


@query("session_tool_calls", "SELECT event_id AS id, event_type AS tool_name, CAST(props->>'k' AS BIGINT) AS k, value AS execution_time_ms FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def session_tool_calls(spark, d):
    return X.tool_calls_of(V.tool_calls(spark, d), 7).select("id", "tool_name", F.get_json_object("request", "$.k").cast("long").alias("k"), "execution_time_ms")


@query("session_detail", "SELECT conv_id AS id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, max(strlen(text)) AS longest FROM conversations GROUP BY conv_id")
def session_detail(spark, d):
    nested = X.detail(V.sessions(spark, d), V.messages(spark, d))
    roles = F.array_join(F.transform("messages", lambda m: m["role"]), ",")
    longest = F.array_max(F.transform("messages", lambda m: F.octet_length(m["content"]))).cast("long")
    return nested.select("id", F.size("messages").cast("long").alias("n"), roles.alias("roles"), longest.alias("longest"))


@query("session_with_calls", """SELECT c.id, c.messages, coalesce(t.calls, 0) AS calls, coalesce(t.responses, 0) AS responses, t.first_tool FROM (SELECT conv_id AS id, count(*) AS messages FROM conversations GROUP BY conv_id) c
LEFT JOIN (SELECT user_id AS id, count(*) AS calls, count(*) FILTER (event_id % 3 = 1) AS responses, arg_min(event_type, (ts, event_id)) AS first_tool FROM events GROUP BY user_id) t USING (id)""")
def session_with_calls(spark, d):
    """Sessions with messages and tool calls nested; a third of the responses is broken, a third missing."""
    nested = X.detail(V.sessions(spark, d), V.messages(spark, d), V.tool_calls(spark, d))
    responses = F.size(F.filter("tool_calls", lambda c: c["response"].isNotNull()))
    return nested.select("id", F.size("messages").cast("long").alias("messages"), F.size("tool_calls").cast("long").alias("calls"), responses.cast("long").alias("responses"), F.get("tool_calls", 0)["tool_name"].alias("first_tool"))


@query("session_page_total", "SELECT conv_id AS id, (SELECT count(DISTINCT conv_id) FROM conversations) AS total FROM conversations GROUP BY conv_id ORDER BY id DESC LIMIT 10 OFFSET 5")
def session_page_total(spark, d):
    own = V.sessions(spark, d)
    return X.recent(own, None, 10, 5).select("id").crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))


@query("message_gap", "SELECT conv_id AS session_id, turn, turn - lag(turn) OVER w AS gap, lag(role) OVER w AS previous_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def message_gap(spark, d):
    return X.message_gaps(V.messages(spark, d))


@query("tool_latency_stats", "SELECT event_type AS tool_name, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'executing' ELSE 'completed' END AS status, count(*) AS calls, min(value) AS least_ms, max(value) AS most_ms FROM events GROUP BY ALL")
def tool_latency_stats(spark, d):
    return X.tool_latency(V.tool_calls(spark, d))


TOKENS = "CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT)"


@query("token_use", f"SELECT *, round((tokens_in * 3.0::DOUBLE + tokens_out * 15.0::DOUBLE) / 1e6, 6) AS cost FROM (SELECT conv_id AS session_id, count(*) AS calls, CAST(sum(CASE WHEN role = 'user' THEN {TOKENS} ELSE 0 END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE {TOKENS} END) AS BIGINT) AS tokens_out FROM conversations GROUP BY conv_id)")
def token_use(spark, d):
    """A token is about four characters; the user's turns go in, the others come out."""
    tokens = F.ceil(F.length(F.coalesce("content", F.lit(""))) / 4)
    own = F.col("role") == "user"
    calls = V.messages(spark, d).select("session_id", F.when(F.coalesce(own, F.lit(False)), tokens).otherwise(0).alias("tokens_in"), F.when(F.coalesce(own, F.lit(False)), 0).otherwise(tokens).alias("tokens_out"))
    return X.token_use(calls, 3.0, 15.0)


# downloads

@query("job_by_id", f"SELECT o_orderkey AS id, {JOB} AS status, o_custkey AS credential_id, epoch_ms(o_orderdate) AS created_at FROM orders WHERE o_orderkey = 33")
def job_by_id(spark, d):
    return D.by_id(V.jobs(spark, d), 33).select("id", "status", "credential_id", "created_at")


@query("jobs_list", f"SELECT o_orderkey AS id, {JOB} AS status, epoch_ms(o_orderdate) AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def jobs_list(spark, d):
    return D.listed(V.jobs(spark, d)).select("id", "status", "created_at")


@query("jobs_list_status", "SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def jobs_list_status(spark, d):
    return D.listed(V.jobs(spark, d, "completed"), None, 20).select("id", "created_at")


PROGRESS = """SELECT l_orderkey AS job_id, count(*) AS total, count(*) FILTER (l_returnflag = 'N') AS downloaded, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'A') AS skipped,
CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, CAST(CAST(CAST(count(*) FILTER (l_returnflag <> 'R') AS FLOAT) / CAST(count(*) AS FLOAT) AS FLOAT) * CAST(100 AS FLOAT) AS FLOAT) AS percent,
CAST(0 AS BIGINT) AS remaining FROM lineitem GROUP BY l_orderkey"""


@query("job_progress", PROGRESS)
def job_progress(spark, d):
    return D.progress(V.items(spark, d))


@query("job_rates", "SELECT l_orderkey AS job_id, count(*) AS n, CASE WHEN max(l_shipdate) > min(l_shipdate) THEN round(count(*) / ((epoch_ms(max(l_shipdate)) - epoch_ms(min(l_shipdate))) / 86400000.0), 6) END AS per_day FROM lineitem GROUP BY l_orderkey")
def job_rates(spark, d):
    return D.rates(V.items(spark, d))


@query("job_remaining_time", """WITH p AS (SELECT l_orderkey AS job_id, count(*) FILTER (l_returnflag <> 'A') AS done, count(*) FILTER (l_returnflag = 'A') AS "left", (epoch_ms(max(l_shipdate) FILTER (l_returnflag <> 'A')) - epoch_ms(min(l_shipdate) FILTER (l_returnflag <> 'A'))) / 1000.0 AS seconds FROM lineitem GROUP BY l_orderkey)
SELECT job_id, done, "left", CASE WHEN "left" = 0 THEN 0.0::DOUBLE WHEN seconds > 0 THEN round("left" * seconds::DOUBLE / done, 3) END AS eta_seconds FROM p""")
def job_remaining_time(spark, d):
    """The items that are skipped in the raw table count as waiting here."""
    return D.remaining_time(V.items(spark, d).replace("skipped", "pending", ["status"]))


@query("items_emails_join", "SELECT l_orderkey AS job_id, l_linenumber AS source_identifier, doc_id AS email_id, source AS folder, 1704067200000 + doc_id * 60000 AS date_received, CAST(l_quantity AS BIGINT) AS size_bytes FROM lineitem JOIN documents ON l_partkey = doc_id")
def items_emails_join(spark, d):
    return D.with_emails(V.items(spark, d), V.emails(spark, d))


@query("credentials_without_job", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND epoch_ms(o_orderdate) >= 788918400000)")
def credentials_without_job(spark, d):
    own = V.jobs(spark, d).where("status = 'pending' and created_at >= 788918400000")
    return D.credentials_without_job(V.credentials(spark, d), own).select("id")


@query("credentials_jobs_grouped", "SELECT c_custkey AS id, c_name AS identifier, count(o_orderkey) AS jobs, max(o_orderkey) AS last_job FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def credentials_jobs_grouped(spark, d):
    return D.jobs_by_credential(V.credentials(spark, d), V.jobs(spark, d))


@query("credentials_active", "SELECT c_custkey AS id, 'gmail_' || replace(c_name, '#', '_at_') AS identifier FROM customer WHERE c_acctbal >= 0")
def credentials_active(spark, d):
    own = V.credentials(spark, d).where("is_active")
    return own.select("id", S.credential_identifier("gmail", F.replace(F.col("identifier"), F.lit("#"), F.lit("@"))).alias("identifier"))


@query("orphan_items", "SELECT l_orderkey AS job_id, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'O') GROUP BY l_orderkey")
def orphan_items(spark, d):
    return D.orphans(V.items(spark, d), V.jobs(spark, d).where("status <> 'running'")).groupBy("job_id").agg(F.count("*").alias("n"))


@query("jobs_without_items", "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def jobs_without_items(spark, d):
    return D.without_items(V.jobs(spark, d), V.items(spark, d)).select("id")


@query("delete_job_effect", f"SELECT {ITEM} AS status, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL")
def delete_job_effect(spark, d):
    gone = V.jobs(spark, d).where("status = 'pending'").select(F.col("id").alias("job_id"))
    return V.items(spark, d).join(gone, "job_id", "left_anti").groupBy("status").agg(F.count("*").alias("n"))


@query("store_deletes", f"SELECT {ITEM} AS status, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL")
def store_deletes(spark, d):
    """Jobs and items are written to a store, the pending jobs are deleted with their items, and the items read again."""
    store = Store(spark, work_folder(spark))
    store.create_all()
    store.append("download_jobs", V.jobs(spark, d))
    store.append("download_items", V.items(spark, d).withColumn("source_identifier", F.col("source_identifier").cast("string")))
    gone = V.jobs(spark, d, "pending").select("id")
    store.delete("download_items", gone.withColumnRenamed("id", "job_id"), "job_id")
    store.delete("download_jobs", gone)
    left = store.read("download_items").join(store.read("download_jobs").select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return left.groupBy("status").agg(F.count("*").alias("n"))


@query("job_latest_state", f"SELECT o_orderkey AS id, 2 AS step, {JOB} AS state, CASE WHEN o_orderkey % 5 = 0 THEN 'lost connection' END AS error FROM orders")
def job_latest_state(spark, d):
    return D.latest(D.transitions(V.jobs(spark, d)))


LOG = "SELECT o_orderkey AS id, step, CASE WHEN step = 1 AND o_orderkey % 7 = 0 THEN 'slow' WHEN step = 2 AND o_orderkey % 5 = 0 THEN 'lost connection' END AS error FROM orders, range(3) AS t(step)"


@query("status_overwrites_error", f"WITH log AS ({LOG}) SELECT count(DISTINCT id) AS jobs, count(*) FILTER (step = 2 AND error IS NOT NULL) AS with_error FROM log WHERE id IN (SELECT id FROM log WHERE step < 2 AND error IS NOT NULL)")
def status_overwrites_error(spark, d):
    """Of the jobs that had an error at an earlier step, how many have one now."""
    log = D.transitions(V.jobs(spark, d))
    had = log.where("step < 2 and error is not null").select("id").distinct()
    return D.latest(log).join(had, "id", "left_semi").agg(F.count("*").alias("jobs"), F.count("error").alias("with_error"))


@query("state_ranks", f"SELECT state, jobs, row_number() OVER (ORDER BY jobs DESC, state) AS rank FROM (SELECT {JOB} AS state, count(*) AS jobs FROM orders GROUP BY ALL)")
def state_ranks(spark, d):
    return D.state_ranks(D.transitions(V.jobs(spark, d))).withColumn("rank", F.col("rank").cast("long"))


def _streamed(rows, folder):
    """``rows`` written to ``folder`` and read as a stream, with a last row of no key in a far year, by which the watermark
    passes all others."""
    end = rows.sparkSession.range(1).select(*((F.lit("2100-01-01").cast(f.dataType) if f.name == "at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema))
    rows.write.parquet(f"{folder}/in/a")
    end.write.parquet(f"{folder}/in/b")
    return rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in/*")


@query("job_transitions", """WITH c AS (SELECT o_orderkey AS job_id, o_orderstatus AS s, unnest(range(5)) AS step FROM orders)
SELECT job_id, CASE step WHEN 0 THEN 'create' WHEN 3 THEN CASE s WHEN 'F' THEN 'complete' WHEN 'P' THEN 'fail' ELSE 'reset by hand' END WHEN 4 THEN 'pause' ELSE 'start' END AS command,
CASE WHEN step = 1 THEN 'pending' WHEN step > 0 AND (step < 4 OR s NOT IN ('F', 'P')) THEN 'running' WHEN step = 4 THEN CASE s WHEN 'F' THEN 'completed' ELSE 'failed' END END AS before,
step IN (0, 1) OR step = 3 AND s IN ('F', 'P') OR step = 4 AND s NOT IN ('F', 'P') AS accepted,
CASE WHEN step = 2 THEN 'the job is running' WHEN step = 3 AND s NOT IN ('F', 'P') THEN 'unknown command' WHEN step = 4 AND s IN ('F', 'P') THEN CASE s WHEN 'F' THEN 'the job is completed' ELSE 'the job is failed' END END AS reason FROM c""")
def job_transitions(spark, d):
    """Commands as a stream through the state machine, and its answers."""
    folder = work_folder(spark)
    return written(J.transitions(_streamed(V.job_commands(spark, d), folder)), folder).select("job_id", "command", "before", "accepted", "reason")


@query("jobs_due", f"SELECT id FROM (SELECT o_orderkey AS id, {JOB} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) WHERE status = 'completed'")
def jobs_due(spark, d):
    return J.due(V.jobs(spark, d)).select("id")


@query("jobs_startup", f"SELECT c_custkey AS credential_id, NULL::BIGINT AS job_id, unnest(['create', 'start']) AS command FROM customer WHERE c_acctbal >= 0 AND c_custkey % 4 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, o_orderkey, 'reset' FROM orders JOIN customer ON c_custkey = o_custkey WHERE {JOB} = 'running' AND c_acctbal >= 0 AND c_custkey % 4 > 0")
def jobs_startup(spark, d):
    kind = F.when(F.col("id") % 4 == 0, "api-key").when(F.col("id") % 4 == 1, "oauth").otherwise("imap")
    return J.startup(V.credentials(spark, d).withColumn("credential_type", kind), V.jobs(spark, d)).select("credential_id", "job_id", "command")


@query("upsert_dedup", "SELECT l_orderkey AS job_id, l_linenumber AS source_identifier, min(l_partkey) AS email_id FROM lineitem GROUP BY ALL")
def upsert_dedup(spark, d):
    return D.deduplicated(V.items(spark, d).select("job_id", "source_identifier", "email_id", "size_bytes"), ["job_id", "source_identifier"], ["email_id", "size_bytes"]).drop("size_bytes")


@query("upsert_over_batches", "SELECT l_orderkey AS job_id, l_linenumber AS source_identifier, CASE WHEN min(l_linenumber) <= 3 THEN 'first' WHEN min(l_linenumber) <= 5 THEN 'second' ELSE 'third' END AS batch, min(l_partkey) AS email_id FROM lineitem GROUP BY ALL")
def upsert_over_batches(spark, d):
    """Items in three batches that overlap; each item is taken from the first that has it."""
    items = V.items(spark, d).select("job_id", "source_identifier", "email_id")
    index, number = KeyIndex(spark, work_folder(spark), ("job_id", "source_identifier")), F.col("source_identifier")
    parts = {"first": number <= 3, "second": number.between(2, 5), "third": F.lit(True)}
    taken = [index.add(items.where(own), label).withColumn("batch", F.lit(label)) for label, own in parts.items()]
    return taken[0].unionByName(taken[1]).unionByName(taken[2])


@query("item_rollup", f"SELECT {ITEM} AS status, l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY ROLLUP (1, 2)")
def item_rollup(spark, d):
    t = V.table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "skipped").otherwise("completed")
    return t.rollup(status.alias("status"), F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"))


@query("unknown_enum_default", "SELECT o_orderkey AS id, CASE WHEN lower(o_orderpriority) IN ('low', 'medium') THEN lower(o_orderpriority) ELSE 'low' END AS priority, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'pending' END AS status FROM orders")
def unknown_enum_default(spark, d):
    t = V.table(spark, d, "orders")
    raw = F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("unheard of")
    return t.select(F.col("o_orderkey").alias("id"), S.decoded(F.col("o_orderpriority"), "priority", "low").alias("priority"), S.decoded(raw, "job_status", "pending").alias("status"))


# mail

@query("emails_page", "SELECT doc_id AS id, source AS folder, 1704067200000 + doc_id * 60000 AS date_received FROM documents ORDER BY date_received DESC, id LIMIT 20 OFFSET 40")
def emails_page(spark, d):
    return E.page(V.emails(spark, d), None, 20, 40).select("id", "folder", "date_received")


@query("emails_folder_page", "SELECT doc_id AS id, 1704067200000 + doc_id * 60000 AS date_received FROM documents WHERE source = 'src3' ORDER BY date_received DESC, id LIMIT 20")
def emails_folder_page(spark, d):
    return E.page(V.emails(spark, d), "src3").select("id", "date_received")


@query("emails_search", "SELECT doc_id AS id, (SELECT count(*) FROM documents WHERE contains(lower(text), 'worthless')) AS total, 20 < (SELECT count(*) FROM documents WHERE contains(lower(text), 'worthless')) AS has_more FROM documents WHERE contains(lower(text), 'worthless') ORDER BY doc_id DESC LIMIT 20")
def emails_search(spark, d):
    return E.search(V.emails(spark, d), "Worthless").select("id", "total", "has_more")


@query("emails_search_index", SQL["emails_search"])
def emails_search_index(spark, d):
    """The same search by an index of two segments."""
    index, own = TextIndex(spark, work_folder(spark)), V.emails(spark, d)
    for label, half in (("even", own.where("id % 2 = 0")), ("odd", own.where("id % 2 = 1"))):
        index.add(half, label)
    return index.search(own, "Worthless").select("id", "total", "has_more")


@query("emails_address_arrays", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 1 ELSE 2 END AS recipients, CASE WHEN c_custkey % 3 > 0 THEN c_name || '@example.com' END AS first_recipient FROM customer")
def emails_address_arrays(spark, d):
    t, name = V.table(spark, d, "customer"), F.concat(F.col("c_name"), F.lit("@example.com"))
    entry = lambda e: F.struct(e.alias("email"), F.lit("x").alias("name"))
    none = F.lit(None).cast("string")
    json = F.when(F.col("c_custkey") % 3 == 0, F.lit("not json")).when(F.col("c_custkey") % 3 == 1, F.to_json(F.array(entry(name), entry(none)))).otherwise(F.to_json(F.array(entry(name), entry(name))))
    read = t.select(F.col("c_custkey").alias("id"), S.addresses(json).alias("to"))
    return read.select("id", F.size("to").alias("recipients"), F.get("to", 0)["email"].alias("first_recipient"))


@query("email_by_id", "SELECT c_custkey AS id, [c_name || '@example.com'] AS \"to\", 0::INTEGER AS cc, ['label ' || c_mktsegment] AS labels FROM customer WHERE c_custkey = 7")
def email_by_id(spark, d):
    """A message whose arrays are kept as JSON text, of which one is broken."""
    t = V.table(spark, d, "customer")
    to = F.to_json(F.array(F.struct(F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"), F.lit("x").alias("name"))))
    kept = t.select(F.col("c_custkey").alias("id"), to.alias("to_addresses"), F.lit("broken [").alias("cc_addresses"), F.lit(None).cast("string").alias("bcc_addresses"), F.to_json(F.array(F.concat(F.lit("label "), F.col("c_mktsegment")))).alias("labels"))
    return E.by_id(kept, 7).select("id", F.transform("to_addresses", lambda a: a["email"]).alias("to"), (F.size("cc_addresses") + F.size("bcc_addresses")).alias("cc"), "labels")


@query("attachments_for_email", "SELECT page_id AS id, url AS filename FROM pages WHERE page_id % 50 = 7 ORDER BY page_id")
def attachments_for_email(spark, d):
    files = V.table(spark, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 50).alias("email_id"), F.col("url").alias("filename"))
    return E.attachments_of(files, 7).select("id", "filename")


FILES = """SELECT doc_id, '2' AS part, 'doc-' || doc_id || '.txt' AS filename, 'text/plain' AS content_type, coalesce(text, '') AS content, false AS is_inline FROM documents
UNION ALL SELECT doc_id, '4', 'logo.png', 'image/png', 'picture of all', true FROM documents"""


@query("mail_attachments", f"SELECT doc_id AS email_id, part, filename, content_type, is_inline, strlen(content) AS size_bytes, sha256(content) AS checksum FROM ({FILES})")
def mail_attachments(spark, d):
    """Attachments of raw messages, but for those that are calendars and cards."""
    found = mime.attachment_rows(mime.parts(V.raw_messages(spark, d)))
    return found.where(A.route(F.col("filename"), F.col("content_type")).isNull()).select("email_id", "part", "filename", "content_type", "is_inline", "size_bytes", "checksum")


@query("attachment_references", f"SELECT sha256(content) AS checksum, count(*) AS \"references\", strlen(any_value(content)) AS size_bytes, sum(strlen(content))::BIGINT AS bytes_in_mail FROM ({FILES}) GROUP BY content")
def attachment_references(spark, d):
    """Messages go into a store in two batches, of which the second is written twice; each content is there once."""
    store, raw = mime.AttachmentStore(spark, work_folder(spark)), V.raw_messages(spark, d)
    for batch in (0, 1, 1):
        store.add(raw.where(F.col("email_id") % 2 == batch), batch)
    kept = store.attachments().where(A.route(F.col("filename"), F.col("content_type")).isNull())
    return mime.references(kept).join(store.contents().select("checksum"), "checksum")


@query("attachment_entities", """SELECT doc_id AS email_id, '3' AS part, 'event' AS data_type, 'Meeting ' || doc_id AS name, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%dT09:00:00+00:00') AS date FROM documents
UNION ALL SELECT doc_id, '5.2', 'contact', 'Person ' || doc_id, NULL FROM documents WHERE doc_id % 3 = 0""")
def attachment_entities(spark, d):
    found = mime.entities(mime.parts(V.raw_messages(spark, d)), ("email_id",))
    return found.select("email_id", "part", "data_type", F.coalesce("event.name", "contact.name").alias("name"), "event.date")


@query("contact_emails_in_text", rf"SELECT address, count(DISTINCT doc_id) AS messages FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{E.ADDRESS}')) AS address FROM documents) GROUP BY address")
def contact_emails_in_text(spark, d):
    return E.addresses_in_text(V.emails(spark, d))


@query("checksum_duplicates", "SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def checksum_duplicates(spark, d):
    return E.checksum_duplicates(V.emails(spark, d))


@query("mail_threads", "SELECT conv_id * 1000 + min(turn) AS thread, count(DISTINCT turn) AS messages FROM conversations GROUP BY conv_id")
def mail_threads(spark, d):
    """Turns of a conversation as messages of which each answers the one before it."""
    number = F.col("session_id") * 1000 + F.col("turn")
    before = F.lag("turn").over(Window.partitionBy("session_id").orderBy("turn"))
    turns = V.messages(spark, d).select("session_id", "turn").distinct()
    messages = turns.select(number.alias("message_id"), (F.col("session_id") * 1000 + before).alias("in_reply_to"))
    return E.threads(messages).groupBy("thread").agg(F.count("*").alias("messages"))


@query("mail_threads_references", """WITH t AS (SELECT DISTINCT conv_id, turn, 'c' || conv_id || '-' || turn AS id, turn % 3 <> 1 OR turn < 2 AS known FROM conversations),
n AS (SELECT conv_id, id, known FROM t WHERE known UNION SELECT conv_id, 'c' || conv_id || '-' || (turn - k), false FROM t, range(1, 3) AS r(k) WHERE known AND turn - k >= 0)
SELECT min(id) AS thread, count(DISTINCT id) FILTER (known) AS messages, count(DISTINCT id) - count(DISTINCT id) FILTER (known) AS missing FROM n GROUP BY conv_id""")
def mail_threads_references(spark, d):
    """Turns as messages that name the two before them, of which some never came, merged in two batches."""
    turns = V.messages(spark, d).select("session_id", "turn").distinct().where("turn % 3 <> 1 or turn < 2")
    name = lambda t: F.concat(F.lit("c"), F.col("session_id").cast("string"), F.lit("-"), t.cast("string"))
    before = lambda k: F.when(F.col("turn") >= k, name(F.col("turn") - k))
    messages = turns.select("turn", name(F.col("turn")).alias("message_id"), before(1).alias("in_reply_to"), F.array_compact(F.array(before(2), before(1))).alias("references"))
    store = ThreadStore(spark, work_folder(spark))
    for batch in (0, 1):
        store.merge(messages.where((F.col("turn") >= 4) == F.lit(batch == 0)), batch)
    return store.threads().groupBy("thread").agg(F.count_if("known").alias("messages"), F.count_if(~F.col("known")).alias("missing"))


@query("search_predicate", f"SELECT o_orderkey AS uid FROM orders WHERE o_orderkey > 100 AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 360 ORDER BY uid LIMIT 50")
def search_predicate(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.to_date("o_orderdate").alias("date"))
    return Y.search(rows, AS_OF, 12, 100, 50).select("uid")


@query("mailbox_search", "SELECT source AS folder, doc_id AS uid, strlen(text) AS size_bytes FROM documents WHERE source IN ('src1', 'src3') AND doc_id BETWEEN 101 AND 900 AND doc_id * 60000 >= 12345678")
def mailbox_search(spark, d):
    """Documents become a mailbox archive, which is read again with filters that its reader takes."""
    t, path = V.table(spark, d, "documents"), work_folder(spark)
    archive(t.select(F.col("source").alias("folder"), F.col("doc_id").alias("uid"), F.encode("text", "UTF-8").alias("raw"), (F.lit(V.EPOCH * 1000) + F.col("doc_id") * 60000).alias("internal_date")), path)
    found = searched(spark, archive=path, batch="500").where(F.col("folder").isin("src1", "src3") & F.col("uid").between(101, 900) & (F.col("internal_date") >= V.EPOCH * 1000 + 12345678))
    return found.select("folder", "uid", F.octet_length("raw").cast("long").alias("size_bytes"))


@query("sync_strategies", f"SELECT 'folders' AS kind, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT 'range', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}'")
def sync_strategies(spark, d):
    a = Y.strategy(V.emails(spark, d), "folders", ("src1", "src2")).agg(F.lit("folders").alias("kind"), F.count("*").alias("n"))
    rows = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return a.unionByName(Y.strategy(rows, "date-range", start="1996-01-01", end=AS_OF).agg(F.lit("range").alias("kind"), F.count("*").alias("n")))


@query("workbook_round_trip", f"SELECT o_orderkey AS id, o_custkey AS account_id, CAST({MONEY.format('o_totalprice')} AS DOUBLE) AS amount, o_orderpriority AS category FROM orders")
def workbook_round_trip(spark, d):
    """Transactions as workbooks, and read again."""
    made = workbooks(V.transactions(spark, d).select("id", F.col("account_id").alias("account"), "amount", "category"), 20_000)
    return import_workbooks(made, "finance_transactions", {"account": "account_id"}).select("id", "account_id", F.col("amount").cast("double").alias("amount"), "category")


@query("file_filter", "SELECT page_id AS id FROM pages WHERE contains(url, '/en/') AND strlen(html) BETWEEN 1000 AND 4000")
def file_filter(spark, d):
    t = V.table(spark, d, "pages")
    return t.where(wanted(F.col("url"), F.octet_length("html"), (), "/en/", 1000, 4000)).select(F.col("page_id").alias("id"))


@query("mask_keys", "SELECT c_custkey AS id, left(c_name, 6) || repeat('*', length(c_name) - 6) AS masked FROM customer WHERE length(c_name) > 6 UNION ALL SELECT c_custkey, c_name FROM customer WHERE length(c_name) <= 6")
def mask_keys(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.masked(F.col("c_name")).alias("masked"))


@query("template_render", "SELECT c_custkey AS id, 'Dear ' || c_name || ', segment ' || c_mktsegment || '.' AS text FROM customer")
def template_render(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.rendered(F.lit("Dear {name}, segment {kind}."), {"name": F.col("c_name"), "kind": F.col("c_mktsegment")}).alias("text"))


# finance and travel

ACCOUNT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'checking' WHEN 'MACHINERY' THEN 'savings' WHEN 'AUTOMOBILE' THEN 'credit_card' ELSE 'other' END"
BALANCE, PRICE = MONEY.format("c_acctbal"), MONEY.format("o_totalprice")


@query("finance_health", f"WITH a AS (SELECT {ACCOUNT} AS k, {BALANCE} AS b FROM customer), s AS (SELECT sum(CASE WHEN k = 'checking' THEN b ELSE 0 END) AS c, sum(CASE WHEN k = 'savings' THEN b ELSE 0 END) AS s, -sum(CASE WHEN k = 'credit_card' THEN b ELSE 0 END) AS e FROM a) SELECT CAST(c AS DOUBLE) AS checking, CAST(s AS DOUBLE) AS savings, CAST(e AS DOUBLE) AS debt, CAST(c + s - e AS DOUBLE) AS net FROM s")
def finance_health(spark, d):
    return M.health(V.accounts(spark, d))


MONTH = "1996-03-01"
BY_CATEGORY = f"SELECT o_orderpriority AS category, CAST(sum({PRICE}) AS DOUBLE) AS total, count(*) AS n FROM orders WHERE o_orderdate >= DATE '{MONTH}' AND o_orderdate < DATE '{MONTH}' + INTERVAL 1 MONTH GROUP BY ALL"


@query("spend_by_category_month", BY_CATEGORY)
def spend_by_category_month(spark, d):
    return M.by_category(V.transactions(spark, d), MONTH)


@query("spend_top5", f"{BY_CATEGORY} ORDER BY total DESC, category LIMIT 3")
def spend_top5(spark, d):
    return M.top_categories(V.transactions(spark, d), MONTH, 3)


@query("spend_mom", f"SELECT month, CAST(total AS DOUBLE) AS total, CAST(total - lag(total) OVER (ORDER BY month) AS DOUBLE) AS change FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum({PRICE}) AS total FROM orders GROUP BY ALL)")
def spend_mom(spark, d):
    return M.month_over_month(V.transactions(spark, d))


@query("spend_trend6", f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN {PRICE} ELSE 0 END) AS DOUBLE) AS income, CAST(sum(CASE WHEN o_orderstatus <> 'O' THEN {PRICE} ELSE 0 END) AS DOUBLE) AS expense FROM orders WHERE o_orderdate >= DATE '1996-09-01' AND o_orderdate < DATE '1997-03-01' GROUP BY ALL")
def spend_trend6(spark, d):
    return M.trend(V.transactions(spark, d), "1997-03-15")


@query("savings_forecast", f"SELECT round(regr_slope(total, x), 2) AS slope, round(regr_intercept(total, x), 2) AS intercept FROM (SELECT CAST(sum({PRICE}) AS DOUBLE) AS total, CAST(datediff('month', DATE '1990-01-01', CAST(date_trunc('month', o_orderdate) AS DATE)) AS DOUBLE) AS x FROM orders GROUP BY date_trunc('month', o_orderdate))")
def savings_forecast(spark, d):
    return M.forecast(V.transactions(spark, d))


RUNNING = f"sum({PRICE}) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("balance_running", f"SELECT o_custkey AS account_id, o_orderkey AS id, CAST({RUNNING} AS DOUBLE) AS balance FROM orders")
def balance_running(spark, d):
    return M.running_balance(V.transactions(spark, d))


@query("low_balance_alert", f"WITH r AS (SELECT o_custkey AS account_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, {RUNNING} AS spent FROM orders) SELECT account_id, date, id FROM (SELECT r.*, row_number() OVER (PARTITION BY account_id ORDER BY date, id) AS n FROM r JOIN customer ON c_custkey = account_id WHERE {BALANCE} * 100 - spent < 1000) WHERE n = 1")
def low_balance_alert(spark, d):
    return M.first_below(V.accounts(spark, d), V.transactions(spark, d), 1000)


CROSSINGS = f"""WITH t AS (SELECT o_custkey AS account_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 = 0 THEN {PRICE} ELSE -{PRICE} END AS change FROM orders),
b AS (SELECT t.*, {BALANCE} + sum(change) OVER (PARTITION BY account_id ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM t JOIN customer ON c_custkey = account_id)
SELECT account_id, id, day, CAST(balance AS DOUBLE) AS balance FROM b WHERE balance < -100000 AND balance - change >= -100000"""


@query("balance_alerts", CROSSINGS)
def balance_alerts(spark, d):
    found = M.crossings(V.accounts(spark, d), V.account_changes(spark, d), "-100000")
    return found.select("account_id", "id", F.to_date("at").alias("day"), F.col("balance").cast("double").alias("balance"))


@query("balance_alerts_stream", CROSSINGS)
def balance_alerts_stream(spark, d):
    """The same alerts from a stream of the transactions."""
    folder = work_folder(spark)
    found = written(alerts(_streamed(V.account_changes(spark, d), folder), V.accounts(spark, d), "-100000"), folder)
    return found.select("account_id", "id", F.to_date(F.timestamp_millis("at")).alias("day"), F.col("balance").cast("double").alias("balance"))


@query("large_transactions", f"SELECT o_orderkey AS id, CAST({PRICE} AS DOUBLE) AS amount, CAST(o_orderdate AS DATE) AS date FROM orders WHERE {PRICE} > 100000 AND CAST(o_orderdate AS DATE) > DATE '1997-01-01'")
def large_transactions(spark, d):
    return M.large(V.transactions(spark, d), 100000, "1997-01-01")


COST = MONEY.format("s_acctbal")


@query("travel_budget", f"SELECT n_nationkey AS id, n_name AS name, CAST((n_nationkey + 1) * 1000 AS DOUBLE) AS budget, CAST(coalesce(sum({COST}), 0) AS DOUBLE) AS cost, CAST((n_nationkey + 1) * 1000 - coalesce(sum({COST}), 0) AS DOUBLE) AS left FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name".replace(" AS left", ' AS "left"'))
def travel_budget(spark, d):
    return M.trip_budgets(V.destinations(spark, d), V.activities(spark, d))


@query("cross_project_range", f"SELECT n_nationkey AS trip_id, count(*) AS n, CAST(sum({PRICE}) AS DOUBLE) AS total FROM orders JOIN nation ON CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' + CAST(n_nationkey * 20 AS INTEGER) AND DATE '1995-01-01' + CAST(n_nationkey * 20 + 9 AS INTEGER) GROUP BY ALL")
def cross_project_range(spark, d):
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("id") * 20)
    trips = V.destinations(spark, d).select(F.col("id").alias("trip_id"), start.alias("arrival"), F.date_add(start, 9).alias("departure"))
    return M.during(V.transactions(spark, d), trips)


@query("events_during_stays", """SELECT s_suppkey AS stay, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events JOIN supplier ON epoch_ms(ts) BETWEEN 1704067200000 + s_suppkey * 7654321 AND 1704067200000 + s_suppkey * 7654321 + (s_suppkey % 40) * 5000001 GROUP BY ALL""")
def events_during_stays(spark, d):
    """Events by the stays in which they fall, to the millisecond."""
    low = F.lit(V.EPOCH * 1000) + F.col("s_suppkey") * 7654321
    stays = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("stay"), low.alias("low"), (low + (F.col("s_suppkey") % 40) * 5000001).alias("high"))
    events = V.table(spark, d, "events").select("event_id", V.millis("ts").alias("at"))
    return within(events, "at", stays, "low", "high").groupBy("stay").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# projects, tasks, calendar

@query("project_completion", "SELECT c_custkey AS id, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, round(CASE WHEN count(o_orderkey) > 0 THEN count(*) FILTER (o_orderstatus = 'F') / count(o_orderkey) ELSE 0 END, 6) AS share FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def project_completion(spark, d):
    return C.completion(V.projects(spark, d), V.tasks(spark, d))


@query("tasks_due_window", f"SELECT o_orderkey AS id, {TASK} AS status, {PRIORITY} AS priority, CAST(o_orderdate AS DATE) AS due_date FROM orders WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) >= DATE '1996-06-15' AND CAST(o_orderdate AS DATE) < DATE '1996-06-22'")
def tasks_due_window(spark, d):
    return C.due_within(V.tasks(spark, d), "1996-06-15")


@query("tasks_overdue", f"SELECT {PRIORITY} AS priority, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) < DATE '1996-06-15' GROUP BY ALL")
def tasks_overdue(spark, d):
    return C.overdue(V.tasks(spark, d), "1996-06-15")


@query("calendar_month_counts", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type AS name, count(*) AS n FROM events GROUP BY ALL")
def calendar_month_counts(spark, d):
    return C.month_counts(V.calendar(spark, d))


@query("calendar_grid", "WITH days AS (SELECT CAST(unnest(range(DATE '2023-12-31', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, CAST(dayofweek(day) AS INTEGER) AS weekday, count(event_id) AS n, month(day) = 1 AS in_month FROM days LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY ALL")
def calendar_grid(spark, d):
    return C.grid(V.calendar(spark, d), "2024-01-01")


@query("calendar_summary", "SELECT count(*) FILTER (date_trunc('month', ts) = DATE '2024-01-01') AS this_month, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-20') AS today, count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-20') AS upcoming FROM events")
def calendar_summary(spark, d):
    return C.summary(V.calendar(spark, d), "2024-01-20")


@query("link_entities", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS linked_id, o_orderkey % 4 = 0 AS requires_review FROM orders")
def link_entities(spark, d):
    own = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.lit("Nobody"))
    return C.linked(own.select(F.col("o_orderkey").alias("id"), named.alias("project_name")), V.projects(spark, d))


NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("entity_candidates", f"""WITH w AS (SELECT doc_id, array_to_string(list_slice(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1, 5), ' ') AS name FROM documents),
e AS (SELECT {NORMAL.format("name")} AS name, min(doc_id) AS entity_id, count(DISTINCT doc_id) AS entities FROM w WHERE {NORMAL.format("name")} <> '' AND doc_id % 2 = 0 GROUP BY 1),
m AS (SELECT doc_id AS id, {NORMAL.format("left(name, 5) || substr(name, 7)")} AS name FROM w),
eg AS (SELECT *, list_distinct([substr('  ' || name || ' ', i, 3) FOR i IN range(1, length(name) + 2)]) AS g FROM e),
mg AS (SELECT *, list_distinct([substr('  ' || name || ' ', i, 3) FOR i IN range(1, length(name) + 2)]) AS g FROM (SELECT DISTINCT name FROM m WHERE name <> '')),
p AS (SELECT mg.name, eg.entity_id, eg.entities, eg.name AS other, len(list_intersect(mg.g, eg.g)) AS common, len(mg.g) + len(eg.g) AS both_sizes FROM mg JOIN eg ON len(mg.g) >= 0.5 * len(eg.g) - 1e-9 AND len(eg.g) >= 0.5 * len(mg.g) - 1e-9),
s AS (SELECT name, entity_id, entities, other, common / (both_sizes - common) AS score FROM p WHERE common / (both_sizes - common) >= 0.5 - 1e-9),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, entity_id, other) AS k, lead(score) OVER (PARTITION BY name ORDER BY score DESC, entity_id, other) AS next_score, count(*) OVER (PARTITION BY name) AS n FROM s)
SELECT m.id, CASE WHEN r.score >= 0.7 - 1e-9 AND r.entities = 1 AND (next_score IS NULL OR r.score - next_score > 0.05) THEN r.entity_id END AS linked_id, round(r.score, 6) AS score, coalesce(n, 0)::INTEGER AS candidates FROM m LEFT JOIN r ON r.name = m.name AND r.k = 1""")
def entity_candidates(spark, d):
    """The first words of every text as a mention, with a letter lost, of projects that are named by the first words of every
    second text."""
    head = F.regexp_extract(F.coalesce("body_text", F.lit("")), r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){0,5}+", 0)
    words = F.regexp_extract_all(head, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # texts are read once, names several times
    V.emails(spark, d).select("id", F.array_join(words, " ").alias("name")).write.parquet(folder := work_folder(spark))
    named = spark.read.schema("id long, name string").parquet(folder)
    lost = F.concat(F.substring("name", 1, 5), F.substring("name", 7, 1 << 30))
    found = R.resolved(named.select("id", lost.alias("name")), named.where("id % 2 = 0"))
    return found.select("id", "linked_id", F.round("score", 6).alias("score"), F.size("candidates").alias("candidates"))


# entity extraction

def _cards(spark, d):
    t = V.table(spark, d, "customer")
    content = A.contact_card(F.col("c_name"), F.concat(F.col("c_name"), F.lit("@example.com")), F.col("c_custkey").cast("string"), F.col("c_mktsegment"))
    return t.select(F.col("c_custkey").alias("id"), F.lit("a.vcf").alias("filename"), F.lit("text/vcard").alias("content_type"), content.alias("content"))


@query("vcf_parse", "SELECT c_custkey AS id, c_name AS name, c_name || '@example.com' AS email, CAST(c_custkey AS VARCHAR) AS phone, c_mktsegment AS organization FROM customer")
def vcf_parse(spark, d):
    return A.valid_files(A.contacts(_cards(spark, d))).select("id", "name", "email", "phone", "organization")


@query("vcf_last_wins", "SELECT c_custkey AS id, 'last@example.com' AS email FROM customer")
def vcf_last_wins(spark, d):
    files = _cards(spark, d).withColumn("content", F.replace("content", F.lit("ORG:"), F.lit("EMAIL:last@example.com\nORG:")))
    return A.contacts(files).select("id", "email")


@query("vcf_missing_fn", "SELECT c_custkey AS id, 'a required property is missing or broken' AS reason FROM customer WHERE c_custkey % 10 = 0")
def vcf_missing_fn(spark, d):
    bad = F.when(F.col("id") % 10 == 0, F.replace("content", F.lit("FN:"), F.lit("FN;CHARSET=UTF-8:"))).otherwise(F.col("content"))
    return A.rejects(A.contacts(_cards(spark, d).withColumn("content", bad)), "id").select("id", "reason")


def _calendars(spark, d):
    t = V.table(spark, d, "orders")
    content = A.calendar_file(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), [F.concat(F.lit("mailto:c"), F.col("o_custkey").cast("string")), F.lit("MAILTO:other")])
    return t.select(F.col("o_orderkey").alias("id"), F.lit("a.ics").alias("filename"), F.lit("Text/Calendar; charset=utf-8").alias("content_type"), content.alias("content"))


@query("ics_parse", "SELECT o_orderkey AS id, 'Order ' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS start FROM orders")
def ics_parse(spark, d):
    return A.valid_files(A.calendar_events(_calendars(spark, d))).select("id", "name", F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"))


@query("ics_attendees", "SELECT o_orderkey AS id, 'c' || o_custkey AS attendees, CAST(1 AS INTEGER) AS n FROM orders")
def ics_attendees(spark, d):
    return A.calendar_events(_calendars(spark, d)).select("id", F.array_join("attendees", ",").alias("attendees"), F.size("attendees").alias("n"))


@query("recurring_events", """SELECT c_custkey AS id, CAST(unnest(CASE c_custkey % 3
WHEN 0 THEN list_filter([DATE '2024-01-01' + CAST(c_custkey % 50 + 3 * i AS INTEGER) FOR i IN range(10)], lambda x: x >= DATE '2024-02-01' AND x < DATE '2024-03-01')
WHEN 1 THEN [DATE '2024-02-05' + CAST(7 * i AS INTEGER) FOR i IN range(4)] || [DATE '2024-02-07' + CAST(7 * i AS INTEGER) FOR i IN range(3)]
ELSE [DATE '2024-02-15', DATE '2024-02-29'] END) AS DATE) AS day, 8 AS hour FROM customer""")
def recurring_events(spark, d):
    """Occurrences in February 2024 of a rule for each customer, at nine in a zone an hour before UTC."""
    t = V.table(spark, d, "customer")
    start = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 50).cast("int")), "yyyyMMdd'T'090000")
    rule = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("DTSTART;TZID=Europe/Paris:"), start, F.lit("\r\nRRULE:FREQ=DAILY;INTERVAL=3;COUNT=10")))
    rule = rule.when(F.col("c_custkey") % 3 == 1, F.lit("DTSTART;TZID=Europe/Paris:20240101T090000\r\nRRULE:FREQ=WEEKLY;BYDAY=MO,WE;UNTIL=20240301T000000Z\r\nEXDATE;TZID=Europe/Paris:20240228T090000"))
    rule = rule.otherwise(F.lit("DTSTART;TZID=Europe/Paris:20230115T090000\r\nRRULE:FREQ=MONTHLY;BYMONTHDAY=15,-1"))
    content = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.lit("SUMMARY:x"), rule, F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    found = expanded(t.select(F.col("c_custkey").alias("id"), content.alias("content")), "2024-02-01T00:00:00", "2024-03-01T00:00:00")
    return found.select("id", F.to_date("at").alias("day"), F.hour("at").alias("hour"))


@query("ics_date_forms", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def ics_date_forms(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(A.ics_time(raw), "yyyy-MM-dd").alias("day"))


@query("attachment_route", "SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN 'calendar' WHEN 1 THEN 'calendar' WHEN 2 THEN 'card' WHEN 3 THEN NULL ELSE 'calendar' END AS kind FROM pages")
def attachment_route(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("page_id") % 5 + 1).cast("int"))
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), A.route(pick("a.bin", "a.ics", "a.vcf", "A.ICS", "a.vcf"), pick("TEXT/Calendar; x=1", "application/x", "x/y", "application/octet-stream", "text/calendar")).alias("kind"))


@query("entities_extracted", "SELECT 'contact' AS data_type, count(*) AS n, round(avg(0.97), 4) AS confidence FROM customer UNION ALL SELECT 'event', count(*), 0.98 FROM orders")
def entities_extracted(spark, d):
    files = _cards(spark, d).unionByName(_calendars(spark, d).withColumn("id", -F.col("id")))
    found = A.extracted(files, "id")
    return found.groupBy("data_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("confidence"))


def _texts(spark, d):
    t = V.table(spark, d, "orders")
    date = F.date_format("o_orderdate", "M/d/yyyy")
    text = F.concat_ws("\n", F.concat(F.lit("Order task due by "), date), F.concat(F.lit("Assigned to: @clerk"), F.col("o_custkey").cast("string")), F.concat(F.lit("1. Ship order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("[Project "), F.col("o_custkey").cast("string"), F.lit("] for the acme project")), F.concat(F.lit("meeting with bob on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" cancelled")).otherwise(F.lit(""))))
    return t.select(F.col("o_orderkey").alias("id"), text.alias("text"))


def _pattern(name: str):
    return lambda spark, d: P.matches(_texts(spark, d), only=(name,)).select("id", "value", "confidence", "requires_review")


for _name, _value, _where, _confidence in (
    ("due_date", "strftime(o_orderdate, '%-m/%-d/%Y')", "true", 0.9),
    ("assignee", "'clerk' || o_custkey", "true", 0.8),
    ("numbered", "'Ship order ' || o_orderkey", "true", 0.75),
    ("bracket_project", "'Project ' || o_custkey", "true", 0.85),
    ("meeting", "'meeting'", "true", 0.8),
):
    query({"bracket_project": "pattern_project"}.get(_name, f"pattern_{_name}"), f"SELECT o_orderkey AS id, {_value} AS value, CAST({_confidence} AS DOUBLE) AS confidence, {str(_confidence < 0.8).lower()} AS requires_review FROM orders WHERE {_where}")(_pattern(_name))


def _mixed(spark, d):
    """Texts in which context decides: near words are there or not, a negated word comes first, the second match fits."""
    t = V.table(spark, d, "orders")
    far = " and so on it goes for a long while in words that say nothing of it at all, as letters often do, "
    texts = (
        "Hello, this task is URGENT, see below",
        "This is urgent",
        "A task that is not urgent, but critical",
        f"This task is not urgent.{far}We need this, it is critical",
        f"Deadline: 3/4/1998, the project deadline.{far}Please complete the action, due 5/6/1998.",
        "Assigned to: ann, mail from bob",
        "Sync with eve at Jan 12 regarding the Blue Sky project",
        "nothing here",
    )
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts) + 1).cast("int"))
    return t.select(F.col("o_orderkey").alias("id"), text.alias("text"))


MIXED = """(SELECT o_orderkey AS id, unnest(CASE o_orderkey % 8 WHEN 0 THEN [{'pattern': 'priority', 'value': 'urgent'}] WHEN 3 THEN [{'pattern': 'priority', 'value': 'critical'}] WHEN 4 THEN [{'pattern': 'due_date', 'value': '5/6/1998'}]
WHEN 6 THEN [{'pattern': 'named_project', 'value': 'Blue Sky'}, {'pattern': 'meeting', 'value': 'Sync'}] ELSE [] END, recursive := true) FROM orders)"""


@query("pattern_context_rules", f"SELECT id, pattern, value FROM {MIXED}")
def pattern_context_rules(spark, d):
    return P.matches(_mixed(spark, d)).select("id", "pattern", "value")


@query("pattern_priority", f"SELECT id, value, CAST(0.85 AS DOUBLE) AS confidence, false AS requires_review FROM {MIXED} WHERE pattern = 'priority'")
def pattern_priority(spark, d):
    return P.matches(_mixed(spark, d), only=("priority",)).select("id", "value", "confidence", "requires_review")


@query("pattern_counts", "SELECT o_orderkey AS id, CAST(6 AS BIGINT) AS n FROM orders")
def pattern_counts(spark, d):
    return P.matches(_texts(spark, d)).groupBy("id").agg(F.count("*").alias("n"))


WORDS = ("worthless", "The", "and", "de ")


@query("keyword_spans", """WITH w AS (SELECT unnest(['worthless', 'the', 'and', 'de ']) AS word), t AS (SELECT doc_id AS id, word, text, instr(lower(text), word) AS p, (length(text) - length(replace(lower(text), word, ''))) // length(word) AS n FROM documents, w)
SELECT id, word, n, strlen(left(text, p - 1)) AS first_start, strlen(left(text, p - 1)) + strlen(word) AS first_stop FROM t WHERE p > 0""")
def keyword_spans(spark, d):
    """How often words stand in the texts, and where first."""
    found = K.spans(V.emails(spark, d).select("id", F.col("body_text").alias("text")), WORDS)
    return found.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.min("stop").alias("first_stop"))


@query("pattern_evidence", "SELECT o_orderkey AS id, 'due_date' AS pattern, strftime(o_orderdate, '%-m/%-d/%Y') AS value, 11::BIGINT AS start, 18 + length(strftime(o_orderdate, '%-m/%-d/%Y')) AS stop FROM orders UNION ALL SELECT o_orderkey, 'assignee', 'clerk' || o_custkey, 19 + length(strftime(o_orderdate, '%-m/%-d/%Y')), 38 + length(strftime(o_orderdate, '%-m/%-d/%Y')) + length(o_custkey::VARCHAR) FROM orders")
def pattern_evidence(spark, d):
    found = K.located(_texts(spark, d), patterns=tuple(p for p in P.PATTERNS if p.name in ("due_date", "assignee")))
    return found.select("id", "pattern", "value", "start", "stop")


@query("extraction_limits", "SELECT c_custkey AS id, 'contact' AS data_type, 'VCF Contact: ' || c_name AS evidence, (strlen('VERSION:3.0' || 'FN:' || c_name || 'EMAIL;TYPE=work:' || c_name || '@example.com' || 'TEL;TYPE=cell:' || c_custkey || 'ORG:' || c_mktsegment || 'END:VCARD') + 7)::BIGINT AS stop FROM customer")
def extraction_limits(spark, d):
    """Contacts only, one of a file, with the bytes of their cards."""
    files = _cards(spark, d).withColumn("content", F.concat("content", F.lit("\nBEGIN:VCARD\nFN:Second\nEND:VCARD"))).unionByName(_calendars(spark, d).withColumn("id", -F.col("id")))
    found = A.extracted(files, "id", "contact", 0.9, 1)
    return found.select("id", "data_type", "evidence", F.col("span.stop").alias("stop"))


@query("relative_dates", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) + 1 WHEN 1 THEN CAST(o_orderdate AS DATE) + 7 WHEN 2 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INTEGER) ELSE DATE '1999-12-31' END AS day FROM orders")
def relative_dates(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.lit("see you Tomorrow")).when(k == 1, F.lit("next week then")).when(k == 2, F.concat(F.lit("in "), (F.col("o_custkey") % 90).cast("string"), F.lit(" days"))).otherwise(F.lit("on 12/31/1999"))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), P.phrase_date(text, F.to_date("o_orderdate")).alias("day"))


SPANS = "SELECT l_orderkey AS id, l_returnflag AS label, CAST(l_quantity AS BIGINT) AS start, CAST(l_quantity AS BIGINT) + 3 AS stop, l_discount AS score FROM lineitem"


@query("span_merge", f"WITH s AS ({SPANS}), m AS (SELECT *, max(stop) OVER (PARTITION BY id, label ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), i AS (SELECT *, sum(CASE WHEN e IS NULL OR start > e + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY id, label ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT id, label, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM i GROUP BY id, label, k")
def span_merge(spark, d):
    t = V.table(spark, d, "lineitem")
    start = F.col("l_quantity").cast("long")
    spans = t.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("label"), start.alias("start"), (start + 3).alias("stop"), F.col("l_discount").alias("score"))
    return P.merged_spans(spans, "id").select("id", "label", "start", "stop", "parts")


@query("confidence_adjust", "SELECT doc_id AS id, round(least(CAST(0.7 AS DOUBLE) * (CASE WHEN contains(lower(text), 'the') THEN 1.2 ELSE 0.8 END) * (CASE WHEN contains(lower(text), 'worthless') THEN 0.3 ELSE 1.0 END) * (CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.5 END), 1.0), 6) AS confidence FROM documents")
def confidence_adjust(spark, d):
    return V.emails(spark, d).select("id", P.adjusted(F.lit(0.7), F.col("body_text"), ("the",), ("worthless",), "[0-9]").alias("confidence"))


@query("llm_parse", f"SELECT o_orderkey AS id, 'Ship ' || o_orderkey AS title, CASE WHEN {PRIORITY} <> 'medium' THEN {PRIORITY} END AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.7 END AS confidence, o_orderkey % 2 = 1 AS requires_review FROM orders WHERE o_orderkey % 10 > 0")
def llm_parse(spark, d):
    t = V.tasks(spark, d)
    task = F.struct(F.when(F.col("id") % 10 > 0, F.concat(F.lit("Ship "), F.col("id").cast("string"))).alias("title"), F.when(F.col("priority") == "medium", "middling").otherwise(F.col("priority")).alias("priority"), F.when(F.col("id") % 2 == 0, 0.9).alias("confidence"))
    return P.model_answers(t.select("id", F.to_json(F.struct(F.array(task).alias("tasks"))).alias("response"))).drop("due_date")


@query("llm_projects", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'on-hold' END AS status, '2026-01-31' AS deadline, 0.7::DOUBLE AS confidence, true AS requires_review FROM customer WHERE c_custkey % 10 > 0")
def llm_projects(spark, d):
    t = V.projects(spark, d)
    project = F.struct(F.when(F.col("id") % 10 > 0, F.col("name")).alias("name"), F.when(F.col("id") % 3 == 0, "sleeping").otherwise("on-hold").alias("status"), F.lit("2026-01-31").alias("deadline"))
    return P.model_results(t.select("id", F.to_json(F.struct(F.array(project).alias("projects"))).alias("response")), "project").drop("description")


@query("llm_events", "SELECT event_id AS id, event_type AS name, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 2 = 0 THEN 'Room 1' END AS location, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END::INTEGER AS attendees, user_id AS project_id FROM events WHERE event_id % 7 > 0")
def llm_events(spark, d):
    t = V.calendar(spark, d)
    event = F.struct("name", F.when(F.col("id") % 7 > 0, F.date_format("date", "yyyy-MM-dd")).alias("date"), F.when(F.col("id") % 2 == 0, "Room 1").alias("location"), F.when(F.col("id") % 4 == 0, F.array(F.lit("ann"), F.lit(None), F.lit("bob"))).alias("attendees"), "project_id")
    found = P.model_results(t.select("id", F.to_json(F.struct(F.array(event).alias("events"))).alias("response")), "event")
    return found.select("id", "name", "date", "location", F.size("attendees").alias("attendees"), "project_id")


@query("extractor_registry", """SELECT 'attachments' AS extractor, 'event' AS data_type, count(*) AS n, round(avg(0.98), 4) AS confidence FROM documents UNION ALL SELECT 'attachments', 'contact', count(*), 0.97 FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'patterns', 'task', count(*), 0.9 FROM documents""")
def extractor_registry(spark, d):
    """All extractors over raw messages, with a task in every subject."""
    mails = V.raw_messages(spark, d).withColumn("subject", F.lit("task due by 1/2/2026")).withColumn("body_text", F.lit(None).cast("string"))
    found = extract(mails, "email_id", least=0.8)
    return found.groupBy("extractor", "data_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query("extractor_cascade", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE contains(text, '@'))")
def extractor_cascade(spark, d):
    own = V.emails(spark, d)
    cheap = own.select("id", F.when(F.contains("body_text", F.lit("@")), 0.9).otherwise(0.5).alias("confidence"))
    return P.needs_model(own, cheap, "id").select("id")


# guarded SQL and event windows

@query("sql_guarded", "SELECT category, n, total FROM (SELECT o_orderpriority AS category, count(*) AS n, CAST(sum(" + PRICE + ") AS DOUBLE) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY ALL) ORDER BY category LIMIT 100")
def sql_guarded(spark, d):
    statement = "SELECT category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM finance_transactions WHERE amount > :least GROUP BY category ORDER BY category"
    V.register(spark, d, statement)
    return guarded(spark, statement, 100, {"least": 1000}, tuple(V.VIEWS))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    t = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return Y.windowed(t).withColumn("start", F.col("start").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
