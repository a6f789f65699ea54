import pytest
from pyspark.sql import functions as F

from satchel.functions import table_functions
from satchel.operators import mail, patterns
from satchel.sources import records
from satchel.sources.store import Store
from tests.test_attachments import CARD, EVENT


def test_sessions_jobs_and_credentials(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_all()
    session = records.create_session(store, "analyst", "why?", 100)
    records.create_message(store, session, "user", "hi", 101)
    call = records.create_tool_call(store, session, "sql", "{}", 102)
    records.end_tool_call(store, call, 103, 5, response="[]")
    records.end_session(store, session, 110, error="lost")
    row = store.latest("agent_sessions").first()
    assert (row.status, row.error, row.config, row.ended_at) == ("failed", "lost", "null", 110)
    assert store.latest("agent_tool_calls").first().status == "completed"
    job = records.create_job(store, "imap", 1, "{}", 1000)
    records.set_job_status(store, job, "failed", 1001, "no route")
    records.set_job_status(store, job, "running", 1002)
    records.set_source_state(store, job, '{"uid":5}', 1003)
    row = store.latest("download_jobs").first()
    assert (row.status, row.error_message, row.source_state) == ("running", None, '{"uid":5}')
    one = records.add_credential(store, "imap", "a", "ann", 1)
    with pytest.raises(ValueError):
        records.add_credential(store, "imap", "a", "eve", 2)
    records.remove_credential(store, one, 3)
    assert store.latest("credentials_metadata").first().is_active is False
    records.remove_credential(store, one, 4, hard=True)
    assert store.latest("credentials_metadata").isEmpty() and records.healthy(store)


def test_domain_tables_grow(spark):
    table = records.extended(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2, "x")], "id long, note string"))
    assert sorted((r.id, r.note) for r in table.collect()) == [(1, None), (2, "x")]


def test_threads(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [("a", None), *[(f"r{i}", "a" if i == 0 else f"r{i - 1}") for i in range(20)], ("b", "gone"), ("c", "b"), ("x", "y"), ("y", "x")]
    got = {r.message_id: r.thread for r in mail.threads(spark.createDataFrame(rows, "message_id string, in_reply_to string")).collect()}
    assert got == {"a": "a", **{f"r{i}": "a" for i in range(20)}, "b": "b", "c": "b", "x": "x", "y": "x"}


def test_table_functions(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, EVENT, CARD), (2, None, "BEGIN:VCARD\nORG:x")], "id long, ics string, vcf string").createOrReplaceTempView("attached")
    assert [tuple(r) for r in spark.sql("SELECT id, t.name, t.start FROM attached, LATERAL parse_ics(ics) t").collect()] == [(1, "Planning", "20260125T140000Z")]
    assert [tuple(r) for r in spark.sql("SELECT id, t.* FROM attached, LATERAL parse_vcf(vcf) t").collect()] == [(1, "Ann Lee", "ann@example.com", "+100", "Acme")]


def test_recognised_spans(spark):
    tokens = spark.createDataFrame([(1, 0, 4, {"task": 0.9, "project": 0.6}), (1, 5, 9, {"task": 0.7, "project": 0.2})], "id long, start long, stop long, scores map<string,double>")
    spans = patterns.scored_spans(tokens)
    assert spans.count() == 3
    got = sorted((r.start, r.label, r.requires_review) for r in patterns.recognised(spans, {"task": 0.6, "project": 0.65}).collect())
    assert got == [(0, "task", False), (5, "task", True)]


def test_credential_update_and_message_delete(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_all()
    a, b = (records.add_credential(store, "imap", n, n, 1) for n in ("a", "b"))
    records.update_credential(store, a, 5, username="new", is_active=False)
    row = store.latest("credentials_metadata").where(F.col("id") == a).first()
    assert (row.username, row.is_active, row.identifier, row.updated_at) == ("new", False, "a", 5)
    for changes in ({"identifier": "b"}, {"credential_type": "oauth"}):
        with pytest.raises(ValueError):
            records.update_credential(store, a, 6, **changes)
    with pytest.raises(ValueError):
        records.update_credential(store, 99, 6, notes="x")
    session = records.create_session(store, "agent", "hi", 1)
    m, n = (records.create_message(store, session, "assistant", x, 2) for x in "mn")
    calls = spark.createDataFrame([(1, session, m), (2, session, n), (3, session, None)], "id long, session_id long, message_id long")
    store.append("agent_tool_calls", calls)
    records.delete_message(store, m)
    assert {r.id: r.message_id for r in store.read("agent_tool_calls").collect()} == {1: None, 2: n, 3: None}
    assert [r.id for r in store.read("agent_messages").collect()] == [n]
