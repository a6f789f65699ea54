import json
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from satchel.operators.mime import AttachmentStore
from satchel.sources import files, mailbox
from satchel.sources.mailbox import Mailbox, parsed
from satchel.sources.store import Store
from satchel.streaming import sync


def write_mail(root, folder, uid, subject="Hi", raw=None):
    (root / folder).mkdir(parents=True, exist_ok=True)
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"], m["Message-ID"] = "Ann <ann@example.com>", "bob@example.com, Eve <eve@example.com>", subject, "Mon, 05 Jan 2026 10:00:00 +0000", f"<{uid}@x>"
    m["In-Reply-To"], m["References"] = "<0@x>", "<a@x> <0@x>"
    m.set_content("text body")
    m.add_alternative("<p>page</p>", subtype="html")
    m.add_attachment(b"x", maintype="text", subtype="calendar", filename="a.ics")
    (root / folder / f"{uid}.eml").write_bytes(raw if raw is not None else m.as_bytes())


def test_batch_read_and_parse(spark, tmp_path):
    write_mail(tmp_path, "INBOX", 1)
    write_mail(tmp_path, "Sent", 5, "Other")
    write_mail(tmp_path, "INBOX", 2, raw=b"\xff\xfe broken")
    spark.dataSource.register(Mailbox)
    rows = {(r.folder, r.uid): r for r in parsed(spark.read.format("mailbox").option("path", str(tmp_path)).load()).collect()}
    row = rows["INBOX", 1]
    assert (row.subject, row.from_address, row.from_name, row.attachment_count) == ("Hi", "ann@example.com", "Ann", 1)
    assert [a.email for a in row.to_addresses] == ["bob@example.com", "eve@example.com"]
    assert (row.in_reply_to, row.references) == ("<0@x>", ["<a@x>", "<0@x>"])
    assert row.date_sent == 1767607200000 and row.body_text.strip() == "text body" and "page" in row.body_html
    assert rows["INBOX", 2].from_address == "" and ("Sent", 5) in rows
    newer = spark.read.format("mailbox").option("path", str(tmp_path)).option("since_uid", 1).load()
    assert sorted((r.folder, r.uid) for r in newer.collect()) == [("INBOX", 2), ("Sent", 5)]


def test_sync_resumes_without_repeats(spark, tmp_path):
    box, target, checkpoint = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "check")
    for uid in range(1, 8):
        write_mail(box, "INBOX", uid)
    sync.sync_all(spark, str(box), target, checkpoint, batch=3)
    assert sorted(r.uid for r in spark.read.parquet(f"{target}/emails").collect()) == list(range(1, 8))
    for uid in range(8, 10):
        write_mail(box, "INBOX", uid)
    sync.sync_all(spark, str(box), target, checkpoint, batch=3)
    found = spark.read.parquet(f"{target}/emails")
    assert found.count() == 9 == found.select("folder", "uid").distinct().count()
    assert spark.read.parquet(f"{target}/download_items").where("status = 'completed'").count() == 9


def test_mail_server(spark):
    spark.dataSource.register(Mailbox)
    load = lambda **o: spark.read.format("mailbox").options(client="tests.fake_mail:Fake", host="x", user="u", password="p", **o).load()
    rows = parsed(load()).orderBy("uid").collect()
    assert [(r.folder, r.uid, r.subject, r.is_read, r.internal_date) for r in rows] == [("INBOX", 3, "one", True, 1767607200000), ("INBOX", 9, "two", False, 1767607200000)]
    assert load(since_uid=3).select("uid").collect()[0].uid == 9 and load(since_uid=9).count() == 0
    assert load(batch=1).rdd.getNumPartitions() == 2


def test_filters_become_the_search_of_the_server(spark, tmp_path):
    def asked(where, name, **options):
        log = tmp_path / name
        found = mailbox.searched(spark, client="tests.fake_mail:Fake", host="x", user="u", token="t", log=str(log), **options).where(where)
        return sorted(r.uid for r in found.select("uid").collect()), log.read_text().splitlines() if log.exists() else []

    uids, log = asked("folder = 'INBOX' and uid > 3 and internal_date >= 1767607200000", "a")
    assert uids == [9] and "SEARCH SINCE 04-Jan-2026 UID 4:*" in log and 'SELECT "Old"' not in log and [x for x in log if x.startswith("FETCH")] == ["FETCH 9 (UID FLAGS INTERNALDATE BODY.PEEK[])"]
    uids, log = asked("folder in ('INBOX', 'Old') and uid between 2 and 5", "b")
    assert uids == [3] and "SEARCH UID 2:5" in log and 'SELECT "Old"' in log
    uids, log = asked("uid = 9", "c")
    assert uids == [9] and "SEARCH UID 9:9" in log
    uids, log = asked("uid > 9 and uid < 10", "d")
    assert uids == [] and log == []
    uids, log = asked("internal_date > 1767607200000", "e")  # the server's day fits, the millisecond does not
    assert uids == [] and "SEARCH SINCE 04-Jan-2026" in log
    uids, log = asked("uid % 2 = 1", "f", limit="1")
    assert uids == [3] and log.count("FETCH 3 (UID FLAGS INTERNALDATE BODY.PEEK[])") == 1 and "SEARCH UID 1:*" in log
    uids, log = asked("folder = 'Nowhere'", "g")
    assert uids == [] and log == []


def test_messages_of_a_slice_come_in_one_request(spark, tmp_path):
    log = tmp_path / "log"
    spark.dataSource.register(Mailbox)
    rows = spark.read.format("mailbox").options(client="tests.fake_mail:Fake", host="x", user="u", password="p", log=str(log)).load().collect()
    assert sorted((r.uid, r.flags) for r in rows) == [(3, ["\\Seen"]), (9, [])]
    assert [x for x in log.read_text().splitlines() if x.startswith("FETCH")] == ["FETCH 3,9 (UID FLAGS INTERNALDATE BODY.PEEK[])"]


def test_archive_is_a_mailbox(spark, tmp_path):
    rows = [(f, u, bytearray(f"{f}{u}".encode()), u * 1000) for f in ("a b", "c/d") for u in range(1, 8)]
    mailbox.archive(spark.createDataFrame(rows, "folder string, uid long, raw binary, internal_date long"), str(tmp_path / "box"))
    found = mailbox.searched(spark, archive=str(tmp_path / "box"), batch="3")
    assert sorted((r.folder, r.uid, bytes(r.raw), r.internal_date) for r in found.collect()) == sorted((f, u, bytes(x), t) for f, u, x, t in rows)
    some = found.where("folder = 'c/d' and uid <= 6 and internal_date >= 3000")
    assert [r.uid for r in some.orderBy("uid").collect()] == [3, 4, 5, 6] and some.rdd.getNumPartitions() == 2
    assert mailbox.searched(spark, archive=str(tmp_path / "box"), limit="2").count() == 4


def test_stream_lists_behind_its_offset_and_takes_a_bounded_batch(tmp_path):
    for uid in range(1, 8):
        write_mail(tmp_path, "INBOX", uid)
    asked = []

    class Watched(mailbox.Files):
        def uids(self, folder, bounds):
            asked.append((bounds.after, bounds.upto))
            return super().uids(folder, bounds)

    stream = mailbox.MailStream({"path": str(tmp_path), "admit": "3", "batch": "2"})
    plain, mailbox.client = mailbox.client, lambda options: Watched(options)
    try:
        start = stream.initialOffset()
        end = stream.latestOffset()
        assert (start, end) == ({}, {"INBOX": 3}) and [s.uids for s in stream.partitions(start, end)] == [[1, 2], [3]]
        assert stream.latestOffset() == {"INBOX": 6} and asked == [(0, None), (0, 3), (3, None)]
        again = mailbox.MailStream({"path": str(tmp_path), "admit": "3", "resume": '{"INBOX": 6}'})
        assert again.latestOffset() == {"INBOX": 7} and asked[-1] == (6, None)
        unknown = mailbox.MailStream({"path": str(tmp_path), "admit": "3"})
        assert unknown.latestOffset() == {"INBOX": 7}  # never behind what may have been committed
        assert again.partitions({"INBOX": 7}, {"INBOX": 7}) == []
    finally:
        mailbox.client = plain


def test_sync_takes_bounded_batches_and_attachments(spark, tmp_path):
    box, target, checkpoint = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "check")
    for uid in range(1, 6):
        write_mail(box, "INBOX", uid)
    assert sync.sync_all(spark, str(box), target, checkpoint, admit=2) == 4
    assert json.loads(sync.last_offset(spark, checkpoint)) == {"INBOX": 5} and sync.last_offset(spark, str(tmp_path / "none")) is None
    store = AttachmentStore(spark, target)
    assert spark.read.parquet(f"{target}/emails").count() == 5 == store.attachments().count()
    assert [bytes(r.content) for r in store.contents().collect()] == [b"x"]


def test_a_failed_version_does_not_count(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_all()
    store.append("download_jobs", spark.createDataFrame([(1,), (2,)], "id long"))
    (tmp_path / "download_jobs" / "v1").mkdir()
    (tmp_path / "download_jobs" / "v1" / "part-0.parquet").write_bytes(b"half")
    assert store.read("download_jobs").count() == 2
    store.delete("download_jobs", spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in store.read("download_jobs").collect()] == [2]


def test_ids_are_dense_and_claimed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_all()
    rows = spark.range(1000).selectExpr("id as credential_id", "'imap' as source_type").repartition(7)
    store.append("download_jobs", rows, number=True)
    store.append("download_jobs", rows.limit(3), number=True)
    found = sorted((r.id, r.credential_id) for r in store.read("download_jobs").collect())
    assert [i for i, _ in found] == list(range(1, 1004)) and [c for _, c in found[:1000]] == list(range(1000))
    assert store._claim("download_jobs", 5) == 1004 and store._claim("download_jobs", 5) == 1009


def test_running_jobs_are_pruned():
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    running = sync.Running()
    query = running.start(1, Query)
    with pytest.raises(RuntimeError):
        running.start(1, Query)
    query.isActive = False
    assert not running.active(1)
    running.start(1, Query)
    running.pause(1)
    assert not running.active(1)


def test_store_states_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_all()
    store.create_all()
    jobs = spark.createDataFrame([("imap", 1, "pending", 10, 10), ("imap", 2, "pending", 11, 11)], "source_type string, credential_id long, status string, created_at long, updated_at long")
    store.append("download_jobs", jobs, number=True)
    assert sorted(r.id for r in store.read("download_jobs").collect()) == [1, 2]
    store.transition("download_jobs", 1, status="failed", error_message="no route", updated_at=20)
    store.transition("download_jobs", 1, status="running", error_message=None, updated_at=30)
    row = store.latest("download_jobs").where("id = 1").first()
    assert (row.status, row.error_message, row.credential_id) == ("running", None, 1)
    store.append("download_items", spark.createDataFrame([(1, 1), (2, 2)], "id long, job_id long"))
    store.delete_job(1)
    assert [r.id for r in store.latest("download_jobs").collect()] == [2]
    assert [r.job_id for r in store.read("download_items").collect()] == [2]
    store.append("agent_sessions", spark.createDataFrame([(1,), (2,)], "id long"))
    store.append("agent_messages", spark.createDataFrame([(1, 1), (2, 2)], "id long, session_id long"))
    store.delete_session(1)
    assert [r.id for r in store.read("agent_sessions").collect()] == [2] == [r.id for r in store.read("agent_messages").collect()]


def test_csv_round_trip_and_filters(spark, tmp_path):
    (tmp_path / "in.csv").write_text("nr,account,amount\n1,7,12.50\nx,8,bad\n")
    rows = files.import_csv(spark, str(tmp_path / "in.csv"), "finance_transactions", {"nr": "id", "account": "account_id"})
    got = sorted(((r.id, r.account_id, r.amount and float(r.amount)) for r in rows.collect()), key=str)
    assert got == [(1, 7, 12.5), (None, 8, None)]
    for kind in ("csv", "json", "parquet"):
        files.export(rows, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == (2 if kind != "csv" else 3)
    names = spark.createDataFrame([("a.PDF", 10), ("b.txt", 10), ("c.pdf", 99)], "n string, s long")
    assert [r.n for r in names.where(files.wanted(F.col("n"), F.col("s"), ("pdf",), None, 1, 50)).collect()] == ["a.PDF"]
    assert files.listed(spark, str(tmp_path), "*.csv").select("path").count() >= 1
    assert '"name":"subject"' in files.exported_schemas()["emails"]
