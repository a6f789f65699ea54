"""Attachments out of raw messages."""

import hashlib
from email.message import EmailMessage

import pyarrow as pa
from pyspark.sql.types import LongType, StructField
from satchel.operators import mime


def message(files, text="body", inner=None):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Meeting and Contact", "a@example.com", "b@example.com"
    m.set_content(text)
    m.add_alternative("<p>page</p>", subtype="html")
    for name, kind, content in files:
        main, sub = kind.split("/")
        m.add_attachment(content, maintype=main, subtype=sub, filename=name)
    if inner is not None:
        m.add_attachment(inner)
    return m


ICS = b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART:20260125T140000Z\r\nSUMMARY:Team Meeting\r\nEND:VEVENT\r\nEND:VCALENDAR"
VCF = b"BEGIN:VCARD\nVERSION:3.0\nFN:Jane Doe\nEMAIL:jane@example.com\nEND:VCARD"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if raw is None else bytearray(raw), "clash") for i, raw in rows], "email_id long, raw binary, part string")


def test_tree_of_parts(spark):
    inner = message([("deep.vcf", "text/vcard", VCF)])
    rows = [(1, message([("meeting.ics", "text/calendar", ICS), ("b.bin", "application/octet-stream", b"\x00\xff")], inner=inner).as_bytes()), (2, b"plain text, no headers"), (3, None), (4, b""), (5, b"Content-Type: multipart/mixed; boundary=x\n\nno parts at all")]
    found = {(r.email_id, r.part): r for r in mime.parts(frame(spark, rows)).collect()}
    assert [p for e, p in sorted(found) if e == 1] == ["1.1", "1.2", "2", "3", "4.1.1", "4.1.2", "4.2"]
    ics = found[1, "2"]
    assert (ics.filename, ics.content_type, bytes(ics.content), ics.is_attachment, ics.is_inline) == ("meeting.ics", "text/calendar", ICS, True, False)
    assert ics.checksum == hashlib.sha256(ICS).hexdigest() and ics.size_bytes == len(ICS)
    assert bytes(found[1, "3"].content) == b"\x00\xff" and bytes(found[1, "4.2"].content) == VCF
    assert not found[1, "1.1"].is_attachment and not found[2, "1"].is_attachment
    assert found[3, "1"].size_bytes == 0 == found[4, "1"].size_bytes and sum(e == 5 for e, _ in found) == 1
    assert all(r.error is None for r in found.values())


def test_entities_and_statuses(spark):
    bad = ICS.replace(b"SUMMARY:Team Meeting\r\n", b"")
    rows = [(1, message([("meeting.ics", "text/calendar", ICS), ("contact.vcf", "text/vcard", VCF), ("x.bin", "application/pdf", b"x")]).as_bytes()), (2, message([("bad.ics", "text/calendar", bad)]).as_bytes())]
    found = mime.parts(frame(spark, rows))
    got = sorted((r.email_id, r.part, r.data_type, (r.event or r.contact).name) for r in mime.entities(found, ("email_id",)).collect())
    assert got == [(1, "2", "event", "Team Meeting"), (1, "3", "contact", "Jane Doe")]
    status = {(r.email_id, r.part): r.extraction_status for r in mime.statuses(found, ("email_id",)).collect()}
    assert status == {(1, "2"): "completed", (1, "3"): "completed", (1, "4"): "skipped", (2, "2"): "failed"}


def test_contents_are_stored_once(spark, tmp_path):
    logo = ("logo.png", "image/png", b"logo")
    store = mime.AttachmentStore(spark, str(tmp_path))
    assert store.attachments().count() == 0 == store.contents().count()
    first = frame(spark, [(i, message([logo, (f"{i}.txt", "text/plain", str(i % 2).encode())]).as_bytes()) for i in range(6)])
    second = frame(spark, [(i, message([logo, ("n.txt", "text/plain", b"new")]).as_bytes()) for i in range(6, 9)])
    store.add(first, 0)
    for _ in range(2):  # a batch that runs again replaces itself
        store.add(second, 1)
    assert sorted(bytes(r.content) for r in store.contents().collect()) == [b"0", b"1", b"logo", b"new"]
    held = {r.checksum: r.references for r in mime.references(store.attachments()).collect()}
    assert sorted(held.values()) == [3, 3, 3, 9] and held[hashlib.sha256(b"logo").hexdigest()] == 9
    assert store.unreferenced().count() == 0
    store.add(first, 1)  # the second batch is replaced by other messages: its content goes with it
    assert store.contents().count() == 3


def test_copies_fall_together_before_the_shuffle(spark):
    plan = mime.contents(mime.parts(frame(spark, [(1, b"x")])))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_first") > plan.index("Exchange")  # below it in the tree


def test_deep_trees_end(spark):
    raw = b"Content-Type: message/rfc822\n\n" * 60 + b"text"
    (row,) = mime.parts(frame(spark, [(1, raw)])).collect()
    assert row.size_bytes > 0 and row.error is None


def test_parts_of_many_messages_leave_together(spark, monkeypatch):
    raw = b"Content-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Disposition: attachment; filename=a\r\n\r\nabc\r\n--x\r\n\r\nd\r\n--x--\r\n"
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([raw] * 50)], names=["email_id", "raw"])

    class Messages:
        schema = {"email_id": StructField("email_id", LongType())}

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    (out,) = mime.parts(Messages())
    assert out.num_rows == 100 and out.column("email_id").to_pylist() == [i // 2 for i in range(100)]
    monkeypatch.setattr(mime, "AT_ONCE", 8)
    small = mime.parts(Messages())
    assert len(small) == 25 and pa.Table.from_batches(small) == pa.Table.from_batches([out])
