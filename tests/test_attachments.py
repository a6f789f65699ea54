from satchel.operators import attachments as A

SCHEMA = "id long, filename string, content_type string, content string"
EVENT = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART:20260125T140000Z\r\nDTEND:20260125T150000Z\r\nSUMMARY:Plan\r\n ning\r\nDESCRIPTION:Long\r\nLOCATION:Room 2\r\nATTENDEE:mailto:a@example.com\r\nATTENDEE;CN=\"x:y\":mailto:b@example.com\r\nATTENDEE:MAILTO:c@example.com\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
CARD = "BEGIN:VCARD\nVERSION:3.0\nFN:Ann Lee\nEMAIL;TYPE=work:ann@example.com\nTEL;TYPE=cell:+100\nORG:Acme\nEND:VCARD\n"


def files(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def test_event(spark):
    row = A.calendar_events(files(spark, ("a.ics", "", EVENT))).first()
    assert (row.name, row.location, row.attendees, row.valid) == ("Planning", "Room 2", ["a@example.com", "b@example.com"], True)
    assert str(row.start) == "2026-01-25 14:00:00"


def test_dates(spark):
    from pyspark.sql import functions as F

    values = ["20260125T140000Z", "20260125T140000", "2026-01-25T14:00:00", "20260125", "20260125Z", "x", None]
    got = [r.d and str(r.d) for r in spark.createDataFrame([(v,) for v in values], "v string").select(A.ics_time(F.col("v")).alias("d")).collect()]
    assert got == ["2026-01-25 14:00:00"] * 3 + [None] * 4


def test_a_broken_event_voids_its_file_only(spark):
    broken = EVENT.replace("END:VCALENDAR", "BEGIN:VEVENT\r\nDTSTART:20260125T140000\r\nEND:VEVENT\r\nEND:VCALENDAR")
    rows = A.calendar_events(files(spark, ("a.ics", "", broken), ("b.ics", "", EVENT)))
    assert [r.id for r in A.valid_files(rows).collect()] == [1]
    assert [(r.id, r.broken) for r in A.rejects(rows, "id").collect()] == [(0, 1)]


def test_two_cards_in_order_and_last_line_wins(spark):
    second = CARD.replace("Ann Lee", "Bob").replace("ORG:Acme", "EMAIL:last@example.com\nORG:Acme").replace("END:VCARD\n", "")
    rows = A.contacts(files(spark, ("a.vcf", "", "noise" + CARD + second))).orderBy("position").collect()
    assert [(r.name, r.email, r.phone, r.organization) for r in rows] == [("Ann Lee", "ann@example.com", "+100", "Acme"), ("Bob", "last@example.com", "+100", "Acme")]


def test_card_edges(spark):
    uri = CARD.replace("TEL;TYPE=cell:+100", "TEL;VALUE=uri:tel:+1").replace("EMAIL;TYPE=work:ann@example.com", "EMAIL")
    row = A.contacts(files(spark, ("a.vcf", "", uri))).first()
    assert (row.phone, row.email) == ("tel", None)
    assert A.contacts(files(spark, ("a.vcf", "", "no card"), ("b.vcf", "", ""))).count() == 0
    assert not A.contacts(files(spark, ("a.vcf", "", CARD.replace("FN:", "FN;CHARSET=UTF-8:")))).first().valid


def test_router(spark):
    found = A.extracted(files(spark, ("a.ics", "x", EVENT), ("b", "Text/VCARD; x", CARD), ("C.ICS", "application/x", EVENT), ("d.vcf", "text/calendar", EVENT)), "id")
    rows = {r.id: r for r in found.collect()}
    assert {i: r.data_type for i, r in rows.items()} == {0: "event", 1: "contact", 3: "event"}
    assert all(r.confidence > 0.9 and not r.requires_review for r in rows.values())
    assert rows[0].event.date == "2026-01-25T14:00:00+00:00" and rows[1].contact.name == "Ann Lee"
    assert A.extracted(files(spark), "id").count() == 0


def test_files_are_parsed_once(spark, sf_dir):
    """A condition on what was parsed stays above: the plan holds one extraction, not one for each time it is named."""
    from satchel import queries as Q

    for name, extractions in (("ics_parse", 1), ("pattern_due_date", 2), ("pattern_meeting", 1)):
        plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == extractions and plan.count("concat_ws") == 1, name
