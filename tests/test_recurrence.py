"""Recurring events against an independent rule engine, and zones."""

import random
from datetime import datetime, timedelta

import pytest

from satchel.operators import recurrence as R

LOW, HIGH = datetime(2026, 1, 1), datetime(2027, 3, 1)


def file(rule, start="20250115T093000", zone="", extra="", blocks=""):
    tz = f";TZID={zone}" if zone else ""
    return f"BEGIN:VCALENDAR\r\n{blocks}BEGIN:VEVENT\r\nSUMMARY:x\r\nDTSTART{tz}:{start}\r\n{f'RRULE:{rule}' if rule else 'UID:1'}\r\n{extra}END:VEVENT\r\nEND:VCALENDAR"


def found(text, low=LOW, high=HIGH):
    return [at for _, _, at, error in R.occurrences(text, low, high) if error is None]


def test_rules_equal_another_engine():
    rrule = pytest.importorskip("dateutil.rrule")
    r = random.Random(2)
    checked = 0
    for _ in range(400):
        parts = [f"FREQ={(f := r.choice(R.FREQUENCIES))}", f"INTERVAL={r.choice((1, 1, 2, 3, 5))}"]
        parts += r.choice(([], [f"COUNT={r.randint(1, 30)}"], ["UNTIL=20261011T000000"]))
        if f in ("DAILY", "WEEKLY"):
            parts += r.choice(([], ["BYDAY=MO,WE,SU"], ["BYDAY=FR"]))
        else:
            parts += r.choice(([], ["BYDAY=2MO,-1FR"], ["BYMONTHDAY=1,15,-1"], ["BYDAY=TU"], ["BYMONTHDAY=31"]))
        if r.random() < 0.3 and not any("BYDAY=2" in p for p in parts):
            parts.append("BYMONTH=1,3,10")
        start = datetime(2025, 1, 1, 9, 30) + timedelta(days=r.randrange(500))
        text = ";".join(parts)
        rule = rrule.rrulestr(text, dtstart=start)
        if start not in rule[:1]:
            continue  # engines count a start that the rule does not name in different ways
        assert found(file(text, start.strftime("%Y%m%dT%H%M%S"))) == [d for d in rule.between(LOW, HIGH, inc=True) if d < HIGH], (text, start)
        checked += 1
    assert checked > 60


def test_endless_rules_start_at_the_window():
    text = file("FREQ=DAILY", "19000101T080000")
    assert found(text, datetime(2026, 5, 1), datetime(2026, 5, 3)) == [datetime(2026, 5, 1, 8), datetime(2026, 5, 2, 8)]
    assert found(file("FREQ=YEARLY", "19040229T080000"), datetime(2026, 1, 1), datetime(2033, 1, 1)) == [datetime(2028, 2, 29, 8), datetime(2032, 2, 29, 8)]


def test_exceptions_and_single_events():
    extra = "EXDATE:20260102T093000,20260104T093000\r\nEXDATE;VALUE=DATE:20260105\r\n"
    assert found(file("FREQ=DAILY;COUNT=6", "20260101T093000", extra=extra)) == [datetime(2026, 1, d, 9, 30) for d in (1, 3, 6)]
    assert found(file("", "20260101T093000Z")) == [datetime(2026, 1, 1, 9, 30)] and found(file("", "20250101")) == []


BLOCK = "BEGIN:VTIMEZONE\r\nTZID:Own\r\nBEGIN:STANDARD\r\nDTSTART:19701025T030000\r\nTZOFFSETFROM:+0200\r\nTZOFFSETTO:+0100\r\nRRULE:FREQ=YEARLY;BYDAY=-1SU;BYMONTH=10\r\nEND:STANDARD\r\nBEGIN:DAYLIGHT\r\nDTSTART:19700329T020000\r\nTZOFFSETFROM:+0100\r\nTZOFFSETTO:+0200\r\nRRULE:FREQ=YEARLY;BYDAY=-1SU;BYMONTH=3\r\nEND:DAYLIGHT\r\nEND:VTIMEZONE\r\n"


def test_zone_blocks_and_names_agree():
    rule = "FREQ=WEEKLY;COUNT=60"
    named, own = found(file(rule, "20260105T090000", "Europe/Paris")), found(file(rule, "20260105T090000", "Own", blocks=BLOCK))
    assert named == own and {t.hour for t in own} == {7, 8} and datetime(2026, 7, 6, 7) in own and datetime(2026, 1, 5, 8) in own
    assert found(file(rule, "20260105T090000", "No/Such"))[0] == datetime(2026, 1, 5, 9)


def test_files_as_rows(spark):
    rows = [(1, file("FREQ=WEEKLY;BYDAY=MO,WE;COUNT=3", "20260105T090000"), "k"), (2, file("FREQ=SECONDLY"), "k"), (3, None, "k"), (4, "", "k"), (5, file("FREQ=DAILY", "not a time"), "k")]
    got = R.expanded(spark.createDataFrame(rows, "id long, content string, at_ string"), "2026-01-01T00:00:00", "2026-02-01T00:00:00").collect()
    assert [(r.id, r.at) for r in got if r.error is None] and sorted((r.id, r.at.day) for r in got if r.error is None) == [(1, 5), (1, 7), (1, 12)]
    assert sorted(r.id for r in got if r.error) == [2, 5] and got[0].at_ == "k"


def test_a_small_file_is_dealt_over_tasks_and_occurrences_leave_in_few_batches(spark, monkeypatch):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:x\r\nDTSTART:20240101T090000Z\r\nRRULE:FREQ=DAILY\r\nEND:VEVENT\r\nEND:VCALENDAR"
    files = spark.range(100, numPartitions=1).selectExpr("id", "'%s' as content" % text.replace("\r\n", "\\r\\n"))
    found = R.expanded(files, "2024-02-01T00:00:00", "2024-03-01T00:00:00")
    assert found.count() == 2900 and found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    monkeypatch.setattr(R, "AT_ONCE", 7)
    assert R.expanded(files, "2024-02-01T00:00:00", "2024-03-01T00:00:00").groupBy("id").count().where("count = 29").count() == 100
