import pytest
from pyspark.sql import functions as F

from satchel.functions import scalars as S
from satchel.operators import downloads as D
from satchel.operators import patterns as P


def test_first_match_of_each_pattern(spark):
    rows = spark.createDataFrame([(1, "The task is due by Jan 25, due 1/2/2026. Assigned to: @ann"), (2, "urgent"), (3, "Review on 2026-01-05"), (4, None), (5, "This task needs urgent attention and action"), (6, "For the Website Redesign project, we need..."), (7, "Please complete the task due by Jan 25"), (8, "finish by 2/3/2026: the action")], "id long, text string")
    got = sorted((r.id, r.pattern, r.entity, r.value) for r in P.matches(rows).collect())
    assert got == [(1, "assignee", "task", "ann"), (1, "due_date", "task", "Jan 25"), (3, "meeting", "event", "Review"), (5, "priority", "priority", "urgent"), (6, "named_project", "project", "Website Redesign"), (7, "due_date", "task", "Jan 25"), (8, "due_date", "task", "2/3/2026")]
    assert P.matches(rows, min_confidence=0.9).count() == 3 and P.matches(rows, max_results=1).count() == 6
    assert [r.id for r in P.matches(rows, only=("priority",)).collect()] == [5]


def test_keywords_beside_an_expression(spark):
    both = P.Pattern("both", "task", 0.7, r"(?i)ship (\w+)", keywords=("order",), near=("now",))
    rows = spark.createDataFrame([(1, "ship it, order now"), (2, "ship it now"), (3, "ship it, order"), (4, "ship one later" + " " * 80 + "order: ship two now")], "id long, text string")
    assert sorted((r.id, r.value) for r in P.matches(rows, patterns=(both,)).collect()) == [(1, "it"), (4, "two")]


def test_spans_merge_over_small_gaps(spark):
    rows = [(1, "A", 0, 5, 0.9), (1, "A", 7, 9, 0.7), (1, "A", 12, 14, 0.5), (1, "B", 8, 9, 0.1)]
    got = sorted(tuple(r) for r in P.merged_spans(spark.createDataFrame(rows, "id long, label string, start long, stop long, score double"), "id").collect())
    assert got == [(1, "A", 0, 9, 0.8, 2), (1, "A", 12, 14, 0.5, 1), (1, "B", 8, 9, 0.1, 1)]


def test_model_answers(spark):
    rows = [(1, '{"tasks":[{"title":"a","priority":"odd"},{"title":"b","priority":"high","confidence":0.9}]}'), (2, '{"tasks":[{"priority":"high"},{"title":"x"}]}'), (3, "broken"), (4, None)]
    got = sorted((r.id, r.title, r.priority, r.confidence, r.requires_review) for r in P.model_answers(spark.createDataFrame(rows, "id long, response string")).collect())
    assert got == [(1, "a", None, 0.7, True), (1, "b", "high", 0.9, False)]


def test_scalars(spark):
    row = spark.range(1).select(
        S.masked(F.lit("abcdef")).alias("short"), S.masked(F.lit("abcdefgh")).alias("long"), F.length(S.masked(F.lit("x" * 60))).alias("n"),
        S.addresses(F.lit('[{"email":"a@x"},{"name":"b"}]')).alias("to"), S.addresses(F.lit("bad")).alias("none"), S.decoded(F.lit("OneDrive"), "source_type", "imap").alias("drive"),
        S.percent(F.lit(1), F.lit(3)).alias("third"), S.percent(F.lit(1), F.lit(0)).alias("zero"), S.remaining(F.lit(3), F.lit(5)).alias("left"),
    ).first()
    assert (row.short, row.long, row.n, len(row.to), row.none, row.drive, row.zero, row.left) == ("abcdef", "abcdef**", 40, 1, [], "one-drive", 0.0, 0)
    assert abs(row.third - 33.333336) < 1e-6


def test_latest_state_keeps_nulls(spark):
    log = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", None)], "id long, step int, state string, error string")
    assert tuple(D.latest(log).first()) == (1, 1, "b", None)


def test_model_answers_of_all_kinds(spark):
    rows = [(1, '{"projects": [{"name": "A", "status": "active"}, {"name": "B", "status": "odd", "confidence": 0.9}]}'), (2, '{"projects": [{"name": "C"}, {"status": "active"}]}'), (3, "no json"), (4, None), (5, '{"events": [{"name": "E", "date": "2026-01-01", "attendees": ["x", null]}]}'), (6, '{"events": [{"name": "E"}]}')]
    answers = spark.createDataFrame(rows, "id long, response string")
    got = sorted((r.id, r.name, r.status, r.confidence, r.requires_review) for r in P.model_results(answers, "project").collect())
    assert got == [(1, "A", "active", 0.7, True), (1, "B", None, 0.9, False)]
    (event,) = P.model_results(answers, "event").collect()
    assert (event.id, event.date, event.attendees, event.location) == (5, "2026-01-01", ["x"], None)
    assert P.model_results(answers, "task").count() == 0


def test_registry_asks_dearer_extractors_only_where_needed(spark):
    from satchel.operators import extractors

    rows = [(1, "task due by 1/2/2026", "x", bytearray(b"BEGIN")), (2, "task due by 3/4/2026", None, bytearray(b"Content-Type: text/vcard\nContent-Disposition: attachment; filename=a.vcf\n\nBEGIN:VCARD\nFN:Ann\nEND:VCARD"))]
    messages = spark.createDataFrame(rows, "id long, subject string, body_text string, raw binary")
    every = {(r.id, r.extractor, r.data_type) for r in extractors.extract(messages, "id").collect()}
    assert every == {(1, "patterns", "task"), (2, "patterns", "task"), (2, "attachments", "contact")}
    some = {(r.id, r.extractor) for r in extractors.extract(messages, "id", enough=0.9).collect()}
    assert some == {(1, "patterns"), (2, "attachments")}
    with pytest.raises(ValueError):
        extractors.extract(messages, "id", ("nobody",))
