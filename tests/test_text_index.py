"""Substring search by an index against a scan."""

import random

from satchel.operators import mail
from satchel.sources import text_index
from satchel.sources.text_index import TextIndex

SCHEMA = "id long, body_text string, date_received long"


def test_search_equals_scan(spark, tmp_path):
    r = random.Random(1)
    words = ["Alpha", "beta", "Ünder", "the", "x", "日本語", "ab", "alphabet"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12))), i) for i in range(120)] + [(200, None, 1), (201, "", 2), (202, "ab", 3)]
    texts = spark.createDataFrame(rows, SCHEMA)
    index = TextIndex(spark, str(tmp_path), buckets=8)
    index.add(texts.where("id < 60"), "a")
    for _ in range(2):  # a segment that is added again replaces itself
        index.add(texts.where("id >= 60"), "b")
    for phrase in ("ALPHA", "alphab", "a", "ta ün", "the the", "nowhere", "日本語", "e alp", "ab", "x x x"):
        got, want = (sorted(map(tuple, f.collect())) for f in (index.search(texts, phrase, 500), mail.search(texts, phrase, 500)))
        assert got == want, phrase
    assert [x.id for x in index.search(texts, "beta", 3, 2).collect()] == [x.id for x in mail.search(texts, "beta", 3, 2).collect()]
    gone = texts.where("id % 2 = 0")  # deleted texts are not found, whatever the index says
    assert sorted(x.id for x in index.search(gone, "beta", 500).collect()) == sorted(x.id for x in mail.search(gone, "beta", 500).collect())


def test_a_search_opens_its_own_buckets(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), buckets=8)
    index.add(spark.createDataFrame([(i, f"word{i} other", i) for i in range(50)], SCHEMA), "a")
    assert index.rarest("word7")[0] == "rd7" and "wor" not in index.rarest("word17 other")[:2]
    plan = index.candidates("word7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(piece" in plan


def test_texts_of_one_small_file_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    seen, write = [], text_index.spread
    monkeypatch.setattr(text_index, "spread", lambda rows: seen.append(write(rows)) or seen[-1])
    monkeypatch.setattr(text_index, "AT_ONCE", 5)
    texts = spark.range(60, numPartitions=1).selectExpr("id", "concat('a text of number ', id) as body_text", "id as date_received")
    index = text_index.TextIndex(spark, str(tmp_path))
    index.add(texts, "a")
    assert seen[0].rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert index.search(texts, "number 7").first().total == 1 and index.search(texts, "TEXT OF").first().total == 60
