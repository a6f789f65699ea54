"""Uniqueness over batches."""

import random

from satchel.sources.keys import KeyIndex
from satchel.sources.mailbox import Mailbox
from satchel.streaming import sync
from tests.test_sources import write_mail

SCHEMA = "account string, folder string, uid long, size long"


def test_batches_give_each_key_once(spark, tmp_path):
    r = random.Random(1)
    key, seen = ("account", "folder", "uid"), set()
    for bits in (1 << 30, 64):  # room for all, and a full bitmap
        index, seen = KeyIndex(spark, str(tmp_path / str(bits)), key, bits), set()
        for batch in range(3):
            rows = [(r.choice(("a", None)), r.choice("xy"), r.choice((None, r.randrange(40))), r.randrange(100)) for _ in range(60)]
            frame = spark.createDataFrame(rows, SCHEMA)
            for _ in range(1 + (batch == 1)):  # the second one runs again, as after a failure
                new = {(x.account, x.folder, x.uid): x.size for x in index.add(frame, f"b{batch}").collect()}
            want = {}
            for *k, size in rows:
                if tuple(k) not in seen:
                    want[tuple(k)] = min(size, want.get(tuple(k), size))
            assert new == want
            seen |= set(want)
    assert index.seen("", frame).count() == len(seen)


def test_new_keys_meet_no_history(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), ("uid",))
    index.add(spark.range(1000).withColumnRenamed("id", "uid"), "a")
    maybe, sure = index.suspects(spark.range(500, 3000).withColumnRenamed("id", "uid"))
    assert maybe.where("uid < 1000").count() == 500 and maybe.count() < 510 and sure.count() > 1990
    again, _ = index.suspects(spark.range(10).withColumnRenamed("id", "uid"), "a")
    assert again.count() == 0  # a batch does not suspect itself


def test_overlapping_jobs_insert_once(spark, tmp_path):
    box, target = tmp_path / "box", str(tmp_path / "out")
    for uid in range(1, 5):
        write_mail(box, "INBOX", uid)
    for job in ("first", "second"):
        sync.sync_all(spark, str(box), target, str(tmp_path / job), job=job)
    write_mail(box, "INBOX", 9)
    sync.sync_all(spark, str(box), target, str(tmp_path / "second"), job="second")
    found = spark.read.parquet(f"{target}/job=first/emails").select("uid").collect() + spark.read.parquet(f"{target}/job=second/emails").select("uid").collect()
    assert sorted(r.uid for r in found) == [1, 2, 3, 4, 9]
    assert Mailbox.name() == "mailbox"
