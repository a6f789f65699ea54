"""Keyed stream processors: the job machine and balance alerts."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from satchel.operators import finance
from satchel.streaming import alerts, jobs
from satchel.streaming.state import PROVIDER, written

DAY = datetime(2026, 1, 5, tzinfo=timezone.utc)
COMMANDS = "job_id long, at timestamp, command string, error string"


def at(seconds):
    return DAY + timedelta(seconds=seconds)


def ms(seconds):
    return int(at(seconds).timestamp()) * 1000


def streamed(spark, tmp_path, batches, schema, name="in"):
    """A stream that gets one file a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))


def test_machine_refuses_and_restarts(spark, tmp_path):
    before = spark.conf.get(PROVIDER)
    first = [(1, at(0), "create", None), (1, at(2), "start", None), (1, at(3), "start", None), (1, at(4), "fail", "no route"), (2, at(0), "pause", None), (None, at(1), "create", None), (3, at(0), "create", None), (3, at(1), "complete", None)]
    second = [(1, at(10), "reset", None), (1, at(11), "sync", None), (1, at(10), "dance", None), (3, at(10), "create", None), (3, at(0), "start", None)]
    log = written(jobs.transitions(streamed(spark, tmp_path, [first, second], COMMANDS), late="1 hour"), str(tmp_path / "w"))
    got = sorted((r.job_id, (r.at - ms(0)) // 1000, r.command, r.before, r.after, r.accepted, r.reason, r.error) for r in log.collect())
    assert got == sorted([
        (1, 0, "create", None, "pending", True, None, None), (1, 2, "start", "pending", "running", True, None, None), (1, 3, "start", "running", "running", False, "the job is running", None),
        (1, 4, "fail", "running", "failed", True, None, "no route"), (1, 10, "reset", "failed", "completed", True, None, None), (1, 10, "dance", "completed", "completed", False, "unknown command", None),
        (1, 11, "sync", "completed", "running", True, None, None), (2, 0, "pause", None, None, False, "there is no such job", None), (3, 0, "create", None, "pending", True, None, None),
        (3, 1, "complete", "pending", "pending", False, "the job is pending", None), (3, 10, "create", "running", "running", False, "the job is there", None), (3, 0, "start", "pending", "running", True, None, None),
    ])
    assert sorted(map(tuple, jobs.states(log).collect())) == [(1, "running", ms(11), None), (3, "running", ms(0), None)]
    assert spark.conf.get(PROVIDER) == before


def test_waiting_jobs_are_due_by_a_timer(spark, tmp_path):
    first = [(1, at(0), "create", None), (1, at(1), "start", None), (1, at(2), "pause", None), (2, at(0), "create", None), (2, at(1), "start", None), (2, at(2), "complete", None), (3, at(0), "create", None)]
    second = [(2, at(200), "start", None), (9, at(250), "create", None)]
    third = [(9, at(400), "start", None)]
    log = written(jobs.transitions(streamed(spark, tmp_path, [first, second, third], COMMANDS), every=300), str(tmp_path / "w"))
    own = [(r.job_id, r.at, r.before, r.accepted) for r in log.collect() if r.command == "sync"]
    assert own == [(1, ms(302), "paused", True)]  # the second was started by hand before it was due


def test_due_and_startup(spark):
    table = spark.createDataFrame([(i, 1 + i % 3, s, 1000 - i) for i, s in enumerate(["completed", "running", "paused", "failed", "pending"])] + [(100 + i, 1, "completed", i) for i in range(200)], "id long, credential_id long, status string, created_at long")
    assert [r.id for r in jobs.due(table, 4).orderBy("id").collect()] == [0, 2] and jobs.due(table).count() == 97
    credentials = spark.createDataFrame([(1, "imap", True), (2, "oauth", True), (3, "imap", False), (4, "imap", True), (5, "api-key", True)], "id long, credential_type string, is_active boolean")
    found = sorted(((r.credential_id, r.job_id, r.command) for r in jobs.startup(credentials, table).collect()), key=str)
    assert found == [(1, 3, "reset"), (2, 1, "reset"), (4, None, "create"), (4, None, "start")]


def test_stream_of_alerts_equals_table(spark, tmp_path):
    r = random.Random(5)
    rows = [(a, 100 * a + i, at(r.randrange(0, 5000)), Decimal(r.randrange(-9000, 9000)) / 100) for a in range(6) for i in range(60)]
    accounts = spark.createDataFrame([(a, Decimal(a * 10)) for a in range(5)], "id long, balance decimal(18,2)")
    schema = "account_id long, id long, at timestamp, change decimal(18,2)"
    arriving = sorted(rows, key=lambda x: x[2] + timedelta(seconds=r.randrange(0, 600)))  # up to ten minutes out of order
    batches = [arriving[i : i + 60] for i in range(0, 360, 60)] + [[(None, None, at(10**7), None)]]
    # the last row has no account: it moves the watermark only
    last = spark.createDataFrame(rows, schema)
    want = sorted((x.account_id, x.id, x.balance) for x in finance.crossings(accounts, last, "5").collect())
    stream = streamed(spark, tmp_path, batches, schema)
    closing = spark.createDataFrame([(-1, Decimal(0))], "id long, balance decimal(18,2)")
    found = alerts.balance_alerts(stream.fillna({"account_id": -1, "id": -1}).withColumn("change", alerts.F.coalesce("change", alerts.F.lit(0))), accounts.unionByName(closing), "5", late="700 seconds")
    got = written(found, str(tmp_path / "w")).where("account_id >= 0")
    assert sorted((x.account_id, x.id, x.balance) for x in got.collect()) == want and len(want) > 10


def test_jobs_of_a_bucket_are_answered_each_by_itself(spark, tmp_path):
    r = random.Random(8)
    names = [*jobs.MOVES, "dance", "", None]
    rows = [[(j, at(r.randrange(i * 500, 500 * i + 900)), r.choice(names) if r.random() < 0.8 else "create", r.choice((None, "x", "y"))) for j in r.choices(range(-20, 60), k=300)] for i in range(2)]
    log = written(jobs.transitions(streamed(spark, tmp_path, rows, COMMANDS), late="1 hour", buckets=3), str(tmp_path / "w"))
    now, want = {}, []
    for batch in rows:
        for j, t, command, error in sorted(batch, key=lambda x: (x[1], jobs.RANK.get(x[2], 99), x[2] or "", x[3] or "")):
            status, last = now.get(j, (None, None))
            allowed, after = jobs.MOVES.get(command, ((), None))
            reason = "unknown command" if command not in jobs.MOVES else "older than the last change" if last and t < last else None
            if reason is None and status not in allowed:
                reason = "there is no such job" if status is None else "the job is there" if command == "create" else f"the job is {status}"
            if reason is None:
                now[j] = after, t
            want.append((j, int(t.timestamp()) * 1000, command or "", status, after if reason is None else status, reason is None, reason, None if reason else error))
    got = [tuple(x[c] for c in ("job_id", "at", "command", "before", "after", "accepted", "reason", "error")) for x in log.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({x[6] for x in want}) > 7


def test_jobs_cross_to_python_by_buckets(spark, tmp_path):
    stream = spark.readStream.schema(COMMANDS).parquet(str(tmp_path))
    plan = jobs.transitions(stream, buckets=5)._jdf.queryExecution().analyzed().toString()
    assert "WithState" in plan and "[bucket#" in plan
