"""Interval joins against all pairs."""

import random

from satchel import views as V
from satchel.operators.intervals import dyadic, within
from satchel.operators.intervals import F


def test_pieces_cover_each_number_once(spark):
    spans = [(lo, hi) for lo in range(-9, 10) for hi in range(-10, 18)] + [(0, 2**40), (-(2**40), 2**41 + 3), (1767607200123, 1799143200456)]
    found = spark.createDataFrame(spans, "low long, high long").select("low", "high", dyadic(F.col("low"), F.col("high")).alias("p")).collect()
    for r in found:
        parts = sorted((p.block << p.level, (p.block + 1) << p.level) for p in r.p)
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert (parts[0][0], parts[-1][1]) == (r.low, r.high + 1) if r.low <= r.high else parts == []
        assert len(parts) <= 2 * max(1, (r.high - r.low + 1).bit_length())


def test_join_equals_all_pairs(spark):
    r = random.Random(2)
    points = [(i, r.choice((None, r.randrange(-(10**6), 10**12)))) for i in range(150)] + [(200, 5), (201, 10)]
    stays = [(i, x, x + r.choice((0, 10**3, 10**11)), "at") for i, x in enumerate(r.randrange(-(10**6), 10**12) for _ in range(60))] + [(90, 5, 10, "x"), (91, 10, 5, "x"), (92, None, 9, "x")]
    found = within(spark.createDataFrame(points, "id long, at long"), "at", spark.createDataFrame(stays, "stay long, low long, high long, note string"), "low", "high")
    assert found.columns == ["id", "at", "stay", "note"]
    want = sorted((p, s) for p, t in points for s, lo, hi, _ in stays if None not in (t, lo, hi) and lo <= t <= hi)
    assert sorted((x.id, x.stay) for x in found.collect()) == want and len(want) > 100
    none = spark.createDataFrame([], "stay long, low long, high long")
    assert within(spark.createDataFrame(points, "id long, at long"), "at", none, "low", "high").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_milliseconds_do_not_depend_on_the_session_zone(spark):
    times = "values (timestamp_ntz'2024-03-31 02:30:00.123456'), (timestamp_ntz'1969-12-31 23:59:59.999'), (timestamp_ntz'2024-07-01 12:00:01') as t(ts)"
    want = [1711852200123, -1, 1719835201000]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for own in ("UTC", "Europe/Paris"):
            spark.conf.set("spark.sql.session.timeZone", own)
            assert [r[0] for r in spark.sql(f"select * from {times}").select(V.millis("ts")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_many_intervals_are_not_broadcast(spark):
    points = spark.range(-50, 40_000).select("id", (F.col("id") * 1000 + 7).alias("at"))
    stays = spark.range(30_000).select(F.col("id").alias("stay"), (F.col("id") * 900).alias("low"), (F.col("id") * 900 + (F.col("id") % 7 - 1) * 1100).alias("high"))
    found = within(points, "at", stays, "low", "high")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    want = sorted((p, s) for s in range(30_000) for p in range(max(-50, -((7 - s * 900) // 1000)), min(39_999, (s * 900 + (s % 7 - 1) * 1100 - 7) // 1000) + 1))
    assert sorted((r.id, r.stay) for r in found.select("id", "stay").collect()) == want and len(want) > 60_000
    far = points.withColumn("at", F.col("at") + 10**9)
    assert within(far, "at", stays, "low", "high").count() == 0 and within(points.limit(0), "at", stays, "low", "high").count() == 0
