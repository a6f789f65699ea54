"""Times of the views against the SQL's functions."""

import duckdb
import pytest

from satchel import views as V

MICROS = sorted({b + x for b in (-315619200000000, -2000, 0, 1704067200000000, 1780122138428000) for x in range(-3000, 3000, 1) if x % 1000 in (0, 1, 499, 500, 501, 999)})


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_milliseconds_are_those_of_the_sql(spark, zone, kind):
    con = duckdb.connect()
    want = [r[0] for r in con.execute(f"SELECT epoch_ms(make_timestamp(m)) FROM (SELECT unnest({MICROS}) AS m) ORDER BY m").fetchall()]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        values = ", ".join(f"({m}L)" for m in MICROS)
        time = {"timestamp": "timestamp_micros(m)", "timestamp_ntz": "timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, m / 1000000BD)"}[kind]
        rows = spark.sql(f"SELECT m, {time} AS ts FROM VALUES {values} AS t(m)")
        assert rows.schema["ts"].dataType.simpleString() == kind
        assert [r[0] for r in rows.orderBy("m").select(V.millis("ts")).collect()] == want
        assert rows.selectExpr("CAST(NULL AS timestamp) AS ts").limit(1).select(V.millis("ts")).first()[0] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
