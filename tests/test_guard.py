import pytest

from satchel.plans.guard import NotReadOnly, guarded


@pytest.fixture(autouse=True)
def view(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    spark.udf.register("mine", lambda x: x, "long")


@pytest.mark.parametrize("text", ["SELECT id FROM numbers", "WITH a AS (SELECT id FROM numbers) SELECT * FROM a", "VALUES (1), (2)", "FROM numbers |> WHERE id > 3", "SELECT count(*) FROM numbers WHERE id IN (SELECT id FROM numbers) GROUP BY ALL", "SELECT id FROM numbers UNION ALL SELECT id FROM numbers", "WITH a AS (SELECT id FROM numbers), b AS (SELECT id FROM a) SELECT upper(string(id)), date_add(current_date(), 1) FROM b JOIN NUMBERS USING (id)", "SELECT sum(id) OVER (ORDER BY id), explode(array(1, 2)) FROM numbers", "SELECT x FROM numbers LATERAL VIEW explode(array(id, 1)) t AS x", "SELECT CASE WHEN id > 2 THEN -id ELSE id % 2 END FROM numbers WHERE id BETWEEN 1 AND 5 AND NOT (id = 4 OR string(id) LIKE '3%')"])
def test_queries_pass(spark, text):
    assert guarded(spark, text, 5).count() <= 5


@pytest.mark.parametrize(
    "text",
    ["INSERT INTO numbers VALUES (1)", "WITH a AS (SELECT 1 AS id) INSERT INTO numbers SELECT * FROM a", "DROP VIEW numbers", "SET x = 1", "EXPLAIN SELECT 1", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/x`", "SELECT 1 WHERE EXISTS (SELECT * FROM parquet.`/x`)", "WITH a AS (SELECT * FROM csv.`/x`) SELECT * FROM a", "CREATE TABLE x (a INT)", "nonsense", "SELECT (SELECT max(value) FROM text.`/etc/passwd`) AS x", "SHOW TABLES", "CACHE TABLE numbers", "DESCRIBE numbers", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT id FROM numbers WHERE try_reflect('java.lang.System', 'getenv', 'HOME') IS NULL", "SELECT (SELECT max(java_method('java.util.UUID', 'randomUUID')) FROM numbers)", "VALUES (java_method('java.util.UUID', 'randomUUID'))", "SELECT IDENTIFIER('java_method')('java.util.UUID', 'randomUUID')", "SELECT * FROM stored", "SELECT * FROM IDENTIFIER('stored')", "WITH stored AS (SELECT * FROM stored) SELECT * FROM stored", "SELECT * FROM numbers, LATERAL (SELECT * FROM stored)", "SELECT input_file_name() FROM numbers", "SELECT mine(id) FROM numbers", "BEGIN SELECT 1; END", "SELECT * FROM (WITH stored AS (SELECT 1 AS id) SELECT * FROM stored) JOIN stored USING (id)", "SELECT * FROM range(5)", "SELECT x FROM numbers LATERAL VIEW stack(1, java_method('java.util.UUID', 'randomUUID')) t AS x"],
)
def test_others_are_refused(spark, text):
    with pytest.raises(NotReadOnly):
        guarded(spark, text)


def test_parameters(spark):
    assert guarded(spark, "SELECT id FROM numbers WHERE id > :least", args={"least": 7}).count() == 2


def test_only_named_views(spark):
    spark.range(3).createOrReplaceTempView("others")
    assert guarded(spark, "SELECT * FROM others", views=["others"]).count() == 3
    with pytest.raises(NotReadOnly):
        guarded(spark, "SELECT * FROM numbers", views=["others"])
