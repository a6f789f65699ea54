"""Ball k-means against plain Lloyd rounds and its SQL."""

import hashlib
import random

import duckdb
import numpy as np

from satchel.llm import ball_kmeans as B
from satchel.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def lloyd(rows, k=16, rounds=3, dimensions=64):
    kept = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    of = {j: sum(d for d, c in last if c == j) for j in range(len(centroids))}
    return [(i, c, d, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, last)]


def found(spark, rows, dimensions=64, k=16):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return B.clusters(df, k, 3, Q.F.sha2(Q.F.concat(Q.F.lit("1:"), Q.F.col("key").cast("string")), 256), dimensions=dimensions)


def same(got, want):
    order = lambda r: (r[0] is None, str(r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_equals_lloyd_with_odd_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(i % 5, 0.4) for _ in range(64)], "x", 1) for i in range(200)]
    rows += rows[:7] + [(i, rows[3][1], "x", 1) for i in range(500, 540)] + [(None, rows[4][1], "x", 1)]
    rows += [(900, None, "x", 1), (901, [], "x", 1), (902, [1.0] * 63, "x", 1), (903, [None] + [1.0] * 63, "x", 1), (904, [float("nan")] * 64, "x", 1), (905, [float("inf")] * 64, "x", 1)]
    got = found(spark, rows)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    same(got.collect(), lloyd(rows))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)], "x", 1) for i, (x, y) in enumerate((x, y) for x in range(-4, 5) for y in range(-4, 5))]
    same(found(spark, rows, 2, 9).collect(), lloyd(rows, 9, 3, 2))


def test_few_and_no_vectors(spark):
    same(found(spark, [(1, [1.0, 2.0], "x", 1), (2, [3.0, 4.0], "x", 1)], 2).collect(), lloyd([(1, [1.0, 2.0]), (2, [3.0, 4.0])], dimensions=2))
    assert found(spark, [(1, None, "x", 1)]).count() == 0 and found(spark, [], 64).count() == 0


def test_huge_components_are_left_out(spark):
    assert [r.vec_id for r in found(spark, [(1, [1e30, 0.0], "x", 1), (2, [3.0, 4.0], "x", 1)], 2).collect()] == [2]


def test_balls_compare_few_and_lose_none():
    r = np.random.default_rng(3)
    centres = r.integers(-1000, 1000, (20, 8))
    x = (centres[r.integers(0, 20, 5000)] + r.normal(0, 60, (5000, 8))).astype(np.int64)
    before, _ = B.nearest(x, centres)
    moved = centres + r.integers(-40, 40, centres.shape)
    most = np.array([B.squared(x[before == i], moved[i]).max(initial=0) for i in range(20)])
    balls = B.Balls(moved, most)
    at, least, compared = balls.nearest(x, before)
    want, distance = B.nearest(x, moved)
    assert (at == want).all() and (least == distance).all()
    assert compared < 0.2 * 19 * len(x) and any(len(n) < 19 for n, _ in balls.neighbours)
    # on a border the radius alone decides nothing: a centroid twice as far away is compared
    x, c = np.array([[1, 0]]), np.array([[2, 0], [0, 0]])
    assert B.Balls(c, np.array([0, 1])).nearest(x, np.array([1]))[:2] == (np.array([0]), np.array([1]))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = Q.op13_ball_kmeans(spark, sf_dir)
    want = con.sql(Q.oracle_sql()["op13_ball_kmeans"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
