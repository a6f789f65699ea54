"""Threads by references: all at once, and batch by batch."""

import random

from satchel.operators import graphs, threads

SCHEMA = "message_id string, in_reply_to string, references array<string>"


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for m, reply, refs in rows:
        if m is not None:
            find(m)
            for other in [*(refs or []), reply]:
                if other:
                    a, b = sorted((find(m), find(other)))
                    parent[b] = a
    return {x: find(x) for x in parent}


def mails(r, n):
    out = []
    for i in range(n):
        earlier = [f"m{r.randrange(2 * n):03d}" for _ in range(r.choice((0, 0, 0, 1, 2)))]  # half of them never come
        out.append((f"m{i:03d}", r.choice((None, "", *earlier)), earlier or None))
    return out


def test_components_of_paths_stars_and_circles(spark):
    r = random.Random(1)
    path, star, circle = [(i, i + 1) for i in range(100, 160)], [(1000, i) for i in range(200, 260)], [(300 + i, 300 + (i + 1) % 7) for i in range(7)]
    edges = path + star + circle + [(5, 5)]
    r.shuffle(edges)
    got = {x.node: x.component for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 200 for i in (*range(200, 260), 1000)} | {300 + i: 300 for i in range(7)}
    assert got == want
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_threads_join_over_messages_that_never_came(spark):
    rows = [("b", "lost", None), ("c", None, ["lost"]), ("d", "c", ["lost", "c"]), ("e", None, None), (None, "b", None), ("f", "f", [])]
    got = {x.node: (x.known, x.thread) for x in threads.threads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"b": (True, "b"), "c": (True, "b"), "d": (True, "b"), "lost": (False, "b"), "e": (True, "e"), "f": (True, "f")}


def test_batches_give_what_all_at_once_gives(spark, tmp_path):
    r = random.Random(4)
    rows = mails(r, 90)
    r.shuffle(rows)
    store = threads.ThreadStore(spark, str(tmp_path))
    for batch in range(3):
        part = spark.createDataFrame(rows[30 * batch : 30 * batch + 30], SCHEMA)
        store.merge(part, batch)
        if batch == 1:
            store.merge(part, batch)  # again, as after a failure
        got = {x.node: x.thread for x in store.threads().collect()}
        assert got == union_find(rows[: 30 * batch + 30])
    known = {x.node for x in store.threads().where("known").collect()}
    assert known == {m for m, *_ in rows}
    sizes = sorted(len([1 for t in got.values() if t == u]) for u in set(got.values()))
    assert sizes[-1] >= 10 and len(sizes) > 5
    # a batch reads the members that it names, and writes its own nodes only
    store.merge(spark.createDataFrame([("zz", None, ["m001"])], SCHEMA), 3)
    assert store._read("members", threads.MEMBERS).where("batch = 3").count() == 2
