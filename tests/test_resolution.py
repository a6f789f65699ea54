"""Entity resolution against all pairs."""

import random
import re

from satchel.operators import resolution as R


def norm(x):
    return re.sub(r"[^\w]+|_", " ", x.lower()).strip()


def grams(x):
    p = f"  {x} "
    return {p[i : i + 3] for i in range(len(p) - 2)} if x else set()


def score(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def names(r, n):
    return [" ".join("".join(r.choice("abcdé") for _ in range(r.randint(2, 7))) for _ in range(r.randint(1, 4))) for _ in range(n)]


def mutated(r, x):
    i = r.randrange(len(x))
    return x[:i] + r.choice(("", "x", "-")) + x[i + 1 :]


def test_no_pair_is_lost(spark):
    r = random.Random(3)
    entities = sorted({norm(x) for x in names(r, 150)})
    mentions = sorted({norm(mutated(r, x)) for x in entities} | set(map(norm, names(r, 60))))
    for least in (0.3, 0.5, 0.8):
        found = R.similar_names(*(spark.createDataFrame([(x,) for x in xs], "name string") for xs in (mentions, entities)), least)
        got = {(x.mention_name, x.entity_name): round(x.score, 9) for x in found.collect()}
        want = {(a, b): round(score(a, b), 9) for a in mentions for b in entities if score(a, b) >= least - 1e-9}
        assert got == want and len(got) > 20


def test_links_ambiguity_and_review(spark):
    entities = [(1, "Blue Sky"), (2, "Blue Skies"), (3, "Acme Corporation"), (4, "Twins"), (5, "twins!"), (6, None), (7, " "), (8, "Überland")]
    mentions = [(1, "the blue-sky"), (2, "ACME  corporatoin"), (3, "Twins"), (4, "nobody else"), (5, None), (6, "blue sky"), (7, "überland"), (7, "überland")]
    rows = {r.id: r for r in R.resolved(spark.createDataFrame(mentions, "id long, name string"), spark.createDataFrame(entities, "id long, name string"), auto_link=0.6).collect()}
    assert R.resolved(spark.createDataFrame(mentions, "id long, name string"), spark.createDataFrame(entities, "id long, name string")).count() == 8
    assert rows[2].linked_id == 3 and rows[6].linked_id == 1 and rows[7].linked_id == 8
    assert [c.entity_id for c in rows[6].candidates] == [1, 2] and rows[6].candidates[0].score == 1
    assert rows[3].linked_id is None and rows[3].candidates[0].entities == 2 and rows[3].requires_review
    assert rows[4].candidates == [] and rows[4].requires_review and rows[5].requires_review and rows[5].score is None
    assert R.resolved(spark.createDataFrame([], "id long, name string"), spark.createDataFrame(entities, "id long, name string")).count() == 0


def test_a_name_in_most_rows_is_one_name(spark):
    many = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'the same name', concat('other ', id)) as name")
    row = R.resolved(spark.createDataFrame([(1, "the same name")], "id long, name string"), many).first()
    assert row.candidates[0].entities == 1000 and len(row.candidates) == 1 and row.linked_id is None


def test_pieces_are_compared_after_the_join_not_in_it(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (("blue sky", "acme"), ("blue skies", "acme")))
    joins = [x for x in R.similar_names(a, b)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any("bit_count" in x for x in joins) and not any("bit_count" in x and "array_intersect" in x for x in joins)


def test_pairs_of_frequent_pieces_are_compared_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    entities = sorted({norm(x) for x in names(r, 150)} | {"a", "ab", "a" * 90, "dé \U0001f600 b"})
    mentions = sorted({norm(mutated(r, x)) for x in entities} | set(map(norm, names(r, 60))) - {""})
    own = [spark.createDataFrame([(x,) for x in mentions], "name string"), spark.createDataFrame([(x, i) for i, x in enumerate(entities)], "name string, id long")]
    for rare, block, least in ((0, 16, 0.5), (20, 7, 0.3), (0, 1 << 15, 0.8)):
        monkeypatch.setattr(R, "RARE", rare)
        monkeypatch.setattr(R, "BLOCK", block)
        got = [(x.mention_name, x.entity_name, x.entity_id, round(x.score, 9)) for x in R.similar_names(*own, least).collect()]
        want = [(a, b, i, round(score(a, b), 9)) for a in mentions if a for i, b in enumerate(entities) if score(a, b) >= least - 1e-9]
        assert sorted(got) == sorted(want) and len(got) > 20
