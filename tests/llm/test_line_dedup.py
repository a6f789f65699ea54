import hashlib

import numpy as np

from satchel.llm import line_dedup
from satchel.llm.text import Chunk, word_hashes
from tests.llm.texts import SCHEMA, corpus


def brute(rows, similarity=0.8, shingle=5, least=1):
    sets, out = [], {}
    for i, t in sorted(rows):
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            w = line.encode().split()
            if len(w) >= least:
                s = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}
                if any(len(s & o) / len(s | o) >= similarity for o in sets):
                    gone += 1
                else:
                    kept.append(line)
                sets.append(s)
            else:
                kept.append(line)
        out[i] = (len((t or "").split("\n")), gone, "\n".join(kept))
    return out


def lines():
    r = np.random.default_rng(4)
    base = [[f"w{x}" for x in r.integers(0, 60, r.integers(0, 40))] for _ in range(60)]
    rows = []
    for i in range(40):
        own = [" ".join(base[k]) for k in r.integers(0, 60, 4)]
        for k in r.integers(0, 60, 3):
            w = list(base[k])
            if w:
                w[r.integers(0, len(w))] = "x"
            own.append(" ".join(w))
        rows.append((i, "\n".join(own) + "\n" * int(r.integers(0, 3))))
    return rows


def test_matches_brute_force(spark):
    rows = lines() + [(100 + i, t) for i, t, *_ in corpus()]
    docs = spark.createDataFrame([(i, t, "k", i) for i, t in rows], SCHEMA).repartition(5)
    want = brute(rows)
    got = {r.doc_id: r for r in line_dedup.digests(docs).collect()}
    assert {i: (r.n_lines, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in want.items()}
    texts = line_dedup.remove_later(docs)
    assert texts.columns == ["doc_id", "text", "kept", "ord", "n_removed"]
    assert {r.doc_id: ((r.text or ""), r.n_removed) for r in texts.collect()} == {i: (k, g) for i, (_, g, k) in want.items()}


def test_chains_are_judged_on_the_input(spark):
    words = [f"w{i}" for i in range(40)]
    steps = [" ".join(words)]
    for k in range(0, 16, 2):
        words[39 - k] = f"y{k}"
        steps.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(steps)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.digests(docs).collect()} == {i: g for i, (_, g, _) in brute(rows).items()}


def test_short_lines_null_ids_and_empty_table(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(None, line), (2, line), (2, line), (3, "a b\na b"), (4, None)], "doc_id long, text string")
    assert sum(r.n_removed for r in line_dedup.remove_later(docs, least=3).collect()) == 1
    assert sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.remove_later(docs).collect()) == [(0, 1), (2, 0), (2, 0), (3, 1), (4, 0)]
    assert line_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_near_copies_of_one_line_meet_in_rounds(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: i % 37], f"n{i}", *words[i % 37 :]]) + f"\nown{i} line\nlast") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = {i: (n, g) for i, (n, g, _) in brute(rows).items()}
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.digests(docs).collect()} == want


def test_values_that_repeat_are_found_in_parts(spark):
    values = spark.range(3000).selectExpr("xxhash64(id % 2500) as v").repartition(6)
    want = {r.v for r in values.groupBy("v").count().where("count > 1").select("v").collect()}
    for n in (10, 40 << 20, 1 << 40):
        assert {r.value for r in line_dedup.repeated_values(values.mapInArrow, n).collect()} == want


def test_each_match_names_an_earlier_similar_line(spark):
    rows = lines()[:25]
    work = line_dedup.with_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    tokens = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            w = line.split()
            tokens[i, k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    got = {(r.ord, r.line): (r.of.ord, r.of.line) for r in line_dedup.later_matches(work).collect()}
    similar = lambda a, b: tokens[a] and len(tokens[a] & tokens[b]) >= 0.8 * len(tokens[a] | tokens[b])
    assert all(b < a and similar(a, b) for a, b in got.items())
    assert set(got) == {a for a in tokens if any(b < a and similar(a, b) for b in tokens)}


def test_digests_read_the_texts_once(spark, tmp_path):
    """The last step has one scan of the texts; those that lose no line are not shuffled, and their digest is made once."""
    spark.createDataFrame([(i, t, "k", i) for i, t in lines()], SCHEMA).write.parquet(str(tmp_path / "docs"))
    plan = line_dedup.digests(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("doc_id#") and sum("Relation [doc_id#" in x for x in plan.split("\n")) == 1


def test_values_in_common_are_counted():
    r = np.random.default_rng(8)
    for n in range(40):
        # values that differ in their lowest bits only, and values that differ in the highest
        sides = [[np.unique(r.integers(0, 30, r.integers(0, 12)).astype(np.uint64) << np.uint64(r.choice([0, 58]))) for _ in range(n)] for _ in range(2)]
        flat = [x for side in sides for x in (np.concatenate([*side, np.empty(0, np.uint64)]), np.array([len(own) for own in side], np.int64))]
        assert line_dedup._in_common(*flat).tolist() == [len(np.intersect1d(x, y)) for x, y in zip(*sides)]


def test_words_and_their_hashes_tell_them_apart():
    """Words of any length, with zero bytes, and words of neighbouring texts that touch."""
    r = np.random.default_rng(9)
    texts = [bytes(r.choice([0, 9, 32, 97, 98], r.integers(0, 200), p=[0.2, 0.02, 0.02, 0.38, 0.38]).astype(np.uint8)) for _ in range(200)]
    texts += [b"a", b"b", b"c", b"", b"a"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    chunk = Chunk(0, len(texts), data, np.cumsum([0, *map(len, texts)]))
    starts, ends, first = chunk.words()
    want = [t.split() for t in texts]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w for own in want for w in own]
    assert np.diff(first).tolist() == [len(own) for own in want]
    hashes = word_hashes(data, starts, ends)
    names = {w: h for w, h in zip((w for own in want for w in own), hashes.tolist())}
    assert [names[w] for own in want for w in own] == hashes.tolist() and len(set(names.values())) == len(names)
