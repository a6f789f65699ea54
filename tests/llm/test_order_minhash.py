"""Order MinHash against its definition in plain Python."""

import hashlib
import random

import numpy as np

from satchel.llm import order_minhash as M
from tests.llm.texts import SCHEMA, corpus


def chosen(text, factor, picks, gram):
    """The tuple of k-mers that one function selects, by the definition: ids and products of numpy, all else by lists."""
    grams = [text[i : i + gram] for i in range(len(text) - gram + 1)] or [text]
    seen, numbered = {}, []
    for g in grams:
        numbered.append((g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    order = []
    for position, (g, occurrence) in enumerate(numbered):
        order.append((ident(g, occurrence, gram) * int(factor) % (1 << 32), position))
    return tuple(grams[p] for p in sorted(p for _, p in sorted(order)[:picks]))


def ident(gram_text, occurrence, gram):
    points = np.frombuffer(gram_text.ljust(gram, M._FILL).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = M.window_hashes(M.mix(points.astype(np.uint64) + np.uint64(0x2545F491)), gram)
    return int(M.mix(h + np.uint64(occurrence) * M._CHAIN)[0] >> np.uint64(32))


def test_components_agree_where_the_chosen_tuples_do():
    r = random.Random(3)
    base = ["".join(r.choice("abc ") for _ in range(r.randint(0, 60))) for _ in range(12)]
    texts = base + [t[: len(t) // 2] + base[0][:20] for t in base] + ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaa", "日本語 é\U0001f600 日本語 é\U0001f600"]
    found = M.fingerprints(texts, 12, 2, 4)
    for i, factor in enumerate(M.factors(12)):
        tuples = [chosen(t, factor, 2, 4) for t in texts]
        for a in range(len(texts)):
            for b in range(a):
                assert (found[a, i] == found[b, i]) == (tuples[a] == tuples[b]), (texts[a], texts[b])


def test_a_fingerprint_depends_on_its_text_alone():
    r = random.Random(4)
    long = "".join(r.choice("abcdef ghi") for _ in range(3 * M.BLOCK))
    texts = ["x" * 70000, long, "short", long, "", "short", long[:-1] + "z"]
    found = M.fingerprints(texts)
    for i, t in enumerate(texts):
        assert (found[i] == M.fingerprints([t])[0]).all()
    assert (found[1] == found[3]).all() and (found[1] == found[6]).mean() > 0.9 and not (found[2] == found[4]).any()


def test_the_order_of_the_same_words_counts():
    r = random.Random(5)
    parts = ["".join(r.choice("abcdefghij") for _ in range(200)) for _ in range(8)]
    a, near, turned = "".join(parts), "".join(parts[:7]) + parts[0], "".join(parts[::-1])
    found = M.fingerprints([a, near, turned], 256)
    assert (found[0] == found[1]).mean() > (found[0] == found[2]).mean() + 0.1


def test_shortened_keys_that_meet_are_sorted_whole(monkeypatch):
    grams = np.array([5, 7, 5, 7, 5, 9], np.uint64)
    text = np.array([0, 0, 0, 1, 1, 1])
    want = [0, 0, 1, 0, 0, 0]
    assert M.occurrences(grams, text).tolist() == want
    monkeypatch.setattr(M, "mix", lambda x: np.zeros_like(x))
    assert M.occurrences(grams, text).tolist() == want


def plain(rows):
    """The contract's columns by lists: key, n_chars, digest of the edited text, and the two fingerprints."""
    rows = [(k, t or "") for k, t in rows]
    rows.sort(key=lambda r: -r[0])
    out = []
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = M.fingerprints([t, edited, after])
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), M.shown(a), M.shown(b), float((a == b).mean()), float((a == c).mean())))
    return sorted(out)


def test_edited_likeness_equals_lists(spark):
    rows = corpus()
    found = M.edited_likeness(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, found.collect())) == plain([r[:2] for r in rows])
    alike = dict(found.select("doc_id", "fingerprint").collect())
    again = {k: v for k, v in M.signatures(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert alike == again and alike[0] == alike[30]
    pair = spark.createDataFrame([(alike[0], alike[30], alike[1])], "a string, b string, c string")
    same, other = pair.select(M.likeness(M.F.col("a"), M.F.col("b")), M.likeness(M.F.col("a"), M.F.col("c"))).first()
    assert same == 1 and other < 1


def test_null_keys_repeated_rows_and_few_rows(spark):
    schema = "doc_id long, text string, range string"
    rows = [(None, "last of all, without a key", "x"), (5, "five five five", "x"), (5, "five five five", "x"), (5, "another five", "x"), (7, None, "x")]
    found = M.edited_likeness(spark.createDataFrame(rows * 40, schema).repartition(4)).collect()
    assert len(found) == 200
    assert {r.doc_id: r.n_chars for r in found} == {None: 26, 5: 12, 7: 0} or {r.n_chars for r in found} == {26, 14, 12, 0}
    assert len({tuple(r) for r in found}) == 4 and sum(r.doc_id == 5 for r in found) == 120
    (lone,) = M.edited_likeness(spark.createDataFrame(rows[:1], schema)).collect()
    assert lone.near_next == 1 and lone.doc_id is None
    assert M.edited_likeness(spark.createDataFrame([], schema)).count() == 0
    keyed = spark.createDataFrame([("b", "some text here"), ("a", "some other text")], "`a key` string, th string")
    assert {r[0] for r in M.edited_likeness(keyed, "a key", "th").collect()} == {"a", "b"}
