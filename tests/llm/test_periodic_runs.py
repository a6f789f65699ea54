"""Runs of words against a brute-force search."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import re

from satchel.llm import periodic_runs as P
from tests.llm.texts import SCHEMA, corpus


def brute(words, least=24):
    """(start, length, period) of all runs, by stretching every period from every start."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 3 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def texts(r, n):
    for _ in range(n):
        base = [r.choice("ab") for _ in range(r.randint(1, 12))]
        words = [r.choice("abc") for _ in range(r.randint(0, 30))] + base * r.randint(1, 12) + base[: r.randint(0, len(base))]
        yield words + [r.choice("abc") for _ in range(r.randint(0, 30))]


def test_runs_equal_brute_force_alone_and_together():
    r = random.Random(1)
    many = list(texts(r, 150)) + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, ["a", "b", "c"] * 300]
    for least in (24, 17, 9, 6):
        want = [brute(w, least) for w in many]
        assert [f.runs for f in P.examine([[x.encode() for x in w] for w in many], least)] == want
        for w, x in zip(many, want):
            assert P.examine([[y.encode() for y in w]], least)[0].runs == x
    assert sum(map(len, want)) > 300


def test_names_give_common_extensions(monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 7)  # pairs in many portions
    r = np.random.default_rng(2)
    words = np.concatenate([r.integers(0, 2, 90), np.tile(r.integers(0, 3, 11), 9)])
    t, s, n, q = P.runs(words, [len(words)])
    assert list(zip(s, n, q)) == brute(words.tolist())
    names = P.Names(words, np.array([len(words)]))
    names.grow(2)  # the highest level is taken several times
    for i, j in ((90, 101), (3, 40), (0, 1)):
        k = 0
        while j + k < len(words) and words[i + k] == words[j + k]:
            k += 1
        assert names.ahead(np.array([i]), np.array([j]))[0] == k
        k = 0
        while i - k - 1 >= 0 and words[i - k - 1] == words[j - k - 1]:
            k += 1
        assert names.behind(np.array([i]), np.array([j]))[0] == k


def digest(key, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and key is not None:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, len(runs), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_columns_equal_brute_force(spark):
    r = random.Random(7)
    rows = corpus(n=120) + [(1000 + i, " ".join(w), "x", 1) for i, w in enumerate(texts(r, 120))] + [(None, "a b " * 30, "x", 1), (None, None, "x", 1)]
    found = P.collapse(P.with_planted_runs(spark.createDataFrame(rows + rows[:9], SCHEMA).repartition(3)))
    got = [tuple(x) for x in found.drop("runs", "kept").collect()]
    order = lambda x: (x[0] is None, str(x))
    assert sorted(got, key=order) == sorted((digest(*x[:2]) for x in rows + rows[:9]), key=order)
    assert sum(x[1] > 0 for x in got) > 60 and sum(zlib.crc32(str(x[0]).encode()) % 10 == 0 for x in rows) > 10


def test_operator_gives_runs_and_texts(spark):
    rows = [(1, "in the beginning " + "la la land " * 12 + "the end", "x"), (2, "no run here", "x")]
    found = {x.doc_id: x for x in P.collapse(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()}
    assert [tuple(x) for x in found[1].runs] == [(3, 36, 3)] and found[1].kept == "in the beginning la la land the end"
    assert found[1].exponent_milli == 12000 and found[2].runs == [] and found[2].start is None and found[2].kept == "no run here"
    assert P.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_of_one_word(spark):
    (found,) = P.examine([[b"a"] * 40000])
    assert found.runs == [(0, 40000, 1)] and found.kept.sum() == 1
