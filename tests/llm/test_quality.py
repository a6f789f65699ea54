import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.llm import quality_rules, subword_classifier


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    repeated = set()
    triples = {}
    for i in range(len(words) - 2):
        triples.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in triples.values():
        if len(at) > 1:
            repeated |= {i + k for i in at for k in range(3)}
    seen, dup, n = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            n += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n


@pytest.mark.parametrize("text", ["", " \n ", "a b c a b c", "a a a a a", "x\nx\n\nx \nx", "é ü#\x0b日本 *$%&|<>[]", "a b c d a b c x a b c"])
def test_counts(text):
    assert quality_rules.counts(text) == brute_counts(text)


def test_counts_of_random_texts():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a", "b", "ab", " ", "\n", "é", "#", "\x1c", "\x85"]) for _ in range(r.randint(0, 80)))
        assert quality_rules.counts(text) == brute_counts(text)


def test_quantiles():
    assert abs(quality_rules.chi_square_quantile(0.05, 4) - 9.4877) < 1e-3
    assert abs(quality_rules.chi_square_quantile(0.01, 6) - 16.8119) < 1e-3


def documents(spark, n=600):
    r = random.Random(2)
    rows = []
    for i in range(n):
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200))]
        text = " ".join(w)
        if i % 10 == 0:
            text = " ".join(f"{x}###" for x in w)
        if i % 50 == 7:
            text = "\n".join([" ".join(w[:12])] * 3 + [" ".join(w)])
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 2}", "clash"))
    rows += [(9001, None, "en", "s0", ""), (9002, "few words", "xx", None, ""), (9003, " ".join(rows[1][1].split()), "zz", "lonely", ""), (None, rows[2][1], "en", "s1", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance string")


def test_outliers_go_and_others_stay(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in quality_rules.rules(docs).collect()}
    assert all(not got[i].kept for i in range(0, 600, 10))
    assert all(got[i].kept for i in range(600) if i % 10 and i % 50 != 7)
    assert got[9001].base_failed and got[9002].base_failed and got[9003].kept and got[None].kept
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}


def test_estimate_is_robust_and_near_the_centre(spark):
    r = np.random.default_rng(5)
    x = r.multivariate_normal([1, 2, 3, 4], np.diag([1, 2, 0.5, 1]), 4000)
    x[:800] += 30  # a fifth of the rows far away
    rows = spark.createDataFrame([("p", *map(float, v)) for v in x], "pool string, " + ", ".join(f"{s} double" for s in quality_rules.STATISTICS))
    assert abs(quality_rules.cutoff(0.01, 4) - 4 * 99.249) < 0.01
    e = quality_rules.estimates(rows).first()
    assert np.allclose([e.m0, e.m1, e.m2, e.m3], [1, 2, 3, 4], atol=0.15)
    assert 0.6 < 1 / e.p00 < 1.5 and 1.2 < 1 / e.p11 < 3


def brute_force_distances(x, support=quality_rules.SUPPORT):
    """Concentration steps from medians with the nearest rows sorted exactly."""
    middle = np.median(x, axis=0)
    scatter = np.diag((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2)
    factor, n = quality_rules.consistency(support, x.shape[1]), int(np.ceil(support * len(x)))
    for _ in range(quality_rules.STEPS):
        near = np.argsort(np.einsum("ij,jk,ik->i", x - middle, np.linalg.inv(scatter + 1e-6 * np.eye(4)), x - middle), kind="stable")[:n]
        middle, scatter = x[near].mean(axis=0), factor * np.cov(x[near].T, bias=True)
    return np.einsum("ij,jk,ik->i", x - middle, np.linalg.inv(scatter + 1e-6 * np.eye(4)), x - middle)


def test_verdicts_match_a_brute_force_estimate(spark):
    docs = documents(spark, 900)
    found = quality_rules.with_statistics(quality_rules.with_counts(docs)).where("n_words >= 50").collect()
    got = {r.doc_id: r for r in quality_rules.rules(docs).collect()}
    alike = close = n = 0
    for pool in {(r.lang, r.source) for r in found}:
        rows = [r for r in found if (r.lang, r.source) == pool and not got[r.doc_id].base_failed]
        if len(rows) < quality_rules.MIN_GROUP:
            continue
        for r, d in zip(rows, brute_force_distances(np.array([[r[s] for s in quality_rules.STATISTICS] for r in rows]))):
            n += 1
            alike += got[r.doc_id].kept == bool(d <= quality_rules.cutoff(quality_rules.TAIL, 4))
            close += abs(got[r.doc_id].distance - d) < 0.15 * d + 0.5
    assert n > 800 and alike >= 0.995 * n and close >= 0.95 * n


def test_scatter_of_the_own_group_decides(spark):
    """The same text is an outlier where words have nearly one length, and none where lengths vary."""
    r = random.Random(6)
    say = lambda mean, n=120: " ".join("".join(r.choice("abcdefgh") for _ in range(max(1, round(r.gauss(mean, 1))))) for _ in range(n))
    rows = [(i, say(5), "en", "even") for i in range(200)] + [(1000 + i, say(r.uniform(3, 12)), "en", "mixed") for i in range(200)]
    odd = say(9.5)
    rows += [(500, odd, "en", "even"), (1500, odd, "en", "mixed")]
    got = {x.doc_id: x for x in quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[500].kept and got[1500].kept and got[500].distance > 50 * got[1500].distance
    assert sum(x.kept for x in got.values()) == len(rows) - 1


def test_each_statistic_can_reject(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7)))
    line = lambda n=10: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line() for _ in range(40)), "en", "s") for i in range(400)]
    lines = [line(2) for _ in range(60)]
    rows += [
        (1001, "\n".join(line().replace("a", "aaaaaa") for _ in range(40)), "en", "s"),
        (1002, "\n".join(line() + " ####" for _ in range(40)), "en", "s"),
        (1003, "\n".join(lines + lines[:50] + [line(20) for _ in range(10)]), "en", "s"),  # lines of two words: no three-word window repeats inside one
        (1004, " ".join([*(x := [word() for _ in range(180)]), *x[:80], *(word() for _ in range(100))]), "en", "s"),
    ]
    got = {x.doc_id: x for x in quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i in got if not got[i].kept] == [i for i in got if i > 1000] and not any(x.base_failed for i, x in got.items() if i != 1003)


def test_many_pools_meet_in_a_salted_join(spark, monkeypatch):
    docs = documents(spark)
    want = {r.doc_id: r.kept for r in quality_rules.rules(docs).collect()}
    monkeypatch.setattr(quality_rules, "BROADCAST_POOLS", 0)
    assert {r.doc_id: r.kept for r in quality_rules.rules(docs).collect()} == want


def test_rules_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules.rules(docs).collect() == []


def test_classifier_on_held_out_rows(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 80))]
        rows.append((i, " ".join(x + "!!" if bad else x for x in w), 0.5))
        labels.append((i, int(not bad), 0))
    rows += [(None, "text", 0.1), (9000, None, 0.1), (9001, "", 0.1), (3, rows[3][1], 0.1), (9002, "é" * 50_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    table = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = subword_classifier.classify(docs, table).collect()
    assert len(got) == 505 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 500]
    truth = dict((i, q) for i, q, _ in labels)
    assert len(held) > 60 and sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.97
    import zlib

    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    empty = {x.score for x in got if x.doc_id in (9000, 9001)}
    assert len(empty) == 1


def test_conflicting_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(1, "text 1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in (1, 0, 1)], "doc_id long, quality int")
    chosen = subword_classifier.sample(docs, labels, "quality").collect()
    assert {r.label for r in chosen} == {0} and len(chosen) > len({r.text for r in chosen}) - 1
    assert len(subword_classifier.classify(docs, labels).collect()) == 41


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [round(x.score, 6) for x in subword_classifier.classify(docs, labels).collect()] == [0.5]
    assert subword_classifier.classify(docs.where(F.lit(False)), labels).collect() == []


def test_sample_is_bounded_by_rows(spark):
    """One labelled key with very many documents gives no more rows than the bound, and always the same ones."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(2, 60)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    once, again = ([tuple(r) for r in subword_classifier.sample(x, labels, "quality", rows=40).collect()] for x in (docs, docs.repartition(3)))
    assert len(once) == 40 and sorted(once) == sorted(again)
    assert subword_classifier.sample(docs.where("doc_id > 1"), labels, "quality", rows=10000).count() < 58


def test_rows_with_null_and_repeated_keys_are_judged_each_alone(spark):
    r = random.Random(9)
    good = lambda i: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(10**6)) for _ in range(70))
    bad = "same few words " * 40
    rows = [(None, good(i), "en", "s", i) for i in range(40)] + [(None, bad, "en", "s", 99)] + [(7, good(i), "en", "s", i) for i in range(5)] + [(7, bad, "en", "s", 99), (8, None, "en", "s", 99), (8, good(0), None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    got = [(x.doc_id, x.text) for x in kept.collect()]
    assert sorted(got, key=str) == sorted(((x[0], x[1]) for x in rows if x[4] != 99), key=str)
    lettered = docs.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    assert quality_rules.keep_good(lettered).count() == 46
