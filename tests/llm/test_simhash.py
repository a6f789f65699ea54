import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from satchel.llm import simhash
from satchel.llm.components import component_labels

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_print(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = [i for i, _ in prints]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= radius:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("width", [3, 5])
def test_near_duplicates_match_brute_force(spark, width):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts = base + base[:10] + [t + " Tail" for t in base[:20]] + [None, "", " \n\t", "ONE", "one", "a b", "A\x0bb", "é É", "x " * 3000, "\x1c a\x1cb"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, width).collect()}
    prints = [(i, brute_print(t, width)) for i, t in enumerate(texts)]
    assert {i: got[i].fp & (1 << 64) - 1 for i in got} == dict(prints)
    assert {i: got[i].component_id for i in got} == brute_components(prints, 3)


def test_links_between_random_and_clustered_prints(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 63, 300)
    near = [int(c) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(d)) for c in centres[:60] for a, b, d in r.integers(0, 63, (4, 3))]
    values = sorted({int(c) for c in centres} | set(near))
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "vertex long, fp long")
    want = brute_components(list(enumerate(values)), 3)
    for n in (None, 10**12):  # the finer choice of blocks finds the same
        labels = {x.node: x.component for x in component_labels(simhash.near_links(prints, 3, n)).collect()}
        assert {i: labels.get(i, i) for i in want} == want


def test_a_large_shard_is_split(monkeypatch):
    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 20, 400).astype(np.uint64) << np.uint64(5)
    fp = np.unique(np.concatenate((base, base[:200] ^ np.uint64(1 << 9), base[:100] ^ np.uint64(7 << 30))))
    mask = ((1 << 64) - 1) ^ ((1 << 40) - 1)
    shard = np.stack((np.zeros(len(fp), np.int64), (fp & np.uint64(mask)).view(np.int64)), axis=1)
    want = brute_components(list(enumerate(fp.tolist())), 3)
    for most in (10**6, 300):
        monkeypatch.setattr(simhash, "SHARD_MOST", most)
        up = list(range(len(fp)))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in simhash.shard_links(np.arange(len(fp)), fp, shard, [mask], 3).tolist():
            x, y = sorted((find(a), find(b)))
            up[y] = x
        assert {i: find(i) for i in want} == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(200, 201), (200, 201)]
    got = {x.node: x.component for x in component_labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 1 for i in range(2, 40)}, 201: 200}


def test_keep_one_keeps_the_first_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (1, text), (2, text.upper()), (4, "other words here now and then"), (5, None), (6, ""), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    kept = simhash.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 4, 5, 6]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] == simhash.keep_one(docs).collect()


def test_copies_beyond_the_radius_go(spark):
    r = random.Random(6)
    texts = []
    for _ in range(30):
        one = [r.choice("abcdefghij") * r.randint(1, 9) + str(r.randint(0, 99)) for _ in range(r.randint(60, 200))]
        texts.append(" ".join(one))
        for share in (0.01, 0.02, 0.03):
            one = [f"Edit{r.randint(0, 999)}" if r.random() < share else w for w in one]
            texts.append("\n".join((" ".join(one[:30]), " ".join(one[30:]))))
    pairs = {(i, j): simhash._pair_similarity(texts[i], texts[j], 5) for j in range(len(texts)) for i in range(j)}
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert any(s >= 0.8 and (prints[i] ^ prints[j]).bit_count() > 7 for (i, j), s in pairs.items())
    found = simhash.copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone = {x.doc_id for x in found}
    assert len(gone) == len(found) and all(x.of < x.doc_id for x in found)
    assert all(pairs[x.of, x.doc_id] >= 0.8 for x in found)
    assert not [p for p, s in pairs.items() if s >= 0.8 and not gone & set(p)]
