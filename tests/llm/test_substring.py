import hashlib
import pathlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from satchel.llm import anchors, split_join, store, substring_index, suffix_merge
from satchel.llm.text import sliding_min_position
from tests.llm.texts import SCHEMA, corpus


def word_brute(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def byte_brute(rows, window):
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(t[p : p + window] for t in raw.values() for p in range(len(t) - window + 1))
    out = {}
    for i, t in raw.items():
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if count[t[p : p + window]] > 1:
                gone[p : p + window] = [True] * window
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("window,batches", [(20, 3), (7, 2), (1, 1)])
def test_words_match_brute_force(spark, window, batches):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_index.remove_repeats(docs, window, batches).collect()}
    assert got == word_brute([(i, t) for i, t, *_ in rows], window)


def test_a_hot_passage_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(split_join, "HOT_ROWS", 3)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_index.remove_repeats(docs, 20, 2).collect()}
    assert got == word_brute([(i, t) for i, t, *_ in rows], 20)


def test_merge_keeps_the_order_and_knows_common_prefixes():
    r = np.random.default_rng(3)
    pieces = [bytes(r.integers(97, 99, r.integers(0, 60)).astype(np.uint8)) for _ in range(12)]
    shards = [suffix_merge.Shard(pieces[i : i + 4]) for i in (0, 4, 8)]
    window = 12
    blocks, parted = suffix_merge.merge(shards, window)
    rows = []
    for shard, part, block in zip(shards, (pieces[0:4], pieces[4:8], pieces[8:12]), blocks):
        joined = b"".join(part[i] + b"\0" for i in shard.order)
        rows += [(int(b), joined[p:].split(b"\0")[0][:window]) for p, b in zip(shard.place, block)]
    rows.sort()
    for at, ((b, x), (c, y)) in enumerate(zip(rows, rows[1:]), 1):
        common = next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert x <= y and (b == c) == (parted[at] == 0)
        assert parted[at] == 0 and (x == y) or x != y and common < parted[at] <= window


def test_index_keeps_first_positions_over_batches_and_compaction(spark):
    rows = [(i, t) for i, t, *_ in corpus(3)]
    index = substring_index.FingerprintIndex(spark, window=5, gram=3, fanout=2)
    removed = 0
    for k in range(4):
        part = spark.createDataFrame(rows[k::4] or [], "doc_id long, text string")
        work = anchors.with_order(part)
        removed += index.add(work).count() > 0
    assert removed and len(index.runs) == 1 and index.runs[0].level == 2
    index.close()


def test_repeats_inside_a_text_are_few_rows_and_tables_go_after_a_batch(spark):
    phrase = " ".join(f"w{i}" for i in range(37))
    rows = [(i, f"head{i} " + f"{phrase} " * 300 + f"tail{i}") for i in range(4)]
    index = substring_index.FingerprintIndex(spark)
    folder = pathlib.Path(store.shared_folder(spark).removeprefix("file:"), "satchel")
    before = set(folder.iterdir()) if folder.exists() else set()
    spans = index.add(anchors.with_order(spark.createDataFrame(rows, "doc_id long, text string")))
    assert spans.count() < 100
    assert len(set(folder.iterdir()) - before) == 2  # the run and the spans
    index.close()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, 2).collect()}
    assert got == word_brute(rows, 20)


def test_texts_of_one_id_count_as_ordered_by_their_hash(spark):
    texts = spark.createDataFrame([(i // 3, t or "") for i, t, *_ in corpus(4)], "doc_id long, text string").dropDuplicates()
    rows = texts.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.th))
    want = word_brute(list(enumerate(r.text for r in rows)), 20)
    got = substring_index.remove_repeats(spark.createDataFrame(rows).select("doc_id", "text"), 20, 2).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((r.doc_id, *want[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("window,hot", [(50, 2048), (50, 1), (400, 2048), (400, 0), (3, 2048)])
def test_bytes_match_brute_force(spark, window, hot):
    rows = corpus(2, size=120)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_merge.remove_repeats(docs, window, hot=hot).collect()}
    assert got == byte_brute([(i, t) for i, t, *_ in rows], window)


def test_ids_that_are_null_or_repeat(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text + " more"), (1, text)], "doc_id long, text string")
    rows = substring_index.remove_repeats(docs, 20).collect()
    assert len(rows) == 4 and {r.n_removed for r in rows if r.doc_id is None} == {30}
    assert all(r.n_removed == r.n_bytes for r in suffix_merge.remove_repeats(docs, 50).collect() if r.n_bytes == len(text))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_index.remove_repeats(docs).collect() == [] == suffix_merge.remove_repeats(docs).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=0, max_size=25), st.integers(1, 3)), min_size=1, max_size=8), st.integers(1, 12), st.sampled_from([4, 40, 10**6]))
def test_merge_finds_repeated_windows(pieces, window, shard):
    raw, copies = [p.encode() for p, _ in pieces], [c for _, c in pieces]
    old, suffix_merge.SHARD_BYTES = suffix_merge.SHARD_BYTES, shard
    try:
        got = [x.tolist() for x in suffix_merge.repeated_windows(raw, copies, window)]
    finally:
        suffix_merge.SHARD_BYTES = old
    count = Counter()
    for p, c in zip(raw, copies):
        for i in range(len(p) - window + 1):
            count[p[i : i + window]] += c
    assert got == [[i for i in range(len(p) - window + 1) if count[p[i : i + window]] > 1] for p in raw]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=0, max_size=60), st.integers(1, 20))
def test_sliding_minimum(values, width):
    v = np.array(values, np.uint64) & ~np.uint64((1 << 24) - 1)
    want = [i + int(np.argmin(v[i : i + width])) for i in range(len(v) - width + 1)]
    assert sliding_min_position(v, width).tolist() == want


def low_entropy():
    """Long runs of one letter and of short periods, alone, broken, between other text, and in several documents."""
    period = "abcdefg hij"
    texts = ["a" * 3000, "a" * 51, "b" + "a" * 700 + "c", period * 90, "x" * 40 + period * 30 + "y" * 40, period * 20 + "!" + period * 20, "ab" * 300 + "c" * 300, "".join(f"{i:05d}" for i in range(200)), "z" * 50]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window", [50, 90])
@pytest.mark.parametrize("most", [2, 4096])
def test_periodic_texts_and_hot_segments_match_brute_force(spark, monkeypatch, window, most):
    monkeypatch.setattr(split_join, "HOT_ROWS", most)
    rows = low_entropy()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_merge.remove_repeats(docs, window).collect()}
    assert got == byte_brute(rows, window)


def test_a_long_run_of_one_letter_is_a_few_rows(spark):
    work = anchors.with_order(spark.createDataFrame([(1, "a" * 2_000_000), (2, "ab" * 500_000)], "doc_id long, text string"))
    found = anchors.joined_segments(work, 400, 64, False).collect()
    assert len(found) < 20 and sum(r.n * r.times for r in found) == 2_000_000 + 1_000_000 - 2 * 399
    spans = suffix_merge.repeated_spans(work).collect()
    assert len(spans) < 20
    (first, second) = sorted(suffix_merge.remove_repeats(spark.createDataFrame([(1, "a" * 2_000_000), (2, "ab" * 500_000)], "doc_id long, text string")).collect())
    assert first.n_removed == 2_000_000 and second.n_removed == 1_000_000 and first.n_spans == 1
