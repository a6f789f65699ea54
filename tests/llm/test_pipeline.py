import base64
import hashlib
import random

import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from satchel.llm import line_dedup, quality_rules, simhash


def test_stages_and_result(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        new = corpus_pipeline.materialize(found, "test", corpus_pipeline.new_path(spark, "test"))
        assert new.columns == corpus_pipeline.COLUMNS and new.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        if name == "quality rules":
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in quality_rules.rules(docs).where("kept").collect()}
        docs = new
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in __spark_entry__.queries()["pipeline"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.ids == oracle.encode_ordinary(texts[i]) and r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_near_copies_go_and_similar_enough_is_verified(spark):
    base = [f"word{i}" for i in range(300)]
    one_edit = [*base[:150], "edit", *base[151:]]
    rows = [(1, " ".join(base)), (2, " ".join(one_edit)), (3, " ".join(base)), (4, " ".join(f"other{i}" for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 4]
    assert sorted((r.doc_id, r.of) for r in simhash.copies(docs).collect()) == [(2, 1), (3, 1)]


def test_copies_of_a_row_that_is_no_copy_of_its_groups_least_row_go(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    far = None
    while far is None:
        one = [r.choice(words) for _ in range(200)]
        two = [f"edit{i}" if r.random() < 0.03 else w for i, w in enumerate(one)]
        near = (simhash.fingerprint(" ".join(one).encode(), 5) ^ simhash.fingerprint(" ".join(two).encode(), 5)).bit_count() <= 7
        far = " ".join(two) if near and simhash._pair_similarity(" ".join(one), " ".join(two), 5) < 0.8 else None
    docs = spark.createDataFrame([(1, " ".join(one)), (2, far), (3, far.upper()), (4, far)], "doc_id long, text string")
    assert sorted((x.doc_id, x.of) for x in simhash.copies(docs).collect()) == [(3, 2), (4, 2)]


def test_lines_that_repeat_go_with_documents_they_leave_empty(spark):
    line = "a line of more than five words"
    docs = spark.createDataFrame([(1, line, "en", "s", 30), (2, line, "en", "s", 30), (3, "", "en", "s", 0), (4, f"new words in this line here\n{line}", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: (line, 30), 3: ("", 0), 4: ("new words in this line here", 27)}
    assert line_dedup.remove_later(docs).count() == 4


def test_short_lines_that_repeat_go(spark):
    docs = spark.createDataFrame([(1, "Read  more\n\nown words\n\nread more", "en", "s", 1), (2, "Read more\n\nother words\n日本語の一行", "en", "s", 1), (3, "日本語の一行\nRead more", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: "Read  more\n\nown words\n\nread more", 2: "\nother words\n日本語の一行"}


def test_no_two_near_copies_stay_and_each_that_goes_has_an_earlier_one(spark):
    """Against brute force, on texts whose similarity is around the bound, where fingerprints find half."""
    r = random.Random(9)
    rows = []
    for group in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([6, 40, 150, 300]))]
        for copy in range(r.randint(1, 6)):
            own = [x if r.random() > (0, 0.005, 0.01, 0.02, 0.03, 0.04)[copy] else f"e{r.randrange(9999)}" for x in base]
            rows.append((len(rows) * 7 % 1009, "\n".join([" ".join(own[:20]), " ".join(own[20:])]).title() if copy % 2 else " ".join(own)))
    shingles = {}
    for i, t in rows:
        w = t.lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    similar = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (5000, None), (5001, "")], "doc_id long, text string").repartition(4)
    kept = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert {None, 5000, 5001} <= kept
    kept = sorted(i for i in kept if i in shingles)
    assert not [(a, b) for a in kept for b in kept if a < b and similar(a, b)]
    assert all(any(b < a and similar(a, b) for b in shingles) for a in set(shingles) - set(kept))
    assert len(kept) < len(rows) - 40


def test_stages_against_brute_force_and_odd_rows(spark, tmp_path):
    """Line dedup and near copies of the stages by plain rules; empty tables, null keys, clashing names."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string, ord long"
    r = random.Random(10)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    shared = say(12)
    rows = [(i, "\n".join([say(70), shared, say(30)]), "en", "s", 1, "x", 2) for i in range(8)]
    rows += [(None, say(80), None, None, None, "x", 1), (20, None, "en", "s", 0, None, None), (21, rows[3][1], "en", "s", 1, "x", 2)]
    docs = spark.createDataFrame(rows, columns)
    spark.createDataFrame([(1, say(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, now, str(tmp_path))
            assert found.columns == corpus_pipeline.COLUMNS
            now = corpus_pipeline.materialize(found, "test", corpus_pipeline.new_path(spark, "test"))
        texts = {x.doc_id: x.text for x in now.collect()}
        if table is docs:
            assert set(texts) == {*range(8), None}
            assert texts[0] == rows[0][1] and all(shared not in texts[i] for i in range(1, 8))
        else:
            assert texts == {}
