import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from satchel.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(1)
    odd = ["a" * 700, "x" * 20_000, "".join(r.choice("thean") for _ in range(3000)), "", None, "don't we'll  \n\n x  y", "日本語" * 300, "🎉🎉 👍🏽", " " * 1000, "\x1f\x1c a", "<|endoftext|>"]
    odd += ["".join(r.choice("abé日\x1c\x85 \n'st1２") for _ in range(500)) for _ in range(20)]
    odd += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3100), r.randrange(0x1F300, 0x1F700)])) for _ in range(300)) for _ in range(40)]
    return odd + ["again and again"] * 3


def test_ids_equal_the_tokenizer_library(spark, oracle):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts())], "doc_id long, text string, ids long")
    encoded = bpe.encode(docs, PATH, PATTERN)
    got = {x.doc_id: x.ids for x in encoded.collect()}
    assert got == {i: oracle.encode_ordinary(t or "") for i, t in enumerate(texts())}
    back = {x.doc_id: x.text for x in bpe.decode(encoded, PATH, PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}


def test_digests(spark, oracle):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, n_tokens string")
    for x in bpe.digests(docs, PATH, PATTERN).collect():
        text = texts()[x.doc_id] or ""
        ids = oracle.encode_ordinary(text)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, PATH, PATTERN).collect() == []


def test_pair_table_finds_every_pair():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc"]
    table = bpe.PairTable(tokens)
    import numpy as np

    left, right = np.array([97, 256, 97, 98, 1]), np.array([98, 99, 258, 99, 1])
    assert table.ranks(left, right).tolist() == [256, 257, 257, 258, bpe.NO_RANK]
