"""Words with offsets, and located patterns against the column expressions."""

import random

import pytest

from satchel.operators import keywords as K
from satchel.operators import patterns as P


@pytest.mark.parametrize("plain", [False, True])
def test_hits_equal_search_of_each_word(monkeypatch, plain):
    if plain:
        monkeypatch.setattr(K, "ahocorasick", None)
    r = random.Random(1)
    words = ("ab", "abc", "b", "É", "a b", "ab")
    found = K.Words(words)
    for _ in range(50):
        text = "".join(r.choice("abcAé İ") for _ in range(40))
        low = K.lowered(text)
        assert len(low) == len(text)
        want = sorted((i, found.number[w]) for w in found.words for i in range(len(low)) if low.startswith(w, i))
        assert found.hits(low) == want


def test_spans_are_bytes(spark):
    rows = [(1, "é The thé the", "x"), (2, None, "y"), (3, "THE", "z")]
    got = [tuple(r) for r in K.spans(spark.createDataFrame(rows, "id long, text string, word string").drop("word"), ("the", "É")).orderBy("id", "start").collect()]
    assert got == [(1, "é", 0, 2), (1, "the", 3, 6), (1, "é", 9, 11), (1, "the", 12, 15), (3, "the", 0, 3)]
    for i, w, a, b in got:
        assert dict((i, t) for i, t, _ in rows)[i].encode()[a:b].decode().lower() == w


def test_located_equals_expressions(spark):
    r = random.Random(6)
    bits = ["due by 1/2/2026", "deadline: Jan 5", "project deadline", "task", "action", "urgent", "ASAP", "not urgent", "Assigned to: @ann", "from", "\n1. Ship it ", "[Blue Sky]", "for the big red project", "meeting with bob on 2026-01-05", "need", "é", "x" * 45, "critical", "low priority", "call 1/2/2026"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = K.located(docs).collect()
    want = sorted((x.id, x.pattern, x.entity, x.value, x.confidence, x.requires_review) for x in P.matches(docs).collect())
    assert sorted((x.id, x.pattern, x.entity, x.value, x.confidence, x.requires_review) for x in found) == want and len(want) > 300
    texts = dict(rows)
    for x in found:
        assert x.value.lower() in texts[x.id].encode()[x.start : x.stop].decode().lower() and texts[x.id].encode()[x.start : x.stop].decode() in x.evidence
    assert {x.entity for x in K.located(docs, entities=("project",)).collect()} == {"project"}
    few = K.located(docs, max_results=1, min_confidence=0.8).collect()
    assert len(few) == len({x.id for x in few}) and min(x.confidence for x in few) >= 0.8
