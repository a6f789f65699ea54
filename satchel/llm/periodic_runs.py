"""Runs of repeating words (maximal stretches with a period), found by power-of-two naming.

Names stand for equal substrings: level 0 names words, level l + 1 pairs of names of level l that lie 2**l words apart, so
that two stretches of 2**l words are equal if their names are. The longest common extension of two positions is read off
by descending levels. A run of period q that is long enough holds two neighbouring points of the grid 0, q, 2q, ..., whose
names agree; such pairs, about n log n of them, are extended both ways. There are no hashes of stretches and no suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.text import chunks

WORDS = r"([^\x20\x09-\x0D]+)"
#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Pairs of grid points that are looked at together.
PAIRS = 1 << 18


def _named(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


class Names:
    """Names of all stretches of 2**l words of some texts that lie one after another; ``end`` is where a word's text ends."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.end = np.repeat(np.cumsum(lengths), lengths)
        self.begin = self.end - np.repeat(lengths, lengths)
        self.levels = [_named(words)]

    def grow(self, level: int) -> None:
        """Adds names up to ``level``. A stretch that leaves its text gets a name that nothing asks for."""
        n = len(self.end)
        while len(self.levels) <= level:
            step = 1 << len(self.levels) - 1
            last = self.levels[-1]
            other = np.zeros(n, np.int64)
            other[: max(0, n - step)] = last[step:]
            self.levels.append(_named(last * (n + 1) + other))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on (i < j, of one text)."""
        i, j, end, done = i.copy(), j.copy(), self.end[i], np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[level], 1 << level
            # the highest level may be taken more than once
            while True:
                go = np.flatnonzero(j + step <= end)
                go = go[names[i[go]] == names[j[go]]]
                i[go] += step
                j[go] += step
                done[go] += step
                if level < len(self.levels) - 1 or not len(go):
                    break
        return done

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before i and j (i < j, of one text)."""
        i, j, begin, done = i.copy(), j.copy(), self.begin[i], np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[level], 1 << level
            while True:
                go = np.flatnonzero(i - step >= begin)
                go = go[names[i[go] - step] == names[j[go] - step]]
                i[go] -= step
                j[go] -= step
                done[go] += step
                if level < len(self.levels) - 1 or not len(go):
                    break
        return done


def _grid(n: np.ndarray, begin: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and periods from ``least`` to ``most`` of texts of n words, in portions of about PAIRS."""
    text, q = (x.ravel() for x in np.meshgrid(np.arange(len(n)), np.arange(least, most + 1), indexing="ij"))
    fits = TIMES * q <= n[text]
    text, q = text[fits], q[fits]
    points = (n[text] - 1) // q  # pairs of neighbouring points
    lo = 0
    while lo < len(q):
        total = np.cumsum(points[lo : lo + PAIRS])
        hi = lo + max(1, int(np.searchsorted(total, PAIRS, "right")))
        count = points[lo:hi]
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        each = np.repeat(q[lo:hi], count)
        yield np.repeat(begin[text[lo:hi]], count) + k * each, each
        lo = hi


def runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (in its text), length and smallest period of every run, sorted by text, start and period.

    words: an integer for each word of some texts, one text after another; lengths: words of each."""
    lengths = np.asarray(lengths, np.int64)
    empty = np.empty(0, np.int64)
    none = (empty, empty, empty, empty)
    names = Names(np.asarray(words), lengths)
    # from its first grid point on, a run agrees with itself a period later over least // TIMES + 1 words, or period + 1
    surely = (least // TIMES + 1).bit_length() - 1
    names.grow(surely)
    # a text without two equal stretches of so many words has no run
    at = np.flatnonzero(np.arange(len(names.end)) + (1 << surely) <= names.end)
    text = np.repeat(np.arange(len(lengths)), lengths)
    key = np.sort(text[at] * (len(names.end) + 1) + names.levels[surely][at])
    hold = np.unique(key[1:][key[1:] == key[:-1]] // (len(names.end) + 1))
    if not len(hold):
        return none
    if len(hold) < len(lengths):
        keep = np.zeros(len(lengths), bool)
        keep[hold] = True
        found, *rest = runs(names.levels[0][keep[text]], lengths[hold], least)
        return (hold[found], *rest)
    names.grow(max(surely, int(lengths.max() // 2).bit_length() - 1))
    begin = np.cumsum(lengths) - lengths
    out = [none]
    for level in range(int(lengths.max() // TIMES).bit_length()):
        sure = names.levels[max(level, surely)]
        for i, q in _grid(lengths, begin, 1 << level, min((2 << level) - 1, int(lengths.max()) // TIMES)):
            same = sure[i] == sure[i + q]
            same &= i + q + (1 << max(level, surely)) <= names.end[i]
            i, q = i[same], q[same]
            if not len(i):
                continue
            back = names.behind(i, i + q)
            size = back + q + names.ahead(i, i + q)
            good = size >= np.maximum(least, TIMES * q)
            found = np.unique(np.stack((text[i[good]], i[good] - back[good] - begin[text[i[good]]], size[good], q[good])), axis=1)
            out.append(tuple(found))
    t, s, size, q = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((q, size, s, t))
    t, s, size, q = t[order], s[order], size[order], q[order]
    # a stretch of several periods is met with multiples of its smallest too
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (size[1:] != size[:-1])
    t, s, size, q = t[first], s[first], size[first], q[first]
    order = np.lexsort((q, s, t))
    return t[order], s[order], size[order], q[order]


@dataclass
class Found:
    """What is known of a text: its runs as (start, length, period) and the words that stay."""

    runs: list[tuple[int, int, int]]
    kept: np.ndarray

    def best(self) -> tuple[int, int, int] | None:
        return max(self.runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def examine(texts: list[list[bytes]], least: int = LEAST) -> list[Found]:
    """Runs of each list of words, and which words no run holds after its first period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    found = [Found([], np.ones(n, bool)) for n in lengths]
    if len(ids):
        for t, s, size, q in zip(*(x.tolist() for x in runs(ids, lengths, least))):
            found[t].runs.append((s, size, q))
            found[t].kept[s + q : s + size] = False
    return found


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of every tenth key (by crc32 h of its decimal form) made periodic: with g = h // 10, from word a = g % n on the
    words repeat with the period 1 + (n - a) // (3 + g % 8). Other texts, and those of null keys, stay as they are."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.array(F.regexp_extract_all(F.col(text), F.lit(WORDS), 1))  # bound once, as a lambda's argument
    changed = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, planted(w))), 0)
    return docs.withColumn(text, F.when(h % 10 == 0, F.coalesce(changed, F.col(text))).otherwise(F.col(text)))


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The runs of every text, and the text without what repeats: ``key``; ``runs``, an array of (start, length, period) in
    words; ``kept``, the words that no run holds after its first period, joined by a space; then those of the strongest run,
    null without runs: ``start``, ``length``, ``period``, ``exponent_milli``.

    A run is a maximal stretch with smallest period q, of at least ``least`` words and three periods; the strongest has the
    greatest length / period, of equal ones the first. Words are what lies between spaces and the controls 9 to 13. Null
    and empty texts have no words. Repeated rows and null keys get a row each; other columns are not read. A text needs
    about 8 bytes a word and level of names, of which there are log2 of its words."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_runs long, runs array<struct<start:long,length:long,period:long>>, kept string, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                starts, ends, first = chunk.words()
                data, bounds = chunk.data.tobytes(), list(zip(starts.tolist(), ends.tolist()))
                texts = [[data[a:b] for a, b in bounds[lo:hi]] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
                out = []
                for words, found in zip(texts, examine(texts, least)):
                    kept = b" ".join(w for w, k in zip(words, found.kept.tolist()) if k) if found.runs else b" ".join(words)
                    best = found.best()
                    own = [*best, 1000 * best[1] // best[2]] if best else [None] * 4
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.runs)
                    out.append((len(found.runs), [{"start": s, "length": n, "period": q} for s, n, q in found.runs], kept.decode("utf-8", "replace"), *own, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                kinds = [pa.int64(), pa.list_(item), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[chunk.lo : chunk.hi], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=names)

    names = [key, "n_runs", "runs", "kept", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, schema)
