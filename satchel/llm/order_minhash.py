"""Order MinHash: fingerprints whose likeness follows the edit distance of texts, not only the grams that they share.

The k-mers of a text (``gram`` code points) are numbered by occurrence, so that the second "abc" is another item than the
first. Each of ``size`` functions orders these items anew; the ``picks`` least are put back into text order, and the hash of
that tuple of k-mers is one component. Two texts agree in a component only if they share the chosen k-mers in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.text import mix, window_hashes

GRAM, PICKS, SIZE = 5, 2, 32
#: Code points that are worked on together, unless a text has more.
BLOCK = 1 << 16
#: Items of a text that are looked at for each function, on average.
EXPECTED = 16
_LOW, _NONE = np.uint64((1 << 32) - 1), np.uint64((1 << 64) - 1)
_AGAIN, _CHAIN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)
#: Fills texts of fewer code points than a k-mer; no valid text holds it.
_FILL = "\udfff"


def factors(size: int) -> np.ndarray:
    """Odd multipliers: each orders mixed 32-bit items by the product modulo 2**32."""
    return np.random.default_rng(11).integers(1, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def occurrences(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many equal k-mers come before each in its text."""
    n = len(grams)
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = mix(grams + text.astype(np.uint64) * _AGAIN) & ~low | np.arange(n, dtype=np.uint64)
    keys.sort()
    at = (keys & low).astype(np.int64)
    same = (keys[1:] >> bits) == (keys[:-1] >> bits)
    exact = (grams[at[1:]] == grams[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    if (same & ~exact).any():  # shortened keys met: sort by the whole ones
        at = np.lexsort((grams, text))
        same = (grams[at[1:]] == grams[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    begin = np.arange(n)
    begin[1:][same] = 0
    out = np.empty(n, np.uint64)
    out[at] = np.arange(n) - np.maximum.accumulate(begin)
    return out


def items(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """32 bits for each k-mer with its number of occurrence."""
    return (mix(grams + occurrences(grams, text) * _CHAIN) >> np.uint64(32)).astype(np.uint32)


def _least(ids: np.ndarray, starts: np.ndarray, n: np.ndarray, below: np.ndarray, factor: np.uint32, picks: int, buffer: np.ndarray) -> np.ndarray:
    """Positions of the ``picks`` least items of each text, of equal ones the first; -1 where there are fewer.

    Only products up to ``below`` are looked at, which about EXPECTED items of a text keep to; texts with fewer than
    ``picks`` of them are sorted."""
    v = np.multiply(ids, factor, out=buffer)
    some = np.flatnonzero(v <= below)
    first = np.searchsorted(some, starts)
    count = np.diff(first, append=len(some))
    few = np.flatnonzero(count < np.minimum(picks, n))
    if len(few):
        own = [starts[t] + np.argsort(v[starts[t] : starts[t] + n[t]], kind="stable")[:picks] for t in few]
        some = np.union1d(some, np.concatenate(own))
        first = np.searchsorted(some, starts)
    left = v[some].astype(np.uint64) << np.uint64(32) | np.arange(len(some), dtype=np.uint64)
    out = np.empty((picks, len(starts)), np.int64)
    for i in range(picks):
        least = np.minimum.reduceat(left, first)
        at = (least & _LOW).astype(np.int64)
        there = least != _NONE
        if there.all():
            out[i], left[at] = some[at], _NONE
        else:
            out[i] = np.where(there, some[np.where(there, at, 0)], -1)
            left[at[there]] = _NONE
    return out


def _block(texts: list[str], size: int, picks: int, gram: int) -> np.ndarray:
    lengths = np.maximum([len(t) for t in texts], gram)
    points = np.frombuffer("".join(t.ljust(gram, _FILL) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = lengths - gram + 1
    starts = np.cumsum(n) - n
    inside = np.arange(n.sum()) + np.repeat(np.cumsum(lengths) - lengths - starts, n)
    grams = window_hashes(mix(points.astype(np.uint64) + np.uint64(0x2545F491)), gram)[inside]
    ids = items(grams, np.repeat(np.arange(len(texts)), n))
    buffer = np.empty(len(ids), np.uint32)
    below = np.repeat(np.minimum(EXPECTED * (1 << 32) // n, (1 << 32) - 1).astype(np.uint32), n)
    out = np.empty((len(texts), size), np.uint32)
    for i, factor in enumerate(factors(size)):
        at = _least(ids, starts, n, below, factor, picks, buffer)
        at.sort(axis=0)
        h = np.zeros(len(texts), np.uint64)
        for row in at:
            h = mix(h * _CHAIN + np.where(row < 0, np.uint64(1), grams[row]))
        out[:, i] = h >> np.uint64(32)
    return out


def fingerprints(texts: list[str], size: int = SIZE, picks: int = PICKS, gram: int = GRAM) -> np.ndarray:
    """One row of ``size`` components for each text. A text of fewer code points than ``gram`` is one k-mer; empty texts are
    alike. A text needs some 60 bytes of memory a code point."""
    out, lo = [np.empty((0, size), np.uint32)], 0
    while lo < len(texts):
        hi, total = lo + 1, max(gram, len(texts[lo]))
        while hi < len(texts) and total + max(gram, len(texts[hi])) <= BLOCK:
            total += max(gram, len(texts[hi]))
            hi += 1
        out.append(_block(texts[lo:hi], size, picks, gram))
        lo = hi
    return np.concatenate(out)


def shown(fingerprint: np.ndarray) -> str:
    """Eight hex digits a component."""
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of equal components of two fingerprints."""
    part = lambda c, i: F.substring(c, i * 8 + F.lit(1), F.lit(8))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: part(a, i) == part(b, i))) / F.lit(float(size))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, picks: int = PICKS, gram: int = GRAM) -> DataFrame:
    """``key`` and ``fingerprint`` of each row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column(1).to_pylist(), size, picks, gram)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(shown, found), pa.string())], names=[key, "fingerprint"])

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


#: Ranges of keys for each shuffle partition, and different rows of a task that are watched for repeats.
RANGES, WATCHED = 4, 1 << 16


def _rank(key: object, th: int) -> tuple:
    """Ascending order of keys, null first, and of texts by hash."""
    return (key is not None, 0 if key is None else key, th)


def with_successors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in ranges of keys, sorted downwards inside each, with a guest at each range's end: the row that comes next.

    The ranges' greatest rows, a few for each shuffle partition, are all that the driver sees. A task sends the text of
    repeated rows (same key and text) once and their number ``n`` at its end, so that they load no range. Texts are
    shuffled once."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tops = rows.select("key", "th").repartitionByRange(ranges, "key", "th").groupBy(F.spark_partition_id()).agg(F.max(F.struct("key", "th")).alias("top"))
    tops = sorted(_rank(r.top.key, r.top.th) for r in tops.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[tuple, int] = {}

        def sent(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.bool_(), kind, pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "guest", "key", "th", "text", "n"])

        def counts() -> pa.RecordBatch:
            out = [(bisect_left(tops, _rank(k, th)), False, k, th, None, n) for (k, th), n in again.items() if n]
            again.clear()
            return sent(out)

        kind = pa.null()
        for batch in batches:
            kind, out = batch.column(0).type, []
            for k, th, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k, th) in again:
                    again[k, th] += 1
                    continue
                again[k, th] = 0
                rank = _rank(k, th)
                at = bisect_left(tops, rank)
                out.append((at, False, k, th, t, 1))
                if rank == tops[at]:
                    out.append(((at + 1) % len(tops), True, k, th, t, 0))
            yield sent(out)
            if len(again) > WATCHED:
                yield counts()
        if again:
            yield counts()

    dealt = rows.mapInArrow(run, f"range long, guest boolean, key {docs.schema[key].dataType.simpleString()}, th long, text string, n long")
    return dealt.repartition("range").sortWithinPartitions("range", "guest", F.col("key").desc_nulls_last(), F.col("th").desc(), F.col("text").isNull())


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, picks: int = PICKS, gram: int = GRAM) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third (rounded down) is replaced by the first as many
    code points, or all, of the next document by descending key; the first follows the last.

    ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (shares of equal components).
    Null texts are empty. Null keys come last. Rows of one key are in the order of their texts' hashes; rows equal in key
    and text are one document, and each gets its row. A lone document is its own next. Other columns are not read. No rows
    give no rows."""
    kind = docs.schema[key].dataType.simpleString()

    def results(line: list[list], key_type: pa.DataType) -> pa.RecordBatch:
        """Of all documents of a line but the last, each with its key, text and copies."""
        own = [t for _, t, _ in line]
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(own, own[1:])]
        found = fingerprints(own + edited, size, picks, gram)
        prints, changed = found[: len(own)], found[len(own) :]
        columns = [pa.array([k for k, _, _ in line[:-1]], key_type), pa.array(map(len, own[:-1]), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string())]
        columns += [pa.array(map(shown, x), pa.string()) for x in (prints[:-1], changed)]
        columns += [pa.array((prints[:-1] == x).mean(1) if len(edited) else [], pa.float64()) for x in (changed, prints[1:])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n for _, _, n in line[:-1]], pa.int64())], names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, last, held = [], None, 0
        for batch in batches:
            for place, guest, k, th, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (place, guest, k, th) == last:
                    if line:
                        line[-1][2] += n
                    continue
                if held > 8 * BLOCK and not guest:
                    yield results(line, batch.column(2).type)
                    line, held = line[-1:], len(line[-1][1])
                line.append([k, t, n])
                last, held = (place, guest, k, th), held + len(t)
                if guest:
                    yield results(line, batch.column(2).type)
                    line, held = [], 0

    found = with_successors(docs, key, text).mapInArrow(run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long")
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
