"""Segments of texts around anchors: the means by which equal windows of different documents meet.

Every window of ``window`` units (bytes or words) has an anchor: the gram of ``gram`` units in it with the least hash.
Equal windows have equal anchors at equal offsets, so windows need to be compared only with windows of the same anchor.
Neighbouring windows that share an anchor form a segment. There are about ``2 / (window - gram + 2)`` segments a unit,
so the rows that are shuffled are far fewer than the windows, and none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.text import Chunk, byte_values, chunks, mix, prefix_sums, slice_hashes, sliding_min_position, window_hashes

#: Sorts after every other id.
LAST = (1 << 63) - 1
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a filter that is broadcast: 64 KB to 32 MB; beyond, more values pass it that are not in it.
FILTER_BITS = (19, 28)


def with_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``ord`` (the key; null sorts last), ``th`` (a hash of the text, which tells rows with equal keys apart) and ``text``."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def units(chunk: Chunk, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Hash value of each unit, where each text's units begin, and for words their start and end bytes."""
    if not words:
        return byte_values(chunk.data), chunk.offsets, None, None
    starts, ends, first = chunk.words()
    return slice_hashes(prefix_sums(byte_values(chunk.data)), starts, ends), first, starts, ends


class Segments:
    """The segments of a chunk: text number, first window's unit, number of windows, anchor hash, content hash."""

    def __init__(self, values: np.ndarray, first: np.ndarray, window: int, gram: int):
        empty = np.empty(0, np.int64)
        self.text = self.start = self.n = empty
        self.anchor = self.content = np.empty(0, np.uint64)
        if len(values) < window:
            return
        grams = window_hashes(values, gram)
        at = sliding_min_position(grams, window - gram + 1)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
        valid = np.arange(len(at)) + window <= first[1:][text]  # inside one text
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        if not len(begin):
            return
        last = np.maximum.reduceat(np.where(valid, np.arange(len(at)), -1), begin)
        self.text, self.start, self.n = text[begin], begin, last - begin + 1
        self.anchor = grams[at[begin]]
        self.content = slice_hashes(prefix_sums(mix(values ^ _SECOND)), begin, last + window)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of each run of equal segments that follow one another, as periodic texts give one for each period, and
        their number."""
        if not len(self.start):
            return self.start, self.n
        again = np.zeros(len(self.start), bool)
        again[1:] = (self.start[1:] == self.start[:-1] + self.n[:-1]) & (self.text[1:] == self.text[:-1])
        for c in (self.n, self.anchor, self.content):
            again[1:] &= c[1:] == c[:-1]
        first = np.flatnonzero(~again)
        return first, np.diff(first, append=len(again))


SCHEMA = "ord long, th long, start int, n int, anchor long, content long"


def joined_segments(work: DataFrame, window: int, gram: int, words: bool) -> DataFrame:
    """All segments of the texts of with_order(); ``start`` counts units from the text's begin. Equal segments that follow one
    another are one row, ``times`` of them, each ``n`` units after the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, th = (batch.column(c).to_numpy() for c in ("ord", "th"))
            for chunk in chunks(batch.column("text")):
                values, first, _, _ = units(chunk, words)
                s = Segments(values, first, window, gram)
                at, times = s.rows()
                if len(at):
                    rows = chunk.lo + s.text[at]
                    columns = [order[rows], th[rows], (s.start[at] - first[s.text[at]]).astype(np.int32), s.n[at].astype(np.int32), s.anchor[at].view(np.int64), s.content[at].view(np.int64), times.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ord", "th", "start", "n", "anchor", "content", "times"])

    return work.mapInArrow(run, f"{SCHEMA}, times long")


class BitFilter:
    """A bitmap of hashed values, of bounded size: values that it lacks are surely absent."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def slots(values: np.ndarray, bits: int) -> np.ndarray:
        return (mix(values.view(np.uint64).copy()) >> np.uint64(64 - bits)).astype(np.int64)

    def test(self, values: np.ndarray) -> np.ndarray:
        at = self.slots(values, self.bits)
        return (self.words[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


PIECE = 1 << 16


def bit_filter(values: DataFrame, column: str, each: int = 16) -> BitFilter:
    """A filter of all values of a long column. Tasks set bits in pieces of 64 KB, which are united piece by piece, so
    that the driver gets no more than the bitmap's fixed size. each: bits for each value, as far as FILTER_BITS allows."""
    n = values.count()
    bits = int(np.clip((each * n).bit_length(), *FILTER_BITS))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = BitFilter.slots(batch.column(0).to_numpy(), bits)
            at.sort()
            byte, first, _ = _runs(at >> 3)
            value = np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)
            for piece, lo, hi in zip(*_runs(byte >> 16)):
                own = pieces.setdefault(int(piece), np.zeros(PIECE, np.uint8))
                own[byte[lo:hi] & PIECE - 1] |= value[lo:hi]
        for piece, own in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([own.tobytes()], pa.binary())], names=["piece", "set"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(found, np.uint8)
                pieces[piece] = pieces[piece] | own if piece in pieces else own
        for piece, own in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([own.tobytes()], pa.binary())], names=["piece", "set"])

    words = np.zeros(1 << bits - 3, np.uint8)
    if n:
        compact = values.select(column).coalesce(max(1, min(64, n >> 16)))  # few tasks, as each may set bits in every piece
        for row in compact.mapInArrow(local, "piece long, set binary").repartition("piece").mapInArrow(unite, "piece long, set binary").collect():
            words[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(row.set, np.uint8)
    return BitFilter(bits, words)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return values[at], at, np.concatenate((at[1:], [len(values)]))


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans; spans that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    at = np.flatnonzero(new)
    return starts[at], ends[np.concatenate((at[1:] - 1, [len(ends) - 1]))]
