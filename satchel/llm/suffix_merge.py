"""Byte-level substring dedup by merging Burrows-Wheeler transforms of shards.

Texts are cut into segments around anchors (see anchors.py), so that equal windows of ``window`` bytes meet in one task
wherever they come from. There the segments are split into shards. Each shard gets its Burrows-Wheeler transform; the
transforms alone are then merged: the interleave of the shards' sorted suffixes starts as blocks of equal first symbols
and is refined round by round, each round doubling the depth to which it is settled by stepping along the transforms' own
next-suffix mapping. In a block the suffixes of each shard are in order already, so that a round merges sorted runs and
sorts no suffixes again. Texts are not read again, and a block of one suffix takes no part in later rounds. Where a block
parts, its neighbours' common prefix is known to be shorter than the round's depth; neighbours that have not parted at
depth ``window`` have that much in common, which gives the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.anchors import Segments, bit_filter, joined_segments, merge_spans, with_order
from satchel.llm.split_join import spread_join, with_spans
from satchel.llm.store import broadcast, materialize
from satchel.llm.text import byte_values, chunks, mix, window_hashes

WINDOW = 400
GRAM = 64
#: Bytes of a shard, and of the shards that are merged together (cut between anchors).
SHARD_BYTES = 1 << 18
GROUP_BYTES = 1 << 20
#: Anchors with more distinct segments than this are compared window by window in a shuffle instead of in one task.
HOT_SEGMENTS = 2048


#: Symbols that the first round compares: seven of nine bits in one number.
FIRST = 7


def _start(keys: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key (the number of lesser keys) and the rows in blocks of several. kind: "stable" merges sorted runs."""
    order = np.argsort(keys, kind=kind)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.flatnonzero(new)
    block = np.empty(len(keys), np.int64)
    size = np.diff(np.concatenate((first, [len(keys)])))
    block[order] = np.repeat(first, size)
    return block, order[np.repeat(size > 1, size)]


def _refine(block: np.ndarray, active: np.ndarray, ahead: np.ndarray, kind: str | None = None) -> np.ndarray:
    """Splits blocks in place by what lies ahead of their rows; returns the rows in blocks of several. Blocks keep their
    place: a part's number is the number of rows before it. kind: as for _start()."""
    if not len(active):
        return active
    keys = block[active] << 32 | ahead
    order = np.argsort(keys, kind=kind)
    active, keys = active[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((first, [len(keys)])))
    old = keys >> 32
    of_old = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
    begin = np.repeat(of_old, np.diff(np.concatenate((of_old, [len(old)]))))
    block[active] = old + np.repeat(first, size) - begin
    return active[np.repeat(size > 1, size)]


class Shard:
    """The Burrows-Wheeler transform of some segments.

    Each segment ends in a terminator that is less than every byte; terminators are ordered as their segments are.
    bwt: the symbol before each suffix in sorted order (0 for a terminator). place: where each suffix begins in the
    joined text.
    """

    def __init__(self, pieces: list[bytes]):
        order = sorted(range(len(pieces)), key=pieces.__getitem__)
        joined = b"".join(pieces[i] + b"\0" for i in order)
        lengths = np.array([len(pieces[i]) + 1 for i in order], np.int64)
        ends = np.cumsum(lengths)
        text = np.frombuffer(joined, np.uint8).astype(np.int64) + 1
        text[ends - 1] = 0
        n = len(text)
        padded = np.concatenate((text, np.zeros(FIRST, np.int64)))
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(FIRST):  # after a terminator nothing counts
            key = key << 9 | np.where(open_, padded[k : k + n], 0)
            open_ &= padded[k : k + n] > 0
        number = np.repeat(np.arange(len(lengths)), lengths)
        left = np.repeat(ends, lengths) - np.arange(n)
        rank, active = _start(key)
        depth = FIRST
        while len(active):
            # suffixes past their terminator tie only with equal ones, which the order of their segments settles
            ahead = np.where(left[active] <= depth, number[active], rank[np.minimum(active + depth, n - 1)])
            active = _refine(rank, active, ahead)
            depth *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        starts = np.repeat(ends - lengths, lengths)
        self.bwt = np.where(suffixes == starts[suffixes], 0, text[np.maximum(suffixes - 1, 0)]).astype(np.int16)
        self.place, self.order, self.lengths = suffixes, order, lengths

    def next_suffix(self) -> np.ndarray:
        """For each sorted suffix the one that starts a symbol later, from the transform alone."""
        return np.argsort(self.bwt, kind="stable")


def merge(shards: list[Shard], window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per shard and sorted suffix, the place in the merged order where its block at depth ``window`` begins, and per place a
    depth at which its suffix and the one before it differ; 0 if they have ``window`` symbols in common."""
    sizes = np.array([len(s.bwt) for s in shards])
    shift = np.repeat(np.cumsum(sizes) - sizes, sizes)
    step = np.concatenate([s.next_suffix() for s in shards]) + shift
    symbol = np.concatenate([np.sort(s.bwt) for s in shards]).astype(np.int64)  # first symbols of the sorted suffixes
    ended = symbol == 0
    step[ended] = np.flatnonzero(ended)  # a suffix does not go on past its terminator
    depth = min(FIRST, window)
    key, jump = symbol, np.arange(len(step))
    for _ in range(depth - 1):
        jump = step[jump]
        key = key << 9 | symbol[jump]
    jumps = [(1, step), (depth, step[jump])]
    block, active = _start(key, "stable")
    parted = np.zeros(len(step), np.int32)
    parted[block] = depth

    def refine(active: np.ndarray, ahead: np.ndarray, depth: int) -> np.ndarray:
        rest = _refine(block, active, ahead, "stable")
        new = block[active]
        parted[new[parted[new] == 0]] = depth
        return rest

    while 2 * depth <= window:
        jump = jumps[-1][1]
        depth *= 2
        active = refine(active, block[jump[active]], depth)
        jumps.append((depth, jump[jump]))
    if depth < window:  # the last blocks of both ends of the window settle it
        ahead, rest = active, window - depth
        for d, jump in reversed(jumps):
            while d <= rest:
                ahead, rest = jump[ahead], rest - d
        refine(active, block[ahead], window)
    return np.split(block, np.cumsum(sizes)[:-1]), parted


def repeated_windows(pieces: list[bytes], copies: list[int], window: int) -> list[np.ndarray]:
    """For each piece the starts of its windows that also start elsewhere; a suffix counts once for each copy of its piece."""
    shards, members, part, size = [], [], [], 0
    for i, piece in enumerate(pieces):
        part.append(i)
        size += len(piece)
        if size >= SHARD_BYTES:
            members.append(part)
            part, size = [], 0
    if part:
        members.append(part)
    shards = [Shard([pieces[i] for i in m]) for m in members]
    blocks, parted = merge(shards, window)
    spots, owners, found = [], [], []
    for shard, member, block in zip(shards, members, blocks):
        ends = np.cumsum(shard.lengths)
        number = np.searchsorted(ends, shard.place, "right")
        start = shard.place - (ends - shard.lengths)[number]
        whole = start + window < shard.lengths[number]
        spots.append(start[whole])
        owners.append(np.array([member[i] for i in shard.order])[number[whole]])
        found.append(block[whole])
    spot, owner, block = np.concatenate(spots), np.concatenate(owners), np.concatenate(found)
    # an interval of the merged order goes on until its suffixes part
    intervals = np.flatnonzero(parted)
    interval = np.searchsorted(intervals, block)
    hit = np.bincount(interval, np.minimum(copies, 2)[owner], len(intervals))[interval] > 1
    spot, owner = spot[hit], owner[hit]
    order = np.lexsort((spot, owner))
    spot, owner = spot[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [np.unique(spot[bounds[i] : bounds[i + 1]]) for i in range(len(pieces))]


def _runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    lo, hi = merge_spans(starts, starts + window)
    return list(zip(lo.tolist(), hi.tolist()))


def segment_bytes(work: DataFrame, anchors: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor``, ``content``, ``piece`` (its bytes) and ``copies`` of the distinct segments of the given anchors."""
    wanted = broadcast(work.sparkSession, bit_filter(anchors, "anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                s = Segments(byte_values(chunk.data), chunk.offsets, window, gram)
                hit = np.flatnonzero(wanted.value.test(s.anchor)) if len(s.start) else []
                if len(hit):
                    content, at, n = np.unique(s.content[hit], return_index=True, return_counts=True)
                    hit = hit[at]
                    raw = chunk.data.tobytes()
                    stop = s.start + s.n - 1 + window
                    pieces = [raw[s.start[i] : stop[i]] for i in hit]
                    yield pa.RecordBatch.from_arrays([pa.array(s.anchor[hit].view(np.int64)), pa.array(content.view(np.int64)), pa.array(pieces, pa.binary()), pa.array(n.astype(np.int64))], names=["anchor", "content", "piece", "copies"])

    found = work.mapInArrow(run, "anchor long, content long, piece binary, copies long")
    distinct = found.groupBy("anchor", "content").agg(F.first("piece").alias("piece"), F.sum("copies").alias("copies"))
    return distinct.join(anchors, "anchor", "left_semi")


def _merged_spans(pieces: DataFrame, window: int) -> DataFrame:
    """Spans (anchor, content, from, to) of repeated windows inside distinct segments, an anchor's segments in one task."""

    def solve(part: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        found = repeated_windows([p for _, _, p, _ in part], [c for _, _, _, c in part], window)
        rows = [(a, g, lo, hi, n) for (a, g, _, n), starts in zip(part, found) for lo, hi in _runs(starts, window)]
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "content", "lo", "hi", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple[int, int, bytes, int]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "piece", "copies"))):
                if size >= GROUP_BYTES and row[0] != part[-1][0]:
                    yield solve(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[2])
        if part:
            yield solve(part)

    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "content", "piece", "copies").mapInArrow(run, "anchor long, content long, lo long, hi long, copies long")


def _hot_spans(pieces: DataFrame, window: int) -> DataFrame:
    """The same for anchors of very many segments: window hashes are counted in a shuffle that combines on the map side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, piece, copies in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "piece", "copies"))):
                values = byte_values(np.frombuffer(piece, np.uint8))
                marks, checks = window_hashes(values, window), window_hashes(mix(values), window)
                n = len(marks)
                columns = [np.full(n, anchor), np.full(n, content), np.arange(n), marks.view(np.int64), checks.view(np.int64), np.full(n, copies)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "lo", "mark", "check", "copies"])

    rows = pieces.select("anchor", "content", "piece", "copies").mapInArrow(run, "anchor long, content long, lo long, mark long, check long, copies long")
    rows = materialize(rows, "hot-windows")
    often = rows.groupBy("mark", "check").agg(F.sum("copies").alias("all")).where(F.col("all") > 1)
    return rows.join(often, ["mark", "check"], "left_semi").select("anchor", "content", "lo", (F.col("lo") + window).alias("hi"), "copies")


def repeated_spans(work: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT_SEGMENTS) -> DataFrame:
    """ord, th, start, stop: bytes of with_order() texts covered by windows that also start elsewhere."""
    found = materialize(joined_segments(work, window, gram, False), "segments")
    again = found.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    again = materialize(again, "anchors")
    pieces = materialize(segment_bytes(work, again, window, gram), "pieces")
    many = materialize(pieces.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "hot-anchors")
    spans = _merged_spans(pieces.join(many, "anchor", "left_anti"), window)
    spans = materialize(spans.unionByName(_hot_spans(pieces.join(many, "anchor", "left_semi"), window)), "piece-spans")
    of_segment = spans.groupBy("anchor", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"), F.max("copies").alias("copies"))
    placed = spread_join(found, of_segment, ["anchor", "content"], "copies")
    placed = placed.select("ord", "th", "start", "n", "times", F.explode("spans").alias("s"))
    # all windows of a segment that follows itself come again, so that its spans touch those of the next
    start, stop = F.col("start") + F.col("s.lo"), F.col("start") + (F.col("times") - 1) * F.col("n") + F.col("s.hi")
    return placed.select("ord", "th", start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def _digests(base: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py().encode() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "ord", "th")), pa.array([len(t) for t in raw], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string())], names=[key, "ord", "th", "n_bytes", "all_sha256"])

    return base.mapInArrow(run, f"{key} {base.schema[key].dataType.simpleString()}, ord long, th long, n_bytes long, all_sha256 string")


def _kept(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans_, digest = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw = text.as_py().encode()
                starts, ends = merge_spans(*(np.array([s[c] for s in spans], np.int64) for c in ("start", "stop")))
                own, at = hashlib.sha256(), 0
                for lo, hi in zip(starts.tolist(), ends.tolist()):
                    own.update(raw[at:lo])
                    at = hi
                own.update(raw[at:])
                removed.append(int((ends - starts).sum()))
                spans_.append(len(starts))
                digest.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest, pa.string())], names=["ord", "th", "removed", "spans", "sha256"])

    return texts.mapInArrow(run, "ord long, th long, removed long, spans long, sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", hot: int = HOT_SEGMENTS) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each row, after its repeated bytes went.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else, in the same text or another.
    Strings are judged on the input; removed runs that touch are one span. Null counts as empty. Rows that are wholly
    equal are copies of each other, and lose all their bytes if there are ``window`` of them. Anchors with more than ``hot``
    distinct segments are solved by counts of window hashes, with the same result. No rows give no rows.
    """
    work = with_order(docs, key, text)
    spans = materialize(repeated_spans(work, window, min(gram, window), hot), "spans")
    base = docs.select(F.col(key), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = _kept(with_spans(work, spans)).dropDuplicates(["ord", "th"])
    out = _digests(base, key).join(cut, ["ord", "th"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{c}")
    return out.select(key, "n_bytes", zero("removed"), zero("spans"), F.coalesce("sha256", "all_sha256").alias("kept_sha256"))
