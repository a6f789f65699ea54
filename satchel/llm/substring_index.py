"""Substring dedup against a log-structured index of window fingerprints.

The index is a list of immutable runs. A run holds the distinct segments (see anchors.py) of one batch of documents, each
with the first document that has it. What a text repeats of its own goes as it is read, so that a segment is one row a
document at most. A batch's segments meet those of all runs by their anchor in one shuffle. A segment that a run or an
earlier document of the batch holds is removed as it is. Segments that share only their anchor with another differ
somewhere in their context; of each such segment the first document's windows are fingerprinted one by one and compared
in the same way, for which the past documents that hold one first are read again. A match needs the anchor's and the
content's 64-bit hash to agree, from independent hash functions; that is the verification.
Once there are ``fanout`` runs of a level they are compacted into one of the next, which keeps first documents only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satchel.llm.anchors import Segments, bit_filter, chunks, merge_spans, units, with_order
from satchel.llm.split_join import with_spans
from satchel.llm.store import broadcast, drop, materialize, new_path
from satchel.llm.text import mix, window_hashes

WINDOW = 20
GRAM = 5
_WINDOW_SALT = np.uint64(0x165667B19E3779F9)


def _seen(*keys: np.ndarray) -> np.ndarray:
    """Whether all keys of a row equal those of an earlier row."""
    order = np.lexsort(keys)
    again = np.zeros(len(order), bool)
    if len(order) > 1:
        again[order[1:]] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    return again


def _windows(s: Segments, hit: np.ndarray, values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first unit and content hash of all windows of some segments."""
    n = s.n[hit]
    which = np.repeat(np.flatnonzero(hit), n)
    start = s.start[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, start, window_hashes(mix(values ^ _WINDOW_SALT), window)[start]


def distinct_segments(work: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor``, ``content``, ``ord``, ``th`` of the segments of with_order() texts, equal ones of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, th = (batch.column(c).to_numpy() for c in ("ord", "th"))
            for chunk in chunks(batch.column("text")):
                values, first, _, _ = units(chunk, True)
                s = Segments(values, first, window, gram)
                if len(s.start):
                    new = ~_seen(s.content, s.anchor, s.text)
                    rows = chunk.lo + s.text[new]
                    columns = [s.anchor[new].view(np.int64), s.content[new].view(np.int64), order[rows], th[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "ord", "th"])

    return work.mapInArrow(run, "anchor long, content long, ord long, th long")


def candidates(work: DataFrame, again: DataFrame, firsts: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor``, ``mark``, ``ord``, ``th``, ``start``, ``stop``, ``single`` of what may come again, equal ones of a text once: the
    segments whose content is in ``again``, and one by one the windows of those that are in ``firsts`` (holder()); mark is
    the content hash. Rows without anchor are what a text surely repeats of its own."""
    contents, holders = (broadcast(work.sparkSession, bit_filter(rows, rows.columns[0])) for rows in (again, firsts))
    names = ["anchor", "mark", "ord", "th", "start", "stop", "single"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, th = (batch.column(c).to_numpy() for c in ("ord", "th"))
            for chunk in chunks(batch.column("text")):
                values, first, _, _ = units(chunk, True)
                s = Segments(values, first, window, gram)
                if not len(s.start):
                    continue
                own = _seen(s.content, s.anchor, s.text)
                whole = np.flatnonzero(~own & contents.value.test(s.content))
                hit = ~own & holders.value.test(s.content ^ order[chunk.lo + s.text].view(np.uint64))
                which, start, marks = _windows(s, hit, values, window) if hit.any() else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
                twice = _seen(marks, s.anchor[which], s.text[which])
                # own repeats, moved apart by their text's number so that those of neighbouring texts do not touch
                text = np.concatenate((s.text[own], s.text[which[twice]]))
                lo = np.concatenate((s.start[own], start[twice])) + text
                lo, hi = merge_spans(lo, lo + np.concatenate((s.n[own] - 1, np.zeros(twice.sum(), np.int64))) + window)
                text = np.searchsorted(first[1:] + np.arange(len(first) - 1), lo, "right")
                lo, hi, which, start, marks = lo - text, hi - text, which[~twice], start[~twice], marks[~twice]
                texts = np.concatenate((text, s.text[whole], s.text[which]))
                rows, base = chunk.lo + texts, first[texts]
                unknown = np.arange(len(texts)) < len(text)
                keys = [np.concatenate((np.zeros(len(text), np.uint64), *k)).view(np.int64) for k in ((s.anchor[whole], s.anchor[which]), (s.content[whole], marks))]
                begin = np.concatenate((lo, s.start[whole], start)) - base
                end = np.concatenate((hi, s.start[whole] + s.n[whole] - 1 + window, start + window)) - base
                columns = [*(pa.array(k, mask=unknown) for k in keys), order[rows], th[rows], begin.astype(np.int32), end.astype(np.int32), np.arange(len(texts)) >= len(text) + len(whole)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return work.mapInArrow(run, "anchor long, mark long, ord long, th long, start int, stop int, single boolean")


def past_windows(work: DataFrame, firsts: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor`` and ``mark`` of the windows of the segments that are in ``firsts`` (holder())."""
    holders = broadcast(work.sparkSession, bit_filter(firsts, firsts.columns[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column("ord").to_numpy()
            for chunk in chunks(batch.column("text")):
                values, first, _, _ = units(chunk, True)
                s = Segments(values, first, window, gram)
                if len(s.start):
                    hit = holders.value.test(s.content ^ order[chunk.lo + s.text].view(np.uint64))
                    hit[hit] = ~_seen(s.content[hit], s.anchor[hit], s.text[hit])
                    if hit.any():
                        which, _, marks = _windows(s, hit, values, window)
                        yield pa.RecordBatch.from_arrays([pa.array(s.anchor[which].view(np.int64)), pa.array(marks.view(np.int64))], names=["anchor", "mark"])

    return work.select("ord", "text").mapInArrow(run, "anchor long, mark long")


def holder() -> Column:
    """Tells a segment's content in its first document from the same content elsewhere. Other segments may pass a filter of
    these; their windows are compared as well, which changes no result."""
    return F.col("content").bitwiseXOR(F.col("ord")).alias("holder")


@dataclass
class Run:
    table: DataFrame
    path: str
    level: int


@dataclass
class FingerprintIndex:
    """A log-structured index over batches of documents; each batch counts as later than all before it.

    window, gram: words of a window and of its anchor. fanout: runs of a level that are compacted into one.
    """

    spark: SparkSession
    window: int = WINDOW
    gram: int = GRAM
    fanout: int = 2
    runs: list[Run] = field(default_factory=list)
    history: DataFrame | None = None

    def _write(self, rows: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = new_path(self.spark, name)
        return materialize(rows, name, path), path

    def _write_run(self, rows: DataFrame, level: int) -> Run:
        return Run(*self._write(rows, "run"), level)

    def close(self) -> None:
        """Drops all runs."""
        for run in self.runs:
            drop(self.spark, run.path)
        self.runs = []

    def _compact(self) -> None:
        while len(same := [r for r in self.runs if r.level == self.runs[-1].level]) >= self.fanout:
            merged = self._held(same).groupBy("content", "anchor").agg(F.min("ord").alias("ord"))
            self.runs = [r for r in self.runs if r not in same] + [self._write_run(merged, same[0].level + 1)]
            for run in same:
                drop(self.spark, run.path)

    def _held(self, runs: list[Run]) -> DataFrame:
        rows = runs[0].table.select("content", "anchor", "ord")
        for run in runs[1:]:
            rows = rows.unionByName(run.table.select("content", "anchor", "ord"))
        return rows

    def add(self, work: DataFrame) -> DataFrame:
        """Adds a batch (with_order() rows) and returns its spans of repeated words: ord, th, start, stop."""
        # the first document: by its key alone where that tells the documents apart, as numbers need no sort to be aggregated
        if work.groupBy("ord").count().where("count > 1").isEmpty():
            first = lambda: [F.min("ord").alias("ord"), F.lit(None).cast("long").alias("th")]
        else:
            least = F.min(F.when(F.col("ord").isNotNull(), F.struct("ord", "th")))
            first = lambda: [least["ord"].alias("ord"), least["th"].alias("th")]
        found = distinct_segments(work, self.window, self.gram)
        run = self._write_run(found.groupBy("content", "anchor").agg(*first(), F.count("*").alias("copies")), 0)
        met = run.table.withColumn("old", F.lit(False))
        if self.runs:
            met = met.unionByName(self._held(self.runs).select("*", F.lit(None).cast("long").alias("th"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("old")))
        # what the runs and the batch hold, by anchor: contents that come again, and anchors in more than one context of which one is new
        content, anchor = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
        met = met.repartition("anchor").withColumn("past", F.max("old").over(content))
        met = met.withColumn("branching", (F.min("content").over(anchor) != F.max("content").over(anchor)) & ~F.min("past").over(anchor))
        met = met.where("branching or not old and (past or copies > 1)")
        met, met_path = self._write(met, "met")
        again = met.where("not old and (past or copies > 1)").select("anchor", F.col("content").alias("mark"), "ord", "th", "past")
        rows, rows_path = self._write(candidates(work, again.select("mark"), met.where("branching and not past").select(holder()), self.window, self.gram), "candidates")
        windows = rows.where("single").select("anchor", "mark", "ord", "th")
        if self.runs:
            past = past_windows(self.history, met.where("branching and old").select(holder()), self.window, self.gram)
            windows = windows.unionByName(past.select("*", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("th")))
        held = windows.groupBy("anchor", "mark").agg(*first(), F.count("*").alias("copies"), (F.count("ord") < F.count("*")).alias("past"))
        again = again.unionByName(held.where("copies > 1 and ord is not null").drop("copies"))
        again = again.select("anchor", "mark", "past", F.col("ord").alias("__ord"), F.col("th").alias("__th"))
        later = F.col("past") | (F.col("ord") > F.col("__ord")) | ((F.col("ord") == F.col("__ord")) & (F.col("th") > F.col("__th")))
        span = ["ord", "th", "start", "stop"]
        spans = rows.where("anchor is null").select(span).unionByName(rows.where("anchor is not null").join(again, ["anchor", "mark"]).where(later).select(span))
        spans = materialize(spans, "spans")
        for path in (met_path, rows_path):
            drop(self.spark, path)
        self.runs.append(run)
        self._compact()
        self.history = work if self.history is None else self.history.unionByName(work)
        return spans


def _word_digests(base: DataFrame, key: str) -> DataFrame:
    """Words and SHA-256 of all words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest = [], []
            for text in batch.column("text"):
                words = text.as_py().encode().split()
                n.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "ord", "th")), pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=[key, "ord", "th", "n_words", "all_sha256"])

    return base.mapInArrow(run, f"{key} {base.schema[key].dataType.simpleString()}, ord long, th long, n_words long, all_sha256 string")


def _kept_digests(texts: DataFrame) -> DataFrame:
    """Removed words, SHA-256 of the kept words, and the kept words of texts with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                words = text.as_py().encode().split()
                starts, ends = merge_spans(*(np.array([s[c] for s in spans], np.int64) for c in ("start", "stop")))
                kept, at = [], 0
                for lo, hi in zip(starts.tolist(), ends.tolist()):
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["ord", "th", "removed", "sha256"])

    return texts.mapInArrow(run, "ord long, th long, removed long, sha256 string")


def batches_by_key(docs: DataFrame, n: int, key: str = "doc_id") -> list[DataFrame]:
    """Splits documents into ``n`` batches of about equal size by ranges of the key; null keys come last."""
    cuts = [] if n < 2 else sorted({int(x) for x in docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.01)})
    column, out = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        out.append(docs.where((F.lit(True) if lo is None else column > lo) & (F.lit(True) if hi is None else column <= hi)))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` of each row, after its repeated words went.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a smaller key or earlier in the
    same text. Windows are judged on the input. Null and blank texts have no words. Rows with equal keys count as ordered
    by a hash of their text; wholly equal rows count as one document. Null keys come last. No rows give no rows.
    """
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window=window, gram=min(GRAM, window))
    spans = None
    for batch in batches_by_key(docs, batches, key):
        more = index.add(with_order(batch, key, text))
        spans = more if spans is None else spans.unionByName(more)
    index.close()
    base = docs.select(F.col(key), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = _kept_digests(with_spans(with_order(docs, key, text), spans)).dropDuplicates(["ord", "th"])
    out = _word_digests(base, key).join(cut, ["ord", "th"], "left")
    return out.select(key, "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha256", "all_sha256").alias("kept_sha256"))
