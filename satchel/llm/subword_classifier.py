"""A text classifier over learned subword vectors.

Words and character n-grams are hashed into buckets, each with a learned vector; a text is the average of its vectors,
and a softmax layer turns it into class probabilities. Vectors and layer are learned together by stochastic gradient
descent in numpy on a bounded sample of labelled rows. For scoring, vectors and layer reduce to one number a bucket, so
every text is scored in one pass with a broadcast of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.text import Chunk, chunks, mix, prefix_sums, slice_hashes, window_hashes

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4)
#: Labelled rows that are learned from, at most: those with the least hashes of their keys.
SAMPLE_ROWS = 4000
EPOCHS = 12
RATE = 4.0
SPACE = np.zeros(0x3001, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_AGAIN = np.uint64(0x51ED270B7A2B1F35)


def features(chunk: Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature of a chunk: words, a word that repeats the one before it, and n-grams of
    code points that may begin or end with, but not span, white space."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))
    first = lead[chunk.offsets]  # where each text begins, in code points
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    values = mix(points.astype(np.uint64) + np.uint64(0x9E37))
    space = SPACE[np.minimum(points, 0x3000)]
    texts, hashes = [], []
    if len(points):
        word = ~space
        cut = np.zeros(len(points) + 1, bool)
        cut[first] = True
        starts = np.flatnonzero(word & (np.concatenate(([True], space[:-1])) | cut[:-1]))
        ends = np.flatnonzero(word & (np.concatenate((space[1:], [True])) | cut[1:])) + 1
        words = slice_hashes(prefix_sums(values), starts, ends)
        of_word = text_of[starts]
        if len(words):
            again = np.concatenate(([False], (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])))
            texts += [of_word, of_word[again]]
            hashes += [words, np.full(again.sum(), _AGAIN)]
    spaces = np.concatenate(([0], np.cumsum(space)))
    for n in GRAMS:
        grams = window_hashes(values, n)
        at = np.arange(len(grams))
        inside = (spaces[at + n - 1] - spaces[at + 1] == 0) & (text_of[: len(grams)] == text_of[n - 1 :] if len(grams) else False)
        texts.append(text_of[: len(grams)][inside])
        hashes.append(grams[inside] ^ np.uint64(n))
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(20)).astype(np.int64) & buckets - 1


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Log-odds of label 1 that each bucket contributes, and the bias last.

    rows: label, buckets of a text, and their shares of its features. Without rows, or with one class only, scores follow
    the smoothed share of label 1."""
    random = np.random.default_rng(7)
    vectors = random.normal(0, 0.1, (buckets, dimensions)).astype(np.float32)
    layer = random.normal(0, 0.1, (dimensions, 2)).astype(np.float32)
    share = (sum(y for y, _, _ in rows) + 1) / (len(rows) + 2)
    bias = np.log(np.array([1 - share, share], np.float32))
    if len({y for y, _, _ in rows}) == 2:
        done, total = 0, epochs * len(rows)
        for _ in range(epochs):
            for i in random.permutation(len(rows)):
                label, ids, weights = rows[i]
                step = rate * (1 - done / total)
                done += 1
                mean = weights @ vectors[ids]
                z = mean @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = layer @ p
                layer -= 0.05 * step * np.outer(mean, p)
                bias -= 0.01 * step * p
                vectors[ids] -= np.outer(step * weights, back)
    else:
        layer[:] = 0
    odds = vectors @ (layer[:, 1] - layer[:, 0])
    return np.concatenate((odds, [bias[1] - bias[0]])).astype(np.float32)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", buckets: int = BUCKETS) -> np.ndarray:
    """Learns in one task from a sample whose size the caller bounds; see sample()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            out = []
            for chunk in chunks(batch.column("text")):
                texts, found = features(chunk, buckets)
                keys, n = np.unique(texts * buckets + found, return_counts=True)
                bounds = np.searchsorted(keys, np.arange(chunk.hi - chunk.lo + 1) * buckets)
                out += [(labels[chunk.lo + i], (keys[a:b] & buckets - 1).astype(np.int32), n[a:b].astype(np.int32)) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _, _ in out], pa.int32()), pa.array([i.tobytes() for _, i, _ in out], pa.binary()), pa.array([n.tobytes() for _, _, n in out], pa.binary())], names=["label", "ids", "n"])

    def train(_: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["label", "ids", "n"])  # the outcome does not depend on the order of rows
        rows = []
        for r in sample.itertuples():
            n = np.frombuffer(r.n, np.int32)
            rows.append((int(r.label), np.frombuffer(r.ids, np.int32), (n / max(1, n.sum())).astype(np.float32)))
        return pd.DataFrame({"odds": [learn(rows, buckets).tobytes()]})

    found = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).mapInArrow(run, "label int, ids binary, n binary")
    model = found.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(train, "odds binary").collect()
    return np.frombuffer(model[0].odds, np.float32) if model else learn([], buckets)


def score(docs: DataFrame, odds: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score``, the probability of label 1, of every whole text; empty and null texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for chunk in chunks(batch.column("text")):
                texts, found = features(chunk, len(weights) - 1)
                n = chunk.hi - chunk.lo
                out[chunk.lo : chunk.hi] = np.bincount(texts, weights[found], n) / np.maximum(np.bincount(texts, minlength=n), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out + weights[-1], -50, 50))))], names=[key, "score"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, score double")


def fold(key: str = "doc_id"):
    """crc32 of the key as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(key).cast("string")) % 5


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text`` and ``label`` of at most ``rows`` labelled documents that are not held out, least key hashes first, of one key
    least text hashes. Of several labels of a key the least counts; repeated documents of a key count each."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key) != 0)).groupBy(key).agg(F.min(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(rows)
    found = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    return found.orderBy(F.xxhash64(key), key, F.xxhash64("text")).limit(rows).select("text", "label")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``.

    Labels are learned from rows whose fold() is not 0; labels and other columns are no inputs of a score. Rows with a
    null key are scored and not held out; repeated rows are each scored; other columns are not read, whatever their names.
    Without labels every score is one half, and no rows give no rows.
    """
    odds = fit(sample(docs, labels, label, rows, key, text))
    return score(docs, odds, key, text).select(key, F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
