"""SimHash near duplicates: fingerprints, BK-trees over shards of fingerprints, and linked components.

Fingerprints within ``radius`` bits agree in all but ``radius`` of some blocks of bits. A shard holds the distinct
fingerprints that agree in one choice of blocks, so every link lies inside a shard. Each shard is one BK-tree: the
children of a node are keyed by their integer Hamming distance to it, and a search follows only the edges within the
radius of the query's distance. Trees are not broadcast, as all of them together grow with the corpus: they are built
where the shuffle brings their shard together, and queried there by the shard's own fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import line_dedup
from satchel.llm.components import component_labels
from satchel.llm.split_join import split_by, spread_join, without_keys
from satchel.llm.store import materialize, new_path, temporary

SEED = 42
#: Pairs of query and node that a search looks at together.
FRONTIER = 1 << 17
#: Mean fingerprints a shard, from which a finer choice of blocks is taken.
SHARD_ROWS = 64
#: Rows of shards that a task handles together, and of the largest tree.
TASK_ROWS, SHARD_MOST = 1 << 16, 1 << 18


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the word shingles of one text; see fingerprints()."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: max(0, len(words) - width)]]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1 :])], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (long, the 64 bits as they are) of every whole text.

    A-Z are lower-cased, words are runs of anything but space and the controls 9 to 13, shingles are ``width`` words
    joined by a space, repeats included; fewer words make one shingle of all of them. A bit is set if over half the
    shingles' XXH64 (seed 42) have it. Null, empty and blank texts have the fingerprint zero.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint((t or "").encode(), width) for t in (x.as_py() for x in batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(values.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """BK-trees of many shards in arrays. Rows are sorted by shard; fingerprints of a shard are distinct."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        first = np.flatnonzero(np.concatenate(([True], np.any(shard[1:] != shard[:-1], axis=1)))) if n else np.empty(0, np.int64)
        self.root = np.repeat(first, np.diff(np.concatenate((first, [n]))))
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []
        edge_keys, children = [], []
        pending = np.setdiff1d(np.arange(n), first, assume_unique=True)
        node = self.root[pending]
        while len(pending):
            edges = node * 65 + popcount(fp[pending] ^ fp[node])
            keys, at, which = np.unique(edges, return_index=True, return_inverse=True)
            edge_keys.append(keys)
            children.append(pending[at])  # the first row at this edge becomes the child, the others descend to it
            self.parent[pending[at]], self.edge[pending[at]] = keys // 65, keys % 65
            self.levels.append(pending[at])
            rest = np.ones(len(pending), bool)
            rest[at] = False
            node, pending = pending[at][which[rest]], pending[rest]
        keys = np.concatenate(edge_keys) if edge_keys else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.edges = keys[order]
        self.child = np.concatenate(children)[order] if children else np.empty(0, np.int64)

    def links(self, radius: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (query, earlier row) within the radius; pairs that ``label`` has linked already may be left out,
        as a search does not enter a subtree that is wholly linked to its query."""
        whole = np.ones(len(self.fp), bool)
        for level in reversed(self.levels):
            np.logical_and.at(whole, self.parent[level], whole[level] & (label[level] == label[self.parent[level]]))
        step = 1 << 15
        for lo in range(0, len(self.fp), step):
            queries = np.arange(lo, min(lo + step, len(self.fp)))
            stack = [(queries, self.root[queries])]
            while stack:
                query, node = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                new = ~(whole[node] & (label[node] == label[query]))
                query, node = query[new], node[new]
                d = popcount(self.fp[query] ^ self.fp[node])
                near = (d <= radius) & (node < query)
                if near.any():
                    yield query[near], node[near]
                lo_edge = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 1), "left")
                n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right") - lo_edge
                if n.any():
                    at = np.repeat(lo_edge - np.cumsum(n) + n, n) + np.arange(n.sum())
                    stack.append((np.repeat(query, n), self.child[at]))

    def components(self, radius: int) -> np.ndarray:
        """The least row that each row is linked to over any number of links. Edges of the trees that are links come
        first, then searches find the rest."""
        label = np.arange(len(self.fp))
        short = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        label = _joined(label, short, self.parent[short])
        for a, b in self.links(radius, label.copy()):
            label = _joined(label, a, b)
        return label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows a and b: each row's least row so far."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        change = low < high
        if not change.any():
            return label
        np.minimum.at(label, high[change], low[change])
        while (label[label] != label).any():
            label = label[label]


def near_links(prints: DataFrame, radius: int = 3, n: int | None = None) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints within ``radius`` bits of each other.

    prints: distinct ``fp`` and their ``vertex`` (long). Every pair within the radius is found; of the links that a shard
    finds, a spanning star of each of its components is returned, so the rows never exceed the fingerprints by more than
    the number of block choices.
    """
    n = prints.count() if n is None else n
    blocks = next((k for k in range(radius + 1, 4 * radius) if n <= SHARD_ROWS * 2 ** (64 * (k - radius) // k)), 4 * radius)
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << bounds[i + 1] - bounds[i]) - 1) << bounds[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed))))
    spread = prints.select("vertex", "fp", shards.alias("shard")).select("vertex", "fp", "shard.*").repartition("choice", "bits").sortWithinPartitions("choice", "bits", "vertex")

    def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        vertex, fp, choice, bits = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in ("vertex", "fp", "choice", "bits"))
        pairs = shard_links(vertex, fp.view(np.uint64), np.stack((choice.astype(np.int64), bits), axis=1), masks, radius)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards, TASK_ROWS rows together at least; the last shard of what was read may go on."""
        parts: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            parts, rows = [*parts, batch], rows + batch.num_rows
            if rows < TASK_ROWS:
                continue
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            choice, bits = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "bits"))
            cut = int(np.flatnonzero((choice != choice[-1]) | (bits != bits[-1]))[-1]) + 1 if (choice[0], bits[0]) != (choice[-1], bits[-1]) else 0
            if cut:
                yield linked([whole.slice(0, cut)])
            parts, rows = [whole.slice(cut)], whole.num_rows - cut
        if rows:
            yield linked(parts)

    return spread.mapInArrow(run, "a long, b long").distinct()


def shard_links(vertex: np.ndarray, fp: np.ndarray, shard: np.ndarray, masks: list[int], radius: int) -> np.ndarray:
    """Pairs (least vertex, vertex) that connect what is linked inside each shard; rows are in the order of shards. shard: the
    number of the mask whose bits agree, and these bits. Shards of over SHARD_MOST rows are split by further blocks of their
    other bits, so that a tree is never larger, unless no other bits are left to agree."""
    first = np.flatnonzero(np.concatenate(([True], np.any(shard[1:] != shard[:-1], axis=1))))
    size = np.diff(np.concatenate((first, [len(fp)])))
    large = np.repeat(size > SHARD_MOST, size)
    found = [np.empty((0, 2), np.int64)]
    for lo, n in zip(first[size > SHARD_MOST].tolist(), size[size > SHARD_MOST].tolist()):
        fixed = masks[int(shard[lo, 0])]
        free = [b for b in range(64) if not fixed >> b & 1]
        blocks = [free[i::radius + 2] for i in range(radius + 2)]
        own_vertex, own_fp = vertex[lo : lo + n], fp[lo : lo + n]
        for chosen in combinations(range(radius + 2), 2) if len(free) >= radius + 2 else ():  # of radius + 2 blocks two agree
            mask = sum(1 << b for i in chosen for b in blocks[i])
            order = np.argsort(own_fp & np.uint64(mask), kind="stable")
            inside = (own_fp[order] & np.uint64(mask)).view(np.int64)
            found.append(shard_links(own_vertex[order], own_fp[order], np.stack((np.zeros(n, np.int64), inside), axis=1), [fixed | mask], radius))
        if len(free) < radius + 2:
            large[lo : lo + n] = False
    vertex, fp, shard = vertex[~large], fp[~large], shard[~large]
    label = Forest(shard, fp).components(radius)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return np.unique(np.concatenate([*found, np.stack((vertex[label[linked]], vertex[linked]), axis=1)]), axis=0)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (the least key reachable over links of ``radius`` bits or fewer) of each row.

    ``key`` is an integer; rows with equal keys are returned as often as they come. Null keys are returned with their
    fingerprint's component, and are no component's id unless all its keys are null. Equal fingerprints (copies, texts
    without words) are linked. A table without rows gives no rows.
    """
    return _grouped(materialize(fingerprints(docs, width, key, text), "fingerprints"), radius, key)


def _grouped(prints: DataFrame, radius: int, key: str) -> DataFrame:
    """near_duplicates() of the rows of fingerprints()."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("vertex")), "distinct-fingerprints")
    known = distinct.where("vertex is not null")
    links = materialize(near_links(known.select(F.col("vertex").cast("long").alias("vertex"), "fp"), radius), "fingerprint-links")
    labels = component_labels(links)
    of_print = distinct.join(labels, distinct["vertex"] == labels["node"], "left").select("fp", F.coalesce("component", "vertex").alias("component_id"))
    return prints.join(of_print, "fp").select(key, "fp", "component_id")


def _pair_similarity(a: str, b: str, width: int) -> float:
    """Jaccard similarity of the sets of word shingles of two texts, A-Z in lower case."""
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append({b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    common = len(sets[0] & sets[1])
    return common / max(1, len(sets[0]) + len(sets[1]) - common)


def _texts(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """__key and __text of the members' rows; one row a key."""
    texts = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    texts, _ = split_by(texts, F.col("__key"), members)
    return texts.join(members, texts["__key"] == members[key], "left_semi").groupBy("__key").agg(F.first("__text").alias("__text"))


def _verified(texts: DataFrame, pairs: DataFrame, width: int, similarity: float, key: str) -> DataFrame:
    """The ``pairs`` (key, of) whose texts are equal or have the similarity. texts: __key, __text."""
    own = pairs.join(texts.withColumnRenamed("__text", "a"), F.col(key) == F.col("__key")).drop("__key")
    # the least row of a large group meets all others of it
    copies = materialize(pairs.groupBy("of").agg(F.count("*").alias("__n")), "copies-of")
    least = copies.join(texts.withColumnRenamed("__text", "b"), F.col("of") == F.col("__key")).drop("__key")
    both = spread_join(own, least, ["of"], "__n")
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [a == b or _pair_similarity(a, b, width) >= similarity for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield batch.select([key, "of"]).filter(pa.array(near, pa.bool_()))

    return both.select(key, "of", "a", "b").mapInArrow(run, f"`{key}` {kind}, of {kind}")


def linked_copies(docs: DataFrame, radius: int = 7, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``of`` (a smaller key) of the near copies that fingerprints find.

    Fingerprints within ``radius`` bits make groups; a row is a copy if its text equals that of the group's least row, or
    their sets of ``width``-word shingles have the similarity or more.
    """
    grouped = _grouped(materialize(fingerprints(docs, width, key, text).where("fp != 0"), "fingerprints"), radius, key)
    pairs = materialize(grouped.where(F.col("component_id") != F.col(key)).select(key, F.col("component_id").alias("of")).distinct(), "copy-pairs")
    texts = materialize(_texts(docs, pairs.select(key).union(pairs.select("of")).distinct(), key, text), "copy-texts")
    return _verified(texts, pairs, width, similarity, key)


def copies(docs: DataFrame, radius: int = 7, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``of`` (a smaller key) of the rows that are near copies of a row with a smaller key, which may go itself.

    A row is a copy if its text equals that of the other, or their sets of ``width``-word shingles have the similarity or
    more. linked_copies() finds most of them by fingerprints. What it leaves is compared by an exact set-similarity join, a
    text being one line, so that no two rows are left that are copies of each other. Rows with null keys, and of rows with
    equal keys all but one, have no part.
    """
    spark = docs.sparkSession
    near_path, more_path = new_path(spark, "copies"), new_path(spark, "copies")
    with temporary(spark):
        near = materialize(linked_copies(docs, radius, width, similarity, key, text), "copies", near_path)
        kind = docs.schema[key].dataType.simpleString()
        # a text is one line of words in lower case, in the order of keys
        folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", "abcdefghijklmnopqrstuvwxyz ")
        rest = without_keys(docs.where(F.col(key).isNotNull()), key, near.select(key))
        work = materialize(rest.select(F.col(key).cast("long").alias("ord"), F.lit(0).cast("long").alias("th"), folded.alias("text")), "folded")
        found = line_dedup.later_matches(work, similarity, width).select(F.col("ord").cast(kind).alias(key), F.col("of.ord").cast(kind).alias("of"))
        more = materialize(found.where(F.col(key) != F.col("of")).distinct(), "copies", more_path)
    return near.unionByName(more)


def keep_one(docs: DataFrame, radius: int = 7, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that copies() finds: of rows that are near copies of each other the one with the least key
    stays. Texts without words and rows with a null key stay. No rows give no rows."""
    return without_keys(docs, key, materialize(copies(docs, radius, width, similarity, key, text).select(key), "copies"))
