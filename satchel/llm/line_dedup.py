"""Line dedup by an exact set-similarity join.

A line is the set of its word shingles (a line of fewer words is one token). Tokens are put in order of rarity, by counts
of hashed tokens over all lines, ties by hash. Two sets of similarity ``t`` or more share a token among the first
``n - ceil(t * n) + 1`` of each (prefix filter); sizes must be within ``t`` of each other (length filter), and the places
of a shared token in both orders bound the overlap (positional filter; tokens before it that no other set has do not
count). What is left is verified by the exact Jaccard similarity.

Equal sets are found beforehand, inside each task and then by their hashes, so that only distinct sets are joined. Tokens
that one set alone has, the most by far, leave before the join: repeated_values() finds the others. The sets of a token
are met in rounds, first the earliest of them, then a few, then each time about ``GROWTH`` times as many, chosen by hash; a set
leaves as soon as one matches, so that groups of near copies do not make all pairs. Sets without a match go on until they
have met all earlier ones. No task holds or sorts the sets of a token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from satchel.llm.anchors import LAST, BitFilter, bit_filter, with_order
from satchel.llm.split_join import split_by
from satchel.llm.store import broadcast, materialize
from satchel.llm.text import Chunk, chunks, mix, powers, prefix_sums, slice_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Lines with fewer words are never removed; with 1, only blank lines stay.
MIN_WORDS = 1
#: Counters of hashed tokens; their ranks, 2 MB whatever the corpus, are broadcast.
COUNTERS = 1 << 20
PIECE = 1 << 16
#: Sets of a token in a round, as a multiple of those in the round before.
GROWTH_BITS = 6
GROWTH = 1 << GROWTH_BITS
#: Bytes of text that are split into lines and words at once.
TEXT_BYTES = 1 << 18
#: Tokens that a task gathers before it counts them or looks for equal sets.
GATHER = 1 << 20
#: Bits of a filter for each value that it holds, where few of very many rows should pass.
RARE = 64
_SEED_A, _SEED_B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _line_places(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line of a chunk starts, its text, and its number there. A text's last line is left out if it is empty."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate((chunk.offsets[:-1], breaks + 1)))  # a text's end opens the next text
    starts = starts[(starts < len(chunk.data)) & (np.diff(starts, prepend=-1) > 0)]
    text = np.searchsorted(chunk.offsets[1:], starts, "right")
    before = np.searchsorted(starts, chunk.offsets[:-1], "left")
    return starts, text, np.arange(len(starts)) - before[np.minimum(text, len(before) - 1)]


class Lines:
    """The lines of a chunk with ``least`` words or more: text, line number, and the tokens of each in text order."""

    def __init__(self, chunk: Chunk, shingle: int, least: int):
        starts, ends, _ = chunk.words()
        line_starts, self.text, self.number = _line_places(chunk)
        of_word = np.searchsorted(starts, line_starts, "left")
        words = word_hashes(chunk.data, starts, ends)
        n_words = np.diff(np.concatenate((of_word, [len(starts)])))
        # shingles of each line; the whole line where it has fewer words
        n_tokens = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
        n_tokens[n_words < least] = 0
        self.line = np.repeat(np.arange(len(line_starts)), n_tokens)
        # the shingle at each word, then those that end in their line, which gathers less than a slice for each token does
        sums = prefix_sums(words)
        token = np.empty(len(words), np.uint64)
        token[: max(0, len(words) - shingle + 1)] = mix((sums[shingle:] - sums[:-shingle]) * powers(len(sums))[1][: max(0, len(words) - shingle + 1)])
        short = np.flatnonzero((n_words > 0) & (n_words < shingle))
        token[of_word[short]] = slice_hashes(sums, of_word[short], of_word[short] + n_words[short])
        begins = np.repeat(n_words >= least, n_words)
        for back in range(1, shingle):
            begins[(of_word + n_words - back)[n_words > back]] = False
        self.token = token[begins]


class LineSets:
    """The distinct tokens of each line, by the rank of their counters and then by hash."""

    def __init__(self, found: Lines, ranks: np.ndarray | None = None):
        line, token = found.line, found.token
        key = token >> np.uint64(16)
        if ranks is not None:
            key |= ranks[(token & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(48)
        order = np.argsort(key)
        narrow = line.astype(np.uint16) if len(found.text) < 1 << 16 else line
        order = order[np.argsort(narrow[order], kind="stable")]
        line, key, token = line[order], key[order], token[order]
        new = np.concatenate(([True], (line[1:] != line[:-1]) | (token[1:] != token[:-1]))) if len(line) else np.empty(0, bool)
        if (new[1:] & (key[1:] == key[:-1]) & (line[1:] == line[:-1])).any():  # two tokens of one key: by their last bits
            order = np.lexsort((token, key, line))
            line, token = line[order], token[order]
            new = np.concatenate(([True], (line[1:] != line[:-1]) | (token[1:] != token[:-1])))
        line, self.token = line[new], token[new]
        self.at = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
        self.size = np.diff(np.concatenate((self.at, [len(line)])))
        self.text, self.number = found.text[line[self.at]], found.number[line[self.at]]
        self.a, self.b = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.at):  # two hashes of each set
            self.a, self.b = (mix(np.add.reduceat(mix(self.token ^ seed), self.at) + self.size.astype(np.uint64)).view(np.int64) for seed in (_SEED_A, _SEED_B))


def _cells(binary: pa.Array) -> np.ndarray:
    """The int64 values that a binary column holds, all rows joined."""
    offsets = np.frombuffer(binary.buffers()[1] or b"\0" * 4, np.int32)[binary.offset : binary.offset + len(binary) + 1]
    return np.frombuffer(binary.buffers()[2] or b"", np.int64, (int(offsets[-1]) - int(offsets[0])) // 8, int(offsets[0]))


def _sizes(binary: pa.Array) -> np.ndarray:
    """How many int64 values each row of a binary column holds."""
    return np.diff(np.frombuffer(binary.buffers()[1] or b"\0" * 4, np.int32)[binary.offset : binary.offset + len(binary) + 1]) // 8


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column: row i has the next ``sizes[i]`` values."""
    offsets = np.concatenate(([0], np.cumsum(sizes * 8))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


@dataclass
class Sets:
    """The distinct sets at their first place (columns SETS): those of ``heads`` whose ``a`` surely comes once, and ``firsts``."""

    heads: DataFrame
    again: BitFilter
    firsts: DataFrame
    n_tokens: int  # of the prefixes of ``heads``

    def map(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, columns: list[str]) -> DataFrame:
        shared, names = broadcast(self.heads.sparkSession, self.again), list(dict.fromkeys(["a", *columns]))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return run(b.filter(pa.array(~shared.value.test(b.column("a").to_numpy()))) for b in batches)

        return self.heads.select(*names).mapInArrow(own, schema).unionByName(self.firsts.select(*names).mapInArrow(run, schema))


def repeated_values(dealt: Callable, n: int) -> DataFrame:
    """``value`` of the values that come twice or more among about ``n``. dealt: maps a function on the batches that hold the
    values, in their last column as longs or as binary of int64s, to a table.

    Tasks send sorted values, two of each at most, to the part of the value range that they are in, where equal ones meet.
    A part has about a million values, so that its arrays fit in a task; beyond 2**16 parts Spark's own aggregation does it.
    """
    bits = max(0, (n >> 20).bit_length())
    parts = 1 << bits

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column(batch.num_columns - 1)
        return (_cells(column) if pa.types.is_binary(column.type) else column.to_numpy()).copy()

    if bits > 16:

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(numbers(batch))], names=["value"])

        return dealt(unpack, "value long").groupBy("value").count().where("count > 1").select("value")

    def twice_at_most(got: list[np.ndarray]) -> np.ndarray:
        own = np.sort(np.concatenate(got))
        return own[np.concatenate((np.ones(min(2, len(own)), bool), own[2:] != own[:-2]))]

    def split(got: list[np.ndarray]) -> pa.RecordBatch:
        own = twice_at_most(got)
        cuts = np.searchsorted(own, np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), _packed(own, np.diff(np.concatenate(([0], cuts, [len(own)]))))], names=["part", "values"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            got.append(numbers(batch).view(np.uint64))
            size += len(got[-1])
            if size > 2 * GATHER:
                yield split(got)
                got, size = [], 0
        if size:
            yield split(got)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own:
                    got.setdefault(part, []).append(np.frombuffer(own, np.uint64))
        for own in map(twice_at_most, got.values()):
            again = np.flatnonzero(own[1:] == own[:-1])
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array(own[again].view(np.int64))], names=["value"])

    return dealt(deal, "part int, values binary").repartition(parts, "part").mapInArrow(meet, "value long")


def token_ranks(work: DataFrame, shingle: int, least: int) -> np.ndarray:
    """The rank of each counter, from the logarithm of the tokens that it counts, over all texts. Summed piece by piece in
    two shuffles."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        got, size = [], 0
        for batch in batches:
            for chunk in chunks(batch.column("text"), TEXT_BYTES):
                got.append((Lines(chunk, shingle, least).token & np.uint64(COUNTERS - 1)).astype(np.int32))
                size += len(got[-1])
                if size > GATHER:
                    total += np.bincount(np.concatenate(got), minlength=COUNTERS)
                    got, size = [], 0
        if size:
            total += np.bincount(np.concatenate(got), minlength=COUNTERS)
        if total.any():
            salt = int(total.sum()) % 64
            n = COUNTERS // PIECE
            counts = [total[i * PIECE : (i + 1) * PIECE].astype(np.uint32).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array(counts, pa.binary())], names=["piece", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, salt, found in zip(*(batch.column(c).to_pylist() for c in ("piece", "salt", "counts"))):
                own = np.frombuffer(found, np.uint32)
                # counts stop at the largest number, which keeps the order of all others
                total[piece, salt] = np.minimum(total[piece, salt].astype(np.uint64) + own, np.iinfo(np.uint32).max).astype(np.uint32) if (piece, salt) in total else own
        for (piece, salt), own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([salt], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["piece", "salt", "counts"])

    schema = "piece int, salt int, counts binary"
    parts = work.select("text").mapInArrow(local, schema).repartition("piece", "salt").mapInArrow(add, schema)
    parts = parts.withColumn("salt", F.lit(0)).repartition("piece").mapInArrow(add, schema)
    ranks = np.zeros(COUNTERS, np.uint16)
    for row in parts.collect():
        ranks[row.piece * PIECE : (row.piece + 1) * PIECE] = np.log2(1.0 + np.frombuffer(row.counts, np.uint32)) * 2047
    return ranks


SETS = "a long, b long, size int, ord long, th long, line int, prefix binary, of struct<ord: long, th: long, line: int>"
PLACE = "ord", "th", "line"


def line_sets(work: DataFrame, ranks: np.ndarray, similarity: float, shingle: int, least: int) -> DataFrame:
    """A row for each line: its set's two hashes and size, its place, and the rarest tokens, which the prefix filter needs.
    Lines whose set a task has at an earlier place have that place in ``of`` instead of tokens."""
    shared = broadcast(work.sparkSession, ranks)

    def joined(got: list[tuple]) -> pa.RecordBatch:
        a, b, size, order, th, line, n, prefix = (np.concatenate(c) for c in zip(*got))
        by_set = np.lexsort((line, th, order, b, a))
        new = np.concatenate(([True], (a[by_set[1:]] != a[by_set[:-1]]) | (b[by_set[1:]] != b[by_set[:-1]])))
        head = by_set[new]
        starts = np.cumsum(n) - n
        n_head = n[head]
        tokens = prefix[np.repeat(starts[head] - np.cumsum(n_head) + n_head, n_head) + np.arange(n_head.sum())]
        rest = by_set[~new]
        rows = np.concatenate((head, rest))
        columns = [pa.array(c[rows]) for c in (a, b, size, order, th, line)]
        packed = pa.concat_arrays([_packed(tokens, n_head), pa.nulls(len(rest), pa.binary())])
        first = head[np.cumsum(new)[~new] - 1]
        places = pa.StructArray.from_arrays([pa.array(c[first]) for c in (order, th, line)], names=list(PLACE))
        of = pa.concat_arrays([pa.nulls(len(head), places.type), places])
        return pa.RecordBatch.from_arrays([*columns, packed, of], names=["a", "b", "size", *PLACE, "prefix", "of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, gathered = [], 0
        for batch in batches:
            order, th = (batch.column(c).to_numpy() for c in ("ord", "th"))
            for chunk in chunks(batch.column("text"), TEXT_BYTES):
                found = LineSets(Lines(chunk, shingle, least), shared.value)
                if not len(found.at):
                    continue
                n = found.size - np.ceil(similarity * found.size - 1e-9).astype(np.int64) + 1
                at = np.repeat(found.at - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows = chunk.lo + found.text
                got.append((found.a, found.b, found.size.astype(np.int32), order[rows], th[rows], found.number.astype(np.int32), n, found.token[at].view(np.int64)))
                gathered += len(at)
                if gathered > GATHER:
                    yield joined(got)
                    got, gathered = [], 0
        if got:
            yield joined(got)

    return work.mapInArrow(run, SETS)


def _maybe_in(spark: SparkSession, wanted: BitFilter) -> Callable[[str], Column]:
    """Whether a long column's values may be in ``wanted``. Only that column goes to Python."""
    shared = broadcast(spark, wanted)

    @F.arrow_udf("boolean")
    def maybe(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.test(values.to_numpy()))

    return maybe


def _distinct(work: DataFrame, similarity: float, shingle: int, least: int) -> tuple[DataFrame, Sets]:
    """Place of the lines that are not the first of their set with the place ``of`` one before them, and the distinct sets at
    their first place."""
    counted = Observation()  # as the table is written; the numbers only choose how finely hashes are dealt
    found = line_sets(work, token_ranks(work, shingle, least), similarity, shingle, least)
    lines = materialize(found.observe(counted, F.count("prefix").alias("heads"), F.sum(F.length("prefix")).alias("bytes")), "lines")
    heads = lines.where("prefix is not null")
    again = bit_filter(materialize(repeated_values(heads.select("a").mapInArrow, counted.get["heads"]), "repeated-sets"), "value", RARE)
    several = materialize(heads.where(_maybe_in(heads.sparkSession, again)("a")), "several-sets")
    firsts = several.groupBy("a", "b").agg(F.min(F.struct(*PLACE)).alias("first"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    firsts = materialize(firsts.select("a", "b", "size", "first.*", "prefix"), "first-sets")
    of_first = firsts.select("a", "b", F.struct(*PLACE).alias("first"))
    later = several.select("a", "b", *PLACE).join(of_first, ["a", "b"]).where(F.col("first") < F.struct(*PLACE))
    later = lines.where("prefix is null").select(*PLACE, "of").unionByName(later.select(*PLACE, F.col("first").alias("of")))
    return later, Sets(heads, again, firsts, (counted.get["bytes"] or 0) // 8)


ENTRIES = "token long, a long, b long, ord long, th long, line int, size int, at int, shared int, level int"


def _entries(sets: Sets, often: BitFilter) -> DataFrame:
    """A row for each prefix token that other sets may have: its place ``at`` in the set's order, its place ``shared`` among
    such tokens, and the set's ``level``, which one of GROWTH sets has above any given level."""
    wanted = broadcast(sets.heads.sparkSession, often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            token = _cells(prefix)
            n = _sizes(prefix)
            begin = np.cumsum(n) - n
            hit = wanted.value.test(token) if len(token) else np.empty(0, bool)
            before = np.cumsum(hit) - hit
            which = np.repeat(np.arange(len(n)), n)[hit]
            if not len(which):
                continue
            at = np.flatnonzero(hit) - begin[which]
            a, b, order, th, line, size = (batch.column(c).to_numpy()[which] for c in ("a", "b", "ord", "th", "line", "size"))
            hashed = mix(a.view(np.uint64) + b.view(np.uint64))
            zeros = np.bitwise_count((hashed & (~hashed + np.uint64(1))) - np.uint64(1))  # at the end of the hash
            level = (zeros // GROWTH_BITS).astype(np.int32)
            columns = [token[hit], a, b, order, th, line, size, at.astype(np.int32), (before[hit] - before[begin[which]]).astype(np.int32), level]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in ENTRIES.split(", ")])

    return sets.map(run, ENTRIES, ["b", "size", *PLACE, "prefix"])


def _place_hashes(order: np.ndarray, th: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(order.view(np.uint64) ^ _SEED_A) + th.view(np.uint64)) + line.astype(np.uint64)


def _set_tokens(work: DataFrame, places: DataFrame, shingle: int, least: int) -> DataFrame:
    """``a``, ``b`` and ``tokens`` of the sets of the lines at the given places. Some others are among them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place_hashes(*(batch.column(i).to_numpy() for i in range(3))).view(np.int64))], names=["place"])

    wanted = broadcast(work.sparkSession, bit_filter(materialize(places.select(*PLACE).mapInArrow(hashed, "place long"), "places"), "place"))

    def sets(got: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        chunk = Chunk(0, 0, np.concatenate(got), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))
        found = LineSets(Lines(chunk, shingle, least))
        return pa.RecordBatch.from_arrays([pa.array(found.a), pa.array(found.b), _packed(found.token.view(np.int64), found.size)], names=["a", "b", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, sizes, gathered = [], [], 0
        for batch in batches:
            order, th = (batch.column(c).to_numpy() for c in ("ord", "th"))
            for chunk in chunks(batch.column("text"), TEXT_BYTES):
                starts, text, number = _line_places(chunk)
                if not len(starts):
                    continue
                rows = chunk.lo + text
                hit = wanted.value.test(_place_hashes(order[rows], th[rows], number))
                if not hit.any():
                    continue
                n = np.diff(np.concatenate((starts, [len(chunk.data)])))
                got.append(chunk.data[np.repeat(hit, n)])  # only these lines are hashed
                sizes.append(n[hit])
                gathered += len(got[-1])
                if gathered > TEXT_BYTES:
                    yield sets(got, sizes)
                    got, sizes, gathered = [], [], 0
        if got:
            yield sets(got, sizes)

    return work.mapInArrow(run, "a long, b long, tokens binary")


def _in_common(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """How many values row i of both sides has in common: the next ``n_left[i]`` and ``n_right[i]`` values, distinct and
    ascending in a row."""
    n = len(n_left)
    bits = n.bit_length()
    rows, keys = [np.repeat(np.arange(n, dtype=np.uint64), c) for c in (n_left, n_right)], []
    for row, own in zip(rows, (left, right)):
        keys.append(row << np.uint64(64 - bits) | own >> np.uint64(bits))  # ascending over all rows
    if any((k[1:] == k[:-1]).any() for k in keys):  # values that the bits left do not tell apart
        cuts = [np.cumsum(c)[:-1] for c in (n_left, n_right)]
        return np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(np.split(left, cuts[0]), np.split(right, cuts[1]))], np.int64)
    if not len(right):
        return np.zeros(n, np.int64)
    at = np.minimum(np.searchsorted(keys[1], keys[0]), len(right) - 1)
    same = (keys[1][at] == keys[0]) & (right[at] == left)
    return np.bincount(rows[0][same].astype(np.int64), minlength=n)


@F.arrow_udf(LongType())
def _n_common(left: pa.Array, right: pa.Array) -> pa.Array:
    sides = [x for own in (left, right) for x in (_cells(own).view(np.uint64), _sizes(own))]
    return pa.array(_in_common(*sides))


#: What is needed of a set at one of its tokens, besides the place.
AT = ("a", "b", "size", "at", "shared")


def _meetings(work: DataFrame, sets: Sets, shingle: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The entries of tokens that several sets have, with the earliest of these sets (``head``) and the round in which
    others meet them, and the sets' tokens."""
    repeated = repeated_values(lambda run, schema: sets.map(run, schema, ["prefix"]), sets.n_tokens)
    often = bit_filter(materialize(repeated, "repeated-tokens"), "value", RARE)
    entries = materialize(_entries(sets, often), "entries").select("token", F.struct(*PLACE).alias("place"), *AT, "level")
    groups = materialize(entries.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("place", *AT)).alias("head")).where("n > 1"), "token-groups")
    top = F.greatest(F.ceil(F.log(float(GROWTH), F.col("n") - 0.5)) - 1, F.lit(0))
    entries = materialize(entries.join(groups, "token").withColumn("last", top.cast("int")).withColumn("round", (top - F.least("level", top)).cast("int")).drop("level"), "meetings")
    return entries, materialize(_set_tokens(work, entries.select("place.*").distinct(), shingle, least), "set-tokens")


def _matched(entries: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame | None:
    """``place`` of the distinct sets that are similar to one at an earlier place, and ``of``, the place of such a one; None if
    no sets meet."""

    def named(side: str, of: str = "") -> list:
        return [F.col(of + c).alias(f"{side}_{c}") for c in ("place", *AT)]

    overlap = F.lit(similarity / (1 + similarity)) * (F.col("l_size") + F.col("r_size")) - 1e-6
    place_bound = F.least("l_shared", "r_shared") + F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at"))
    filters = (F.col("r_place") < F.col("l_place")) & (F.col("r_size") >= similarity * F.col("l_size") - 1e-6) & (F.col("l_size") >= similarity * F.col("r_size") - 1e-6) & (place_bound >= overlap)
    rounds = entries.agg(F.max("round")).first()[0]
    done = None
    for step in range(-1, -1 if rounds is None else rounds + 1):
        if step < 0:  # the earliest set of each token, which needs no join
            pairs = entries.select(*named("l"), *named("r", "head.")).where(filters)
        else:
            # of two sets one is the earliest, and rounds after the last find nothing
            rest = entries.where((F.col("n") > 2) & (F.col("last") >= step)).select("token", *named("l"))
            rest = rest.join(done.select(F.col("a").alias("l_a"), F.col("b").alias("l_b")), ["l_a", "l_b"], "left_anti")
            block = entries.where((F.col("round") == step) & (F.col("place") > F.col("head.place"))).select("token", *named("r"))
            pairs = rest.join(block, "token").where(filters)
        pairs = materialize(pairs.select("l_a", "l_b", "l_place", "r_a", "r_b", "r_place").distinct(), "pairs")
        # most sets are in no pair of a later round: a filter keeps their tokens out of the shuffle
        needed, _ = split_by(tokens, F.col("a"), pairs.select("l_a").union(pairs.select("r_a")))
        own, other = (needed.select(*(F.col(c).alias(f"{p}_{c}") for c in ("a", "b", "tokens"))) for p in ("l", "r"))
        checked = pairs.join(own, ["l_a", "l_b"]).join(other, ["r_a", "r_b"])
        checked = checked.withColumns({"common": _n_common("l_tokens", "r_tokens"), "total": ((F.length("l_tokens") + F.length("r_tokens")) / 8).cast("long")})
        similar = checked.where(F.col("common") >= similarity * (F.col("total") - F.col("common")) - 1e-9)
        new = materialize(similar.groupBy(F.col("l_a").alias("a"), F.col("l_b").alias("b")).agg(F.min("l_place").alias("place"), F.min("r_place").alias("of")), "matched")
        done = new if done is None else done.unionByName(new)
    return done


def later_matches(work: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, least: int = MIN_WORDS) -> DataFrame:
    """ord, th, line (from 0) of with_order() texts' lines that are similar to a line before them, and ``of`` (ord, th, line),
    such a line."""
    again, sets = _distinct(work, similarity, shingle, least)
    matched = _matched(*_meetings(work, sets, shingle, least), similarity)
    found = again.select(*PLACE, "of")
    return found if matched is None else found.unionByName(matched.select("place.*", "of"))


@F.arrow_udf(StringType())
def _kept_digest(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The SHA-256 of each text without the lines in ``gone``; null where that is null."""
    out = []
    for text, lines in zip(texts, gone.to_pylist()):
        if lines is None:
            out.append(None)
            continue
        own = set(lines)
        out.append(hashlib.sha256("\n".join(line for i, line in enumerate(text.as_py().split("\n")) if i not in own).encode()).hexdigest())
    return pa.array(out, pa.string())


def remove_later(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_removed`` and without the lines that are similar to an earlier line.

    Lines are split at line feeds; words are runs of anything but space and the controls 9 to 13. A line goes if a line
    before it, in a smaller key or earlier in the same text, has a set of ``shingle``-word tokens of Jaccard similarity
    ``similarity`` or more, whether or not that line goes itself. A line of fewer than ``shingle`` words is one token, so it
    goes if it has the words of an earlier line. Lines of fewer than ``least`` words stay, and blank lines always. Null
    texts stay null. Rows of equal keys count as ordered by a hash of their text, wholly equal rows as one text; null keys
    come last. A column called n_removed is replaced. No rows give no rows.
    """
    gone = materialize(later_matches(with_order(docs, key, text), similarity, shingle, least), "later-lines")
    own = docs.drop("n_removed").withColumns({"__ord": F.coalesce(F.col(key).cast("long"), F.lit(LAST)), "__th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    maybe, rest = split_by(own, F.col("__th"), gone.select("th").distinct())
    lines = gone.groupBy(F.col("ord").alias("__ord"), F.col("th").alias("__th")).agg(F.collect_set("line").alias("__gone"))
    cut = maybe.join(lines, ["__ord", "__th"], "left").withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    cut = cut.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
    columns = [*(c for c in docs.columns if c != "n_removed"), "n_removed"]
    return cut.select(*columns).unionByName(rest.withColumn("n_removed", F.lit(0).cast("long")).select(*columns))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key``, ``n_lines``, ``n_removed`` and ``kept_sha256`` (of the kept lines joined by line feeds) of each row."""
    gone = materialize(later_matches(with_order(docs, key, text), **options), "later-lines")
    lines = gone.groupBy("ord", "th").agg(F.collect_set("line").alias("gone"))
    maybe = _maybe_in(docs.sparkSession, bit_filter(gone.select("th").distinct(), "th"))
    own = docs.select(F.col(key), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("maybe", maybe("th"))
    n_lines = (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    # one pass over the texts: those that surely lose no line are digested as they are read, only the others are shuffled
    own = own.select(key, "ord", "th", n_lines, F.when(F.col("maybe"), F.col("text")).alias("text"), F.when(~F.col("maybe"), F.sha2("text", 256)).alias("all"))
    cut = own.join(lines, ["ord", "th"], "left").withColumn("own", _kept_digest("text", "gone"))
    return cut.select(key, "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.coalesce("own", "all", F.sha2("text", 256)).alias("kept_sha256"))
