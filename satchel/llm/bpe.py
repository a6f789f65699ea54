"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are split by the tokenizer's pattern. The distinct pieces of a batch are grouped by byte length into padded
matrices of token ids, a row per piece. In each round every row merges its leftmost pair of least rank; pairs are looked
up in a hash table of numpy arrays, rows shift left over the gap (compaction), and finished rows leave the matrix.
Pieces over ``LONG_PIECE`` bytes merge all occurrences of their least pair in a round, unless a pair that arises on the
way would come before it: the ids are the same. Encoded pieces are kept in a cache of bounded size, which ends with the
task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satchel.llm.store import gives_back
from satchel.llm.text import chunks

NO_RANK = np.int32(np.iinfo(np.int32).max)
LONG_PIECE = 512
#: Estimated bytes of encoded pieces that a task keeps, and those of a piece besides its text and ids.
CACHE_BYTES = 32 << 20
PIECE_BYTES = 330
#: Bytes of text that are encoded together.
GROUP_BYTES = 1 << 20


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """(left id, right id) -> merged id by open addressing in two numpy arrays."""

    def __init__(self, tokens: list[bytes]):
        ids = {token: i for i, token in enumerate(tokens) if token}
        keys, values = [], []
        for token, merged in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(merged)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        left, slots = np.array(keys, np.int64), self._slot(np.array(keys, np.int64))
        merged = np.array(values, np.int32)
        while len(left):
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.keys[slots[take]], self.values[slots[take]] = left[take], merged[take]
            left, merged, slots = left[~take], merged[~take], (slots[~take] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, which is its rank, or NO_RANK."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        keys[(left < 0).ravel() | (right < 0).ravel()] = -2
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NO_RANK)
        left_over = np.flatnonzero((found != keys) & (found != -1))
        while len(left_over):
            slots[left_over] = (slots[left_over] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[left_over]]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.values[slots[left_over[hit]]]
            left_over = left_over[~hit & (found != -1)]
        return out.reshape(left.shape)


class Codec:
    """Encoder and decoder for one rank file and split pattern; encode pieces of a batch at once."""

    def __init__(self, path: str, pattern: str):
        self.tokens = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(self.tokens)
        self.whole = {token: i for i, token in enumerate(self.tokens) if token}
        self.byte_ids = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Empties the cache of encoded pieces."""
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.cached_bytes = 0

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. A piece that is itself a token is that token."""
        out: list[list[int]] = [[self.whole[p]] if p in self.whole else [] for p in pieces]
        todo = [i for i, p in enumerate(pieces) if p and not out[i]]
        lengths = np.array([len(pieces[i]) for i in todo], np.int64)
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 64, 128, 256, LONG_PIECE):
            rows = [todo[i] for i in np.flatnonzero((lengths > low) & (lengths <= high))]
            step = max(1, (1 << 18) // high)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([pieces[j] for j in part], high)):
                    out[i] = ids
            low = high
        for i in np.flatnonzero(lengths > LONG_PIECE):
            out[todo[i]] = self._long(pieces[todo[i]])
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = np.full(ids.shape, NO_RANK)
        ranks[:, :-1] = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            merged = ranks[each, at]
            done = merged == NO_RANK
            if done.any():
                for row, values, n in zip(rows[done], ids[done].tolist(), (ids[done] >= 0).sum(axis=1)):
                    out[row] = values[:n]
                rows, ids, ranks, at, merged = rows[~done], ids[~done], ranks[~done], at[~done], merged[~done]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            keep = columns != (at + 1)[:, None]  # compaction: the right half of the merged pair goes
            ids[each, at] = merged
            shape = (len(rows), width - 1)
            ids = np.concatenate((ids[keep].reshape(shape), np.full((len(rows), 1), np.int32(-1))), axis=1)
            ranks = np.concatenate((ranks[keep].reshape(shape), np.full((len(rows), 1), NO_RANK)), axis=1)
            right = np.minimum(at + 1, width - 1)
            ranks[each, at] = np.where(at + 1 < width, self.pairs.ranks(merged, ids[each, right]), NO_RANK)
            before = np.maximum(at - 1, 0)
            ranks[each, before] = np.where(at > 0, self.pairs.ranks(ids[each, before], merged), ranks[each, before])
        return out

    def _long(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            ranks = self.pairs.ranks(ids[:-1], ids[1:])
            least = ranks.min()
            if least == NO_RANK:
                break
            hits = np.flatnonzero(ranks == least)
            # of a run of overlapping pairs every second one merges, from the left
            runs = np.concatenate(([True], np.diff(hits) > 1))
            hits = hits[(hits - hits[runs][np.cumsum(runs) - 1]) % 2 == 0]
            around = np.concatenate(([-1], ids, [-1, -1]))
            new = np.full(len(hits), least)
            if min(self.pairs.ranks(around[hits], new).min(), self.pairs.ranks(new, around[hits + 3]).min(), self.pairs.ranks(new, new).min()) < least:
                hits = hits[:1]  # a pair that arises on the way comes first
            ids[hits] = least
            ids = np.delete(ids, hits + 1)
        return ids.tolist()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, and the ids as decimals joined by commas."""
        pieces = [self.split(text) for text in texts]
        if self.cached_bytes > CACHE_BYTES:
            self.forget()
        known = self.cache
        new = list({p for found in pieces for p in found if p not in known})
        raw = [p.encode() for p in new]
        for piece, ids in zip(new, self.encode_pieces(raw)):
            known[piece] = (np.array(ids, np.int32).tobytes(), ",".join([self.decimal[i] for i in ids]))
            self.cached_bytes += PIECE_BYTES + 2 * len(piece) + 10 * len(ids)
        out = []
        for found in pieces:
            entries = [known[p] for p in found]
            out.append((np.frombuffer(b"".join([e[0] for e in entries]), np.int32), ",".join([e[1] for e in entries])))
        return out

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes of the tokens, gathered from one array of all tokens' bytes."""
        tokens = np.asarray(ids, np.int64)
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.blob[np.arange(ends[-1]) + np.repeat(self.starts[tokens] - ends + lengths, lengths)].tobytes()


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, rank file and pattern."""
    return Codec(path, pattern)


def _grouped(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    values = batch.column(column)
    for chunk in chunks(values, GROUP_BYTES):
        yield chunk.lo, chunk.hi, ["" if t is None else t for t in values.slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Token ids of every whole text, with no special tokens.

    docs: any table with a string column ``text``. ranks: path of a rank file, the same on every executor.
    Returns the columns ``keep`` (all but ``text`` by default, unless they are called ``ids``) and ``ids`` (array of int).
    Null and empty texts give an empty array; a table without rows gives no rows; repeated rows are each encoded.
    """
    keep = [c for c in docs.columns if c not in (text, "ids")] if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for lo, hi, texts in _grouped(batch, "__text"):
                kept = batch.slice(lo, hi - lo)
                ids = _lists([ids for ids, _ in own.encode(texts)])
                yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(keep))), ids], names=[*keep, "ids"])
        own.forget()

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``text``, the decoded bytes read as UTF-8 (broken sequences become the replacement character). Null ids
    give a null text."""
    keep = [c for c in encoded.columns if c not in (ids, "text")]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            texts = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*(F.col(f"`{c}`") for c in keep), F.col(ids).alias("__ids")).mapInArrow(run, schema)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text in one pass; returns ``key``, DIGESTS, and ``ids`` if asked for.

    Null counts as empty, and an empty text has no tokens. Each row gives a row: repeated rows and rows with null keys too.
    Other columns are not read, whatever their names. A table without rows gives no rows."""
    kind = docs.schema[key].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for lo, hi, texts in _grouped(batch, "text"):
                encoded = own.encode(texts)
                of_ids = [hashlib.sha256(joined.encode()).hexdigest() for _, joined in encoded]
                of_bytes = [hashlib.sha256(own.decode(ids)).hexdigest() for ids, _ in encoded]
                columns = {key: batch.column(0).slice(lo, hi - lo), "n_tokens": pa.array([len(ids) for ids, _ in encoded], pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}
                if with_ids:
                    columns["ids"] = _lists([ids for ids, _ in encoded])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        own.forget()

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, {DIGESTS}" + ", ids array<int>" * with_ids)
