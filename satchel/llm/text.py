"""Vectorised work on UTF-8 text inside tasks: Arrow string columns as byte arrays, words, and rolling hashes.

Hashes are sums of ``value[i] * BASE**i`` modulo 2**64, so that the hash of any slice follows from two prefix sums;
a finaliser mixes the bits. A slice is at most a few hundred bytes or words, and equal slices have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 1 << 16
#: A word is a run of anything but space and the controls 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
_POSITION_BITS = np.uint64((1 << 24) - 1)
_POSITIONS = 1 << 22


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i < n; grown on demand."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (BASE, BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where possible."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * BASE**i``, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` consecutive values; empty if there are fewer."""
    if len(values) < width:
        return np.empty(0, np.uint64)
    sums = prefix_sums(values)
    return mix((sums[width:] - sums[:-width]) * powers(len(sums))[1][: len(sums) - width])


#: Words of more bytes are hashed by prefix sums.
SHORT_WORD = 64
_BLOCK_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice of bytes, by blocks of 8 bytes; slices may be long, most should be short."""
    blocks = np.ndarray(len(data), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    size = ends - starts
    out = (blocks[starts] & _BLOCK_MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _LENGTH
    out = mix(out)
    more = np.flatnonzero((size > 8) & (size <= SHORT_WORD))
    at, done = starts[more], 8
    while len(more):
        out[more] = mix(out[more] * BASE + (blocks[at + done] & _BLOCK_MASKS[np.minimum(size[more] - done, 8)]))
        done += 8
        left = size[more] > done
        more, at = more[left], at[left]
    long = np.flatnonzero(size > SHORT_WORD)
    if len(long):
        out[long] = slice_hashes(prefix_sums(byte_values(data)), starts[long], ends[long])
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def sliding_min_position(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the position of its least one, in O(n) by block-wise minima.

    Hashes are compared by their upper 40 bits and then by position, so equal windows choose equal offsets."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if len(values) > _POSITIONS:
        step = _POSITIONS - width
        return np.concatenate([lo + sliding_min_position(values[lo : lo + step + width - 1], width) for lo in range(0, n, step)])
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    np.bitwise_and(values, ~_POSITION_BITS, out=padded[: len(values)])
    padded[: len(values)] |= np.arange(len(values), dtype=np.uint64)
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & _POSITION_BITS).astype(np.int64)


@dataclass
class Chunk:
    """Some whole texts of a batch: rows lo to hi, their bytes, and where each text starts (one entry more than texts)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and where each text's words begin (one entry more than texts)."""
        n = len(self.data)
        space = np.ones(n + 2, bool)
        np.less_equal(self.data - np.uint8(9), 4, out=space[1:-1])  # IS_SPACE by comparisons, which are several times faster
        space[1:-1] |= self.data == 32
        turns = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = turns[::2], turns[1::2]
        inside = self.offsets[~(space[self.offsets] | space[self.offsets + 1])]  # words of two texts that touch
        if len(inside):
            inside = inside[np.diff(inside, prepend=-1) > 0]
            at = np.searchsorted(ends, inside)
            starts, ends = np.insert(starts, at + 1, inside), np.insert(ends, at, inside)
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Splits a string column into chunks of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
