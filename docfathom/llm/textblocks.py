"""Vectorised views of Arrow text columns: whole texts as one byte buffer.

Every operator that has to look at each byte of each text works on *blocks*:
consecutive rows of an Arrow batch whose texts together hold at most
``BLOCK_BYTES`` bytes (a longer text is a block by itself).  A block is the
UTF-8 buffer as a ``uint8`` array with the start offsets of its rows, so that
hashing, splitting and counting are array operations and the memory in use is
a small multiple of one block, whatever the table's size.

A null text counts as an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

_U = np.uint64
#: Odd multipliers of the hashes below (fixed values).
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


class Block:
    """Rows ``lo:hi`` of a batch: ``data`` bytes, ``off`` row offsets (len n+1)."""

    __slots__ = ("batch", "data", "hi", "lo", "off")

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, off: np.ndarray):
        self.batch, self.lo, self.hi, self.data, self.off = batch, lo, hi, data, off

    def __len__(self) -> int:
        return self.hi - self.lo

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name)).slice(self.lo, self.hi - self.lo)

    def ints(self, name: str) -> np.ndarray:
        return np.asarray(self.column(name).to_numpy(zero_copy_only=False), dtype=np.int64)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of at most ``limit`` bytes of ``column``."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null("")
        wide = pa.types.is_large_string(text.type)
        _, offsets, data = text.buffers()
        off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            yield Block(batch, lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a uint64 array."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    return mix((np.arange(1, 257, dtype=np.uint64)) * _U(_BASE))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""

    def of(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    return _powers(size)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows (see ``range_hash``)."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_table()[data] * p[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``start:end``; equal ranges hash equally wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _MIX2)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


def words(data: np.ndarray, off: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: starts, ends, and the index of each row's first word (len n+1).

    ``solid`` marks the bytes of words; by default words are ``[^\\x20\\x09-\\x0D]+``.
    """
    if solid is None:
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(len(data), dtype=bool)
    before[1:] = solid[:-1]
    after = np.empty(len(data), dtype=bool)
    after[:-1] = solid[1:]
    edges = off[:-1][off[:-1] < len(data)]
    before[edges] = False
    last = off[1:] - 1
    after[last[last >= 0]] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, off)


def word_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """Words that follow each other as one Arrow column."""
    length = end - start
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    chars = data[np.repeat(start, length) + ragged(length)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(chars))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
