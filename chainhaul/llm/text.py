"""Words and hashes of whole text batches, on Arrow buffers with NumPy.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; those
are ASCII, so working on UTF-8 bytes equals working on characters.  Words are
never cut or dropped.  Hashes are 64-bit polynomials over a fixed random byte
table, finished with an avalanche step; two different strings of a comparison
collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_NONSPACE = np.ones(256, dtype=bool)
_NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[U(1)], np.full(size - 1, self.base)]).cumprod(dtype=np.uint64)
                self.down = np.concatenate([[U(1)], np.full(size - 1, self.inverse)]).cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


_BYTES = _Powers(_BASE, _INV)
_W = U(0xD6E8FEB86659FD93)
_WORDS = _Powers(_W, U(pow(int(_W), -1, 1 << 64)))


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Chunk:
    """The words of the rows ``first`` to ``last`` of a batch.

    data: their UTF-8 bytes; offs: byte offsets by row; start, end: byte ranges
    of words; woffs: word offsets by row.
    """

    def __init__(self, first: int, data: np.ndarray, offs: np.ndarray):
        self.first, self.data, self.offs = first, data, offs
        self.rows = len(offs) - 1
        n = len(data)
        solid = _NONSPACE[data]
        begins = offs[:-1][offs[:-1] < n]
        start = solid.copy()
        if n:
            start[1:] &= ~solid[:-1]
            start[begins] = solid[begins]
        end = solid.copy()
        if n:
            end[:-1] &= ~solid[1:]
            last = offs[1:][offs[1:] > 0] - 1
            end[last] = solid[last]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.woffs = np.searchsorted(self.start, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.woffs)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def prefix(self, lower: bool = False) -> np.ndarray:
        up, _ = _BYTES.upto(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((_LOWER if lower else _TABLE)[self.data] * up[:-1], out=out[1:])
        return out

    def range_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _BYTES.upto(len(self.data) + 1)
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.range_hash(self.prefix(lower), self.start, self.end)

    def row_bytes(self, row: int) -> bytes:
        return self.data[self.offs[row] : self.offs[row + 1]].tobytes()


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; the last n-1 places are left out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORDS.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * up[:-1], out=total[1:])
        return mix((total[n:] - total[:-n]) * down[:m] + U(n) * U(0x8CB92BA72F3D8DD7))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a column in runs of about ``size`` bytes, whole rows each."""
    data, offs = buffers(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
        last = min(last, n)
        yield Chunk(first, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


class Lookup:
    """Places of 64-bit keys, by open addressing; -1 for keys that aren't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, dtype=np.uint64)
        bits = max(8, (max(1, len(self.keys)) * 4 - 1).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        todo = np.arange(len(self.keys))
        at = (mix(self.keys) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            left = self.slot[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.keys) or not len(h):
            return out
        at = (mix(h) >> self.shift).astype(np.int64)
        got = self.slot[at]
        hit = (got >= 0) & (self.keys[got] == h)
        out[hit] = got[hit]
        todo = np.flatnonzero(~hit & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.slot[at[todo]]
            hit = (got >= 0) & (self.keys[got] == h[todo])
            out[todo[hit]] = got[hit]
            todo = todo[~hit & (got >= 0)]
        return out


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def repeat_ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)
