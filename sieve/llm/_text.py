"""Vectorised byte kernels over Arrow text columns.

All kernels work on the UTF-8 bytes of a block of whole documents: one uint8
array plus document offsets.  Blocks are slices of a record batch holding about
``BLOCK`` bytes (a longer document is a block of its own), which bounds memory
whatever the batch size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 21
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV_BASE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# 1 where the byte belongs to a word
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK // 2 + 65536)
        for k, base in enumerate((_BASE, _INV_BASE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that all bits depend on all bits."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK):
    """Yield (slice of the batch, bytes, offsets) with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    data, offsets = column_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Prefix:
    """Polynomial prefix sums: the hash of any byte range in constant time.

    Made for windows of a text; crafted ranges of a thousand bytes and more can have one hash, so words go through ``Loads``.
    """

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * power[: len(data)], dtype=U64, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U64))


LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


class Loads:
    """Loads of up to eight bytes at any places of an array, and hashes and comparisons of byte ranges made of them."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        self.bytes[: len(data)] = data
        self.words = self.bytes.view("<u8")

    def get(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes from ``at``, at most ``size``, as little-endian numbers."""
        i, shift = at >> 3, ((at & 7) << 3).astype(U64)
        value = self.words[i] >> shift | (self.words[i + 1] << (U64(63) - shift)) << U64(1)
        return value & _MASKS[np.minimum(size, 8)]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: eight bytes a step, and xxh3 for those over ``LONG``."""
        size = end - start
        h = mix(mix(size.astype(U64) + U64(_BASE)) ^ self.get(start, size))
        rest, step = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(rest):
            h[rest] = mix(h[rest] * U64(_BASE) ^ self.get(start[rest] + step, size[rest] - step))
            step += 8
            rest = rest[size[rest] > step]
        for i in np.flatnonzero(size > LONG):
            h[i] = xxhash.xxh3_64_intdigest(self.bytes[start[i] : end[i]])
        return h

    def equal(self, at: np.ndarray, size: np.ndarray, other: Loads, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ranges hold the same bytes as ranges of another array."""
        same = (size == length) & (self.get(at, size) == other.get(place, length))
        rest, step = np.flatnonzero(same & (size > 8)), 8
        while len(rest) and step < LONG:
            same[rest] = self.get(at[rest] + step, size[rest] - step) == other.get(place[rest] + step, size[rest] - step)
            step += 8
            rest = rest[same[rest] & (size[rest] > step)]
        for i in rest:
            same[i] = np.array_equal(self.bytes[at[i] : at[i] + size[i]], other.bytes[place[i] : place[i] + size[i]])
        return same


class Distinct(NamedTuple):
    """Distinct byte ranges of a block, ascending by hash; ``entry`` gives each range's."""

    loads: Loads
    hash: np.ndarray
    start: np.ndarray
    size: np.ndarray
    entry: np.ndarray


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Distinct:
    """Ranges of one entry have been compared byte for byte: different ones with one hash have entries of their own."""
    loads, size = Loads(data), end - start
    h = loads.hash(start, end)
    unique, first, entry = np.unique(h, return_index=True, return_inverse=True)
    same = loads.equal(start, size, loads, start[first][entry], size[first][entry])
    if not same.all():
        ordinal = np.zeros(len(h), U64)
        seen: dict[int, dict[bytes, int]] = {}
        for i in np.flatnonzero(np.isin(entry, entry[~same])):
            own = seen.setdefault(int(h[i]), {})
            ordinal[i] = own.setdefault(loads.bytes[start[i] : end[i]].tobytes(), len(own))
        unique, first, entry = np.unique(np.stack([h, ordinal], 1), axis=0, return_index=True, return_inverse=True)
        unique, entry = unique[:, 0], entry.reshape(-1)
    return Distinct(loads, unique, start[first], size[first], entry)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes inside a document, and first word of each document (with the total last)."""
    inside = member[data]
    flips = np.zeros(len(data) + 1, bool)
    flips[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        flips[0] = inside[0]
        flips[-1] = inside[-1]
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[inside[cut] & inside[cut - 1]]  # a run goes on over the end of a document
        edges = np.flatnonzero(flips)
        if len(cut):
            edges = np.sort(np.concatenate([edges, cut, cut]))
    else:
        edges = np.zeros(0, np.int64)
    start, end = edges[0::2], edges[1::2]
    return start, end, np.searchsorted(start, offsets, "left")


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of h (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0x2545F4914F6CDD1D)
        out += h[j : j + n]
    return mix(out + U64(k))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i]+1, ... of all ranges, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    step = np.ones(total, np.int64)
    step[0] = start[0]
    step[np.cumsum(length)[:-1]] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(step)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]] for each document d."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def map_text(df, text: str, kernel, schema: str, keep: list[str], extra: list[str] = ()):
    """Apply ``kernel(block, data, offsets) -> list of arrays`` to blocks of whole texts.

    ``keep`` names the input columns handed on unchanged in front of the kernel's
    columns, ``extra`` further columns the kernel reads; ``schema`` is the DDL of the
    whole output.  Other columns, whatever their names, play no part.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    columns = [F.col(c) for c in dict.fromkeys([*keep, *extra, text])]
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, text):
                arrays = [block.column(block.schema.get_field_index(c)) for c in keep] + kernel(block, data, offsets)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*columns).mapInArrow(run, schema)


def kind(df, column: str) -> str:
    """DDL type of a column."""
    return df.schema[column].dataType.simpleString()


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow array of strings; the ranges must hold whole characters."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ragged(start, size)])))


def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[str]:
    return gather(data, start, size).to_pylist()


class WordCache:
    """Ids of the distinct words seen lately: flat arrays, found by 64-bit hash and told apart by their bytes."""

    TEXT = 16 << 20  # bytes of words kept

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, U64)  # ascending
        self.row = np.zeros(0, np.int32)
        self.count = self.used = self.written = 0
        self.pool = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.text = Loads(np.zeros(1 << 18, np.uint8))
        self.place = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)

    def rows(self, words: Distinct, encode) -> np.ndarray:
        """Rows (into start and size) of distinct words; ``encode(new)`` gets the positions of unknown ones and returns
        (flat ids, ids per word).  Of words with one hash only the first seen is found again."""
        if len(self.known) > self.limit or self.written > self.TEXT:
            self.clear()
        at = np.searchsorted(self.known, words.hash)
        inside = np.minimum(at, max(0, len(self.known) - 1))
        taken = self.known[inside] == words.hash if len(self.known) else np.zeros(len(words.hash), bool)
        rows = np.full(len(words.hash), -1, np.int64)
        old = np.flatnonzero(taken)
        own = self.row[at[old]]
        same = words.loads.equal(words.start[old], words.size[old], self.text, self.place[own], self.length[own])
        rows[old[same]] = own[same]
        new = np.flatnonzero(rows < 0)
        if len(new):
            flat, size = encode(new)
            first, self.count = self.count, self.count + len(new)
            self.start, self.size, self.place, self.length = (_grown(x, self.count) for x in (self.start, self.size, self.place, self.length))
            self.pool = _grown(self.pool, self.used + len(flat))
            rows[new] = first + np.arange(len(new))
            self.start[rows[new]] = self.used + np.cumsum(size) - size
            self.size[rows[new]] = size
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            keep = new[~taken[new] & (np.concatenate([[True], words.hash[1:] != words.hash[:-1]]))[new]]
            self._write(words, keep, rows[keep])
            self.known = np.insert(self.known, at[keep], words.hash[keep])
            self.row = np.insert(self.row, at[keep], rows[keep].astype(np.int32))
        return rows

    def _write(self, words: Distinct, which: np.ndarray, rows: np.ndarray) -> None:
        """Keep the bytes of words, each from a multiple of eight."""
        size = words.size[which]
        room = (size + 7) >> 3 << 3
        place = self.written + np.cumsum(room) - room
        self.place[rows], self.length[rows] = place, size
        self.written += int(room.sum())
        if self.written + 16 > len(self.text.bytes):
            self.text = Loads(_grown(self.text.bytes, self.written + 16))
        self.text.bytes[ragged(place, size)] = words.loads.bytes[ragged(words.start[which], size)]

    def ids(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words of these rows, one after another, and the number of each word."""
        size = self.size[row].astype(np.int64)
        return self.pool[ragged(self.start[row], size)], size


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])
