"""Vectorised kernels over the UTF-8 bytes of many texts at once.

Texts of an Arrow batch lie end to end in one buffer; the kernels walk that buffer with numpy in
blocks of bounded size, so the memory of a worker does not depend on how long the texts are, save
for a single text that is longer than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from ctypes import CDLL
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that a block of texts holds at most, unless one text alone is longer.
BLOCK_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CONTINUATION = (np.arange(256) & 0xC0) == 0x80

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1, 1 << 63, (2, 3), dtype=np.uint64) * U64(2) + U64(1)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: A range longer than this is hashed by itself.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def give_back() -> None:
    """Hands freed memory to the system; a worker that waits for its next task would hold it else."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one at once, and sent on, stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def released(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands freed memory back when it has ended."""

    def run(batches: Iterator) -> Iterator:
        yield from rows(batches)
        give_back()

    return run


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], (offsets[row : end + 1] - offsets[row]).astype(np.int64)
        row = end


def _eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place of the data on, as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, f"{order}u8", padded, strides=(1,))


def _first(eights: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bytes of each, n from 1 on."""
    return eights & (U64(0xFFFFFFFFFFFFFFFF) >> ((U64(8) - np.minimum(n, 8).astype(U64)) * U64(8)))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; each lane is a hash of its own.

    Eight bytes at a time are taken in by bijective steps that are not linear, so ranges of one size up to 8 bytes never
    collide, and longer ones by chance alone.
    """
    eights, size = _eights(data), end - start
    out = mix(size.astype(U64) * _ODD[lane, 0] + _ODD[lane, 1])
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = start[live], size[live]
    while len(live):
        out[live] = mix((out[live] ^ _first(eights[at], left)) * _ODD[lane, 2])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        out[i] = np.frombuffer(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), U64)[0]
    return out


def _both(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    return mix(a * _ODD[lane, 1] + mix(b ^ _ODD[lane, 0]) * _ODD[lane, 2])


def windows(data: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of ``length`` bytes of the data, by their places.

    Hashes of 8 bytes are paired to those of 16, 32 and so on by steps that are not linear, and the parts of the length
    put together.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    eights = _eights(data)[: len(data)]
    if length < 8:
        return mix(_first(eights[:n], np.array([length])) * _ODD[lane, 2])
    part, size, at = mix((eights[: len(data) - 7] ^ _ODD[lane, 1]) * _ODD[lane, 2]), 8, 0
    # What the eights leave over is in one more that ends with the window.
    out = part[length - 8 :][:n] if length % 8 else np.full(n, _ODD[lane, 0])
    while True:
        if length & size:
            out = _both(out, part[at : at + n], lane)
            at += size
        if 2 * size > length:
            break
        part = _both(part[: len(part) - size], part[size:], lane)
        size *= 2
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and their number) of the words of a block.

    A word is a longest run of bytes other than space and U+0009 to U+000D within one text.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    opens[first] = inside[first]
    closes = np.zeros(n, bool)
    closes[:-1] = inside[:-1] & (~inside[1:] | opens[1:])
    closes[-1] = inside[-1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets)


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, bounds by text). short: a text of 1 to n-1 words gives one run of all its words."""
    counts = np.diff(bounds)
    m = len(hashes)
    full = max(0, m - n + 1)
    acc = np.zeros(full, U64)
    for i in range(n):
        acc += hashes[i : i + full] * _GRAM[i]
    keep = np.zeros(m + 1, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    ok = np.arange(m) + n <= bounds[1:][text] if m else np.zeros(0, bool)
    few = np.flatnonzero((counts > 0) & (counts < n)) if short else np.zeros(0, np.int64)
    out = np.zeros(m, U64)
    out[:full] = mix(acc)
    for t in few:
        w = hashes[bounds[t] : bounds[t + 1]]
        with np.errstate(over="ignore"):
            out[bounds[t]] = mix((w * _GRAM[: len(w)]).sum(keepdims=True, dtype=U64) + U64(len(w)))[0]
        ok[bounds[t]] = True
    keep[1:] = np.cumsum(ok)
    return out[ok], keep[bounds]
