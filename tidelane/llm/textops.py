"""Vectorised word and shingle hashing over Arrow string columns.

Texts are handled as UTF-8 bytes, a few megabytes at a time, so one pass costs a
handful of numpy operations per byte and memory stays bounded by the longest
single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SLICE_BYTES = 1 << 22

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C1B)  # odd, 3 modulo 8
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_LOWER = _BYTE[_LOWER]
#: Delimiters of words of letters and digits; bytes of multi-byte characters count as letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def _slices(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> Iterator[np.ndarray]:
    """The texts in parts of about SLICE_BYTES that end between words, each as offsets; the cut texts count as several."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + SLICE_BYTES, end)
        if to < end:
            gap = np.flatnonzero(space[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:  # a word that is longer than a slice is a slice
                step = 1 << 16
                while to < end and not space[data[to : to + step]].any():
                    to += step
                to = min(to + int(np.argmax(space[data[to : to + step]])), end) if to < end else end
        inner = offsets[(offsets > at) & (offsets < to)]
        yield np.concatenate([[at], inner, [to]])
        at = to


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, starts, ends, first)``: a 64-bit hash and the byte range of each word, and for each text the index of its first word.

    A word is a run of bytes that ``space`` doesn't mark - by default space and 0x09-0x0D; A-Z count as a-z. ``first`` has one entry more than texts. Long texts are read in slices, so that
    memory beside the result - 24 bytes a word - is that of a slice.
    """
    if int(offsets[-1]) - int(offsets[0]) <= 2 * SLICE_BYTES:
        return _words(data, offsets, space)
    found = [_words(data, own, space)[:3] for own in _slices(data, offsets, space)]
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def _words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    bounds = offsets - base
    inside = ~space[part]
    edge = np.empty(len(part) + 1, bool)
    edge[0] = True
    edge[1:] = ~np.append(inside[:-1], False) if len(part) else True
    edge[bounds] = True  # a text's end is a word's end too
    starts = np.flatnonzero(inside & edge[:-1])
    after = np.empty(len(part), bool)
    if len(part):
        after[:-1] = ~inside[1:]
        after[-1] = True
        after[bounds[(bounds > 0)] - 1] = True
    ends = np.flatnonzero(inside & after) + 1
    power = np.cumprod(np.full(len(part), _R, np.uint64)) if len(part) else np.zeros(0, np.uint64)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[part] * power, out=sums[1:])
    inverse = np.cumprod(np.full(len(part), _R_INV, np.uint64)) if len(part) else power
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts + base, ends + base, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct ``width``-word shingles as 64-bit hashes; the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * _STEP[k]
    rolled = mix64(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield mix64((hashes[a:b] * _STEP[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield rolled[:0]


_HELD: list[Callable[[], None]] = []


def on_release(drop: Callable[[], None]) -> None:
    """Registers what drops a cache that a worker keeps between tasks."""
    _HELD.append(drop)


def released(batches: Iterator) -> Iterator:
    """The same batches, in a worker that gives memory back: before the first, registered caches of earlier tasks go; after the last, what was freed returns to the system, as workers stay for later tasks."""
    for drop in _HELD:
        drop()
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass
