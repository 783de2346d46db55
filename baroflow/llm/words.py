"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python loop over words.

A chunk of texts is one byte array. A word's hash is a polynomial in its bytes modulo 2^64,
read off a running sum at the word's two ends, then mixed. Equal words have equal hashes in
every task; 2^64 leaves a handful of chance collisions only beyond some 10^9 distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 4
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUE = _BYTE_VALUE * np.uint64(2) + np.uint64(1)

#: Per byte, its value in a hash with A-Z lower-cased.
LOWER = _BYTE_VALUE.copy()
LOWER[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]

#: Bytes outside ``[\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII letters and every byte of a non-ASCII character.
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = LETTER[128:] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        factors = np.full(max(n, CHUNK_BYTES + 65536), base, np.uint64)
        factors[0] = 1
        have = _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk(NamedTuple):
    """Some rows of a batch: ``data[offsets[i]:offsets[i + 1]]`` is the text of row ``start + i``."""

    start: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """``first[i]:first[i + 1]`` are row i's words; ``begin`` and ``end`` are byte positions in the chunk."""

    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[Chunk]:
    """Rows in order, about ``limit`` bytes and at most ``rows`` rows at a time; a longer text is
    a chunk of its own. Null is empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n, start + (rows or n))
        base = offsets[start]
        yield Chunk(start, data[base : offsets[stop]], offsets[start : stop + 1] - base)
        start = stop


def span_hashes(chunk: Chunk, value: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each ``(begin, end)`` of byte positions, the hashes of the bytes between."""
    n = len(chunk.data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(value[chunk.data] * _power("up", _BASE, n)[:n], out=sums[1:])
    down = _power("down", _INVERSE, n + 1)
    return [mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)) for begin, end in spans]


def words(chunk: Chunk, member: np.ndarray = NOT_SPACE, value: np.ndarray = LOWER) -> Words:
    """Maximal runs of ``member`` bytes in each row, hashed with the byte values ``value``."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)
    inside = member[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    begin = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    hashes = span_hashes(chunk, value, (begin, end))[0]
    return Words(hashes, np.searchsorted(begin, offsets), begin, end)


def hash_word(word: bytes, value: np.ndarray = LOWER) -> int:
    """The hash that :func:`words` gives this word."""
    chunk = Chunk(0, np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    return int(words(chunk, np.ones(256, bool), value).hashes[0])


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte plane by byte plane, which compresses well."""
    delta = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
