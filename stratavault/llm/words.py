"""Vectorised word hashing over whole Arrow batches.

Texts stay UTF-8 bytes in one buffer; word bounds come from a fixed number of
numpy passes over that buffer.  A word's 64-bit hash chains its 8-byte groups
through a mixing function, one pass for each group over the words that are that
long; words beyond 128 bytes take a keyed BLAKE2 digest instead.  (A polynomial
modulo 2**64 would be simpler, but words with the Thue-Morse pattern collide
under it whatever its base.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of the longest word that is hashed by groups.
_LONG = 128
_KEY = b"stratavault words"
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds), in a new array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word ``data[start:end]``."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    rows = np.flatnonzero(size <= _LONG)
    at, left = starts[rows], size[rows]
    while len(rows):
        out[rows] = mix((out[rows] ^ (wide[at] & _KEEP[np.minimum(left, 8)])) + _U(0x9E3779B97F4A7C15))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8, key=_KEY).digest(), "little")
    return out


@dataclass
class Words:
    """The words of a run of texts.  ``first`` has one more entry than texts:
    words of text i are first[i]:first[i+1].  starts/ends are byte places."""

    data: np.ndarray
    text_first: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 byte places of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if at is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    places = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def split(data: np.ndarray, places: np.ndarray, lower: bool = False) -> Words:
    """Find and hash the words of texts that lie one after another in ``data``."""
    n = len(data)
    if lower and n:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = places[:-1][places[:-1] < n]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    end = inside.copy()
    if n:
        end[:-1] &= _ends(inside, places)
    ends = np.flatnonzero(end) + 1
    first = np.searchsorted(starts, places).astype(np.int64)
    hashes = _hash(data, starts, ends)
    return Words(data, places, first, starts, ends, hashes)


def _ends(inside: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For bytes 0 to n-2: whether a word that covers the byte ends with it."""
    after = ~inside[1:]
    tails = places[1:-1]
    tails = tails[(tails > 0) & (tails < len(inside))] - 1
    after[tails] = True
    return after


def pieces(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes (one text at least)."""
    _, places = buffers(column)
    at, n = 0, len(places) - 1
    while at < n:
        to = int(np.searchsorted(places, places[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive word hashes, for every start; the
    caller masks starts whose gram would leave its text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += hashes[j : j + n]
    return mix(out)


def gram_rows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all grams that stay inside their text, and the text of each."""
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    at = np.arange(len(rows)) - before[rows] + first[:-1][rows]
    return at, rows
