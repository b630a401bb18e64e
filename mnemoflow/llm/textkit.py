"""Vectorised words and hashes over Arrow text columns (numpy, no per-word Python).

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. All of those separators are single UTF-8 bytes that
never occur inside a longer sequence, so the byte buffers are cut directly.

A word's hash is a keyed chain of non-linear mixing steps over its bytes, eight at a time; no two words
of the same length up to eight bytes share one, and the structured words that make a polynomial
modulo a power of two collide do not. Windows have two Rabin-Karp hashes: one modulo 2**64 and one in
the prime field of 2**31 - 1, whose errors have nothing in common.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as arrays at a time.
SLICE_BYTES = 1 << 20

#: Longer words are hashed by a keyed BLAKE2 instead of by steps of eight bytes.
LONG_WORD = 256
#: Powers that stay in memory.
KEPT_POWERS = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: _FIRST[n] keeps the first n bytes of a little-endian number of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_MASK = (1 << 64) - 1
_WORD_KEY = b"words of a corpus"
ROLL_BASES = (0xD1342543DE82EF95, 0x2C5E8F3B)
PRIME = (1 << 31) - 1


def _mod_prime(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


class _Powers:
    """base**i and base**-i, modulo 2**64 or the prime; up to KEPT_POWERS of each are remembered."""

    def __init__(self, base: int, prime: bool) -> None:
        self.bases, self.prime = (base, pow(base, -1, PRIME if prime else 1 << 64)), prime
        self.kept = (np.ones(1, np.uint64),) * 2

    def _table(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        if not self.prime:
            out[1:] = base
            return np.cumprod(out)
        done, power = 1, base % PRIME
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = _mod_prime(out[:more] * np.uint64(power))
            done, power = done + more, power * power % PRIME
        return out

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.kept[0]) >= n:
            return self.kept[0][:n], self.kept[1][:n]
        found = tuple(self._table(b, n if n > KEPT_POWERS else min(2 * n, KEPT_POWERS)) for b in self.bases)
        if len(found[0]) <= KEPT_POWERS:
            self.kept = found
        return found[0][:n], found[1][:n]


_POWERS = [_Powers(ROLL_BASES[0], False), _Powers(ROLL_BASES[1], True)]


def give_back() -> None:
    """Returns unused memory of this process to the system; idle workers keep none for others to miss."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over Arrow batches, after which its worker gives unused memory back."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; seeds give independent functions."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets, without a copy where there are no nulls and one chunk; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else column.cast(pa.large_binary()).combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of some documents: byte spans, and first[d] .. first[d + 1] are those of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = _LOWER[self.data] if lower else self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", data, strides=(1,))
        size = self.end - self.start
        out = mix((eight[self.start] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), 11)
        at, rest = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(at):
            value = eight[self.start[at] + rest] & _FIRST[np.minimum(size[at] - rest, 8)]
            out[at] = mix(out[at] * np.uint64(0xD6E8FEB86659FD93) + value, 13)
            rest += 8
            at = at[size[at] > rest]
        for k in np.flatnonzero(size > LONG_WORD):
            out[k] = int.from_bytes(hashlib.blake2b(data[self.start[k] : self.end[k]], digest_size=8, key=_WORD_KEY).digest(), "little")
        return out


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    space = _SPACE[data]
    into, out = ~space, ~space
    into[1:] &= space[:-1]
    out[:-1] &= space[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    into[first], out[last] = ~space[first], ~space[last]
    start, end = np.flatnonzero(into), np.flatnonzero(out) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def column_words(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(i, j, words of rows i to j) over a text column, a bounded part at a time."""
    data, offsets = buffers(column)
    for i, j in slices(offsets, most):
        yield i, j, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def rolling(hashes: np.ndarray, first: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp: the hash of every window of that many words inside one document, and the windows' first words; which: 0 modulo 2**64, 1 in the prime field."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _POWERS[which].get(n + 1)
    terms = _mod_prime((mix(hashes, which) >> np.uint64(33)) * up[:-1]) if which else hashes * up[:-1]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    at = np.arange(n - width + 1)
    at = at[at + width <= np.repeat(first[1:], np.diff(first))[: n - width + 1]]
    own = sums[at + width] - sums[at]
    return mix(_mod_prime(_mod_prime(own) * down[at]) if which else own * down[at], width), at
