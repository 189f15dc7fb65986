"""Vectorised word scanning over Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those separators are ASCII, so
scanning UTF-8 bytes finds the same words as the regular expression ``[^\\x20\\x09-\\x0D]+``
over characters. A word is known by a 64-bit hash of its bytes: a polynomial over a random byte
table modulo 2**64, taken as a difference of prefix sums so that a whole block of text costs a few
numpy passes, then mixed. Two of a billion distinct words share a hash with a probability of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are scanned at once.
BLOCK = 1 << 18
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def combine(*hashes: np.ndarray) -> np.ndarray:
    """The hash of a sequence of hashes; it depends on their order and number."""
    out = mix(hashes[0] + U64(0x5851F42D4C957F2D * len(hashes) * 0x2545F4914F6CDD1D % (1 << 64)))
    for h in hashes[1:]:
        out *= U64(0x2545F4914F6CDD1D)
        out += h
        out = mix(out)
    return out


def order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of unsigned 64-bit numbers in ascending order, equal ones as they stand, and the sorted
    numbers. Sorts their high bits with the places below them, which takes a fraction of an argsort."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), x
    lead, low = U64(64 - int(x.max()).bit_length()), U64((n - 1).bit_length())
    at = x << lead if lead < 64 else np.zeros(n, np.uint64)
    at >>= low
    at <<= low
    at |= np.arange(n, dtype=np.uint64)
    at.sort()
    at &= (U64(1) << low) - U64(1)
    places = at.view(np.int64)
    out = x[places]
    if (out[1:] < out[:-1]).any():  # some differ in the bits that gave way to places
        again = np.argsort(out, kind="stable")
        places, out = places[again], out[again]
    return places, out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of unsigned 64-bit numbers, sorted, and for each number its place among them."""
    places, out = order(x)
    new = np.ones(len(x), bool)
    new[1:] = out[1:] != out[:-1]
    of = np.empty(len(x), np.int64)
    of[places] = np.cumsum(new) - 1
    return out[new], of


class Places:
    """Finds the places of 64-bit numbers among distinct ones in a table by their hash, which takes a
    fraction of a binary search when they are many."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.view(np.uint64)
        bits = max(4, (2 * len(keys)).bit_length())
        self._shift, self._mask = U64(64 - bits), (1 << bits) - 1
        self._table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slots(self.keys)
        while len(left):
            some = self._table[slot] < 0
            self._table[slot[some]] = left[some]
            lost = self._table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self._mask

    def _slots(self, x: np.ndarray) -> np.ndarray:
        h = x >> U64(32)
        h ^= x
        h *= U64(_BASE)
        h >>= self._shift
        return h.view(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """-1 where absent."""
        x = x.view(np.uint64)
        if not len(self.keys):
            return np.full(len(x), -1)
        slot = self._slots(x)
        out = self._table[slot].astype(np.int64)
        wrong = np.flatnonzero((self.keys[out] != x) & (out >= 0))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self._mask
            got = self._table[slot]
            out[wrong] = got
            again = (self.keys[got] != x[wrong]) & (got >= 0)
            wrong, slot = wrong[again], slot[again]
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n+1 offsets of its rows; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Tokens:
    """Words of a run of texts, in order: byte bounds, hash, and for each text its slice of them."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # text i has words bounds[i] to bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Block bounds that fall between words; a block is longer than BLOCK only within one word."""
    a, n = 0, len(data)
    while a < n:
        size = BLOCK
        while True:
            b = min(a + size, n)
            if b == n:
                break
            k = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            gaps = np.flatnonzero(SEPARATOR[data[max(a, k, b - 65536) : b]])
            c = max(k, max(a, k, b - 65536) + int(gaps[-1]) + 1 if len(gaps) else 0)
            if c > a:
                b = c
                break
            size *= 2
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Tokens:
    """The words of all texts. lower: hash A-Z as a-z."""
    table = _LOWER if lower else _TABLE
    parts: list[tuple[np.ndarray, ...]] = []
    for a, b in _cuts(data, offsets):
        x = data[a:b]
        inside = (x != 0x20) & (x - np.uint8(9) > 4)  # as SEPARATOR has it
        first = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[first] = inside[first]
        closes[:-1] &= ~inside[1:]
        last = first[first > 0] - 1
        closes[last] = inside[last]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.take(table, x.astype(np.intp), mode="clip", out=total[1:])
        total[1:] *= up[: b - a]
        np.cumsum(total, out=total)
        parts.append((s + a, e + a, mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))))
    s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Tokens(s, e, h, np.searchsorted(s, offsets))


def chunks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row bounds, bytes and offsets of runs of rows of about size bytes; a longer text is a run of its own."""
    data, offsets = text_bytes(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def windows(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the index of each run's first word."""
    n = len(t.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(t.bounds[1:], t.counts)[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= ends)
    return combine(*(t.hash[at + i] for i in range(k))), at


def signed(h: np.ndarray) -> np.ndarray:
    """As the long that Spark holds."""
    return np.ascontiguousarray(h).view(np.int64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans in ascending order that don't overlap."""
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[data[a:b]] * up[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        i = j
    return np.concatenate(out)


def ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first[i] : first[i] + size[i]] of all i, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)]
