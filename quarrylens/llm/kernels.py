"""Vectorised byte, word and hash kernels that the Arrow-side operators share.

All of them work on a block of documents: one uint8 buffer and the offsets of its documents. Blocks
are bounded in bytes (a single longer document is a block of its own), and arrays with a value for each
byte are made for ``SEGMENT_BYTES`` at a time, so memory grows neither with the Arrow batch nor by much more than
its own size with a very long document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
SEGMENT_BYTES = 1 << 19

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudorandom 64-bit values (splitmix64 of a counter); the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_RADIX) + _U(seed * 0xD1342543DE82EF95 % 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Powers:
    """Powers of an odd radix and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, radix: int = _RADIX):
        self.radix, self.inverse = radix, pow(radix, -1, 2**64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            step = np.full(n, self.radix, _U)
            step[0] = 1
            self.up = np.cumprod(step)
            step[1:] = self.inverse
            self.down = np.cumprod(step)
        return self.up, self.down


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """H with H[e] - H[s] = sum of values[i] * r**i over [s, e), modulo 2**64."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers.get(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Mixed hashes of the spans [start, end): equal spans have equal hashes wherever they lie."""
    down = powers.get(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


#: shared by all operators of a worker
POWERS = Powers()


def segments(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` bytes that no word crosses; one that holds a longer word is as long as that."""
    limit = limit or SEGMENT_BYTES
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + limit
        while hi < n and is_word[data[hi]] and is_word[data[hi - 1]]:
            ahead = is_word[data[hi : hi + limit]]
            cut = offsets[np.searchsorted(offsets, hi)]  # words end with their document
            gap = hi + (int(ahead.argmin()) if not ahead.all() else len(ahead))
            if cut <= gap or gap < hi + len(ahead):
                hi = min(int(cut), gap)
                break
            hi = gap
        yield lo, min(hi, n)
        lo = hi


class Words:
    """The words of a block: byte spans, hashes, and for each document the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray, powers: Powers = POWERS):
        starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, _U)]
        for lo, hi in segments(data, offsets, is_word):
            part = data[lo:hi]
            inside = is_word[part]
            broken = np.zeros(len(part) + 1, bool)
            broken[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1] | broken[1:-1]
            last[:-1] &= ~inside[1:] | broken[1:-1]
            begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            starts.append(begin + lo)
            ends.append(end + lo)
            hashes.append(spans_hash(prefix_sums(values[part], powers), begin, end, powers))
        self.starts, self.ends, self.hash = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        #: words of document d: bounds[d] to bounds[d + 1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def grams(self, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, word positions, bounds by document) of the n-grams that lie inside one document."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(self.bounds), np.int64)
        out = np.zeros(total - n + 1, _U)
        for i, c in enumerate(random_words(seed, n)):
            out += self.hash[i : total - n + 1 + i] * (c | _U(1))
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.flatnonzero(owner[: total - n + 1] == owner[n - 1 :])
        return mix(out[at]), at, np.searchsorted(at, self.bounds)


def byte_class(excluded: str | bytes) -> np.ndarray:
    """True for the bytes that aren't in ``excluded``."""
    out = np.ones(256, bool)
    out[list(excluded.encode("latin-1") if isinstance(excluded, str) else excluded)] = False
    return out


def lowered(seed: int) -> np.ndarray:
    """A random value for each byte, A-Z having those of a-z."""
    values = random_words(seed, 256)
    values[65:91] = values[97:123]
    return values


#: ``[^\x20\x09-\x0D]+``: bytes other than ASCII white space
SPACED = byte_class(" \t\n\r\x0b\x0c")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: letters, digits and all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
