"""Vectorised hashes of substrings, words and shingles, and circulant MinHash."""

from __future__ import annotations

import numpy as np

ODD = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64))
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any substrings of `data`, from sums over its prefixes."""

    up = powers(ODD, 1)
    down = powers(pow(ODD, -1, 2**64), 1)
    codes = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes.up) <= n:
            size = max(n + 1, 1 << 16)
            Hashes.up, Hashes.down = powers(ODD, size), powers(pow(ODD, -1, 2**64), size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= MIX
        return h ^ (h >> np.uint64(29))


#: Word separators: blank, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(ODD) + b
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct word shingles.

    Words are runs of bytes that are no separators, with A-Z in lower case. A text
    of fewer than `width` words has all its words as its one shingle; one without
    words has none.
    """
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    word = Hashes(data).of(starts, ends)
    sizes = np.array([len(t) + 1 for t in texts])
    stops = np.searchsorted(starts, np.cumsum(sizes))
    counts = np.diff(stops, prepend=0)
    stop = np.repeat(stops, counts)
    place = np.arange(len(word))
    shingle = word.copy()
    for j in range(1, width):
        inside = place + j < stop
        at = np.flatnonzero(inside)
        shingle[at] = mixed(shingle[at], word[at + j])
    first = np.repeat(stops - counts, counts)
    keep = (place + width <= stop) | ((place == first) & (stop - first < width))
    kept = np.append(0, np.cumsum(keep))
    shingle = shingle[keep]
    bounds = kept[np.append(0, stops)].tolist()
    return [np.unique(shingle[a:b]) for a, b in zip(bounds, bounds[1:])]


def first_permutation(x: np.ndarray) -> np.ndarray:
    """A permutation of the numbers below 2**32 that scatters the elements."""
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def second_permutation(x: np.ndarray) -> np.ndarray:
    """Another one, whose circular shifts give the coordinates."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def circulant_signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Circulant MinHash signatures, a row for each (non-empty) set.

    Coordinate k is the smallest value over the set of the second permutation,
    shifted circularly by k places, of the first permutation's values.
    """
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    values = np.concatenate(sets)
    place = first_permutation((values ^ (values >> np.uint64(32))).astype(np.uint32))
    out = np.empty((len(sets), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(second_permutation(place + np.uint32(k)), starts)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of `rows` coordinates, different for each band."""
    n, width = signatures.shape
    bands = signatures.reshape(n, width // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(width // rows, dtype=np.uint64) + np.uint64(1), bands.shape[:2])
    for i in range(rows):
        key = mixed(key, bands[:, :, i])
    return key.view(np.int64)
