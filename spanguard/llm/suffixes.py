"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induced sorting: every suffix is of type S (smaller than the one behind it) or L.
The leftmost S of a run is a leftmost-smaller position. Substrings between these
are sorted and named; if names repeat, the string of names is sorted recursively.
From the order of the leftmost-smaller suffixes follows that of all L suffixes, and
from theirs that of all S suffixes.

The textbook form induces by one scan from bucket to bucket. Here a pass works on
whole arrays: each suffix of the pass is compared by (its bucket, the place of the
suffix behind it), which is final where that one belongs to the pass before. Runs
of one type are covered in steps that double, and a suffix leaves as soon as it is
alone or its run has ended, so nearly all work is in the first step.
"""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last symbol is the unique smallest."""
    n = len(t)
    differs = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    smaller = np.append(t[differs[:-1]] < t[differs[:-1] + 1], True)
    return np.repeat(smaller, np.diff(differs, prepend=-1))


def order_runs(place: np.ndarray, at: np.ndarray) -> None:
    """Order the suffixes at `at` by bucket and by what their runs lead to.

    `place` holds the first slot of each suffix's bucket, and the final slot of the
    suffixes that end the runs. Equal suffixes share their group's first slot.
    """
    n = np.int64(len(place) + 1)
    closed = np.ones(len(place), bool)
    closed[at] = False
    jump = np.arange(1, len(place) + 1, dtype=place.dtype)
    to = at + 1
    while at.size:
        key = place[at].astype(np.int64) * n + place[to]
        order = np.argsort(key)
        key, at, to = key[order], at[order], to[order]
        first = np.empty(len(at), bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        head = np.flatnonzero(first)
        sizes = np.diff(head, append=len(at))
        old = place[at[head]]
        # A group's place is its bucket's, and the number of members before it there.
        start = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        fresh = old + head - np.repeat(head[start], np.diff(start, append=len(head)))
        ends, further = closed[to], jump[to]
        place[at] = np.repeat(fresh, sizes)
        ends |= np.repeat(sizes == 1, sizes)
        closed[at] = ends
        still = np.flatnonzero(~ends)
        at, to = at[still], further[still]
        jump[at] = to


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """The slot of every suffix, given the ranks of the leftmost-smaller ones.

    Without ranks these count as equal within a bucket, which sorts the
    leftmost-smaller substrings: equal ones then share a slot.
    """
    k = int(t.max()) + 1
    counts = np.bincount(t, minlength=k)
    large = np.bincount(t[~small], minlength=k)
    start = np.cumsum(counts) - counts
    place = np.where(small, (start + large)[t], start[t]).astype(np.int32 if len(t) < 2**31 else np.int64)
    if rank is not None:
        ordered = np.empty_like(lms)
        ordered[rank] = lms
        first = t[ordered]
        offset = np.arange(len(ordered))
        head = np.maximum.accumulate(np.where(np.append(True, first[1:] != first[:-1]), offset, 0))
        place[ordered] += (offset - head).astype(place.dtype)
    order_runs(place, np.flatnonzero(~small))
    behind = np.flatnonzero(small)[:-1]  # all but the last symbol, which is smallest
    place[behind] = (start + large)[t[behind]]
    order_runs(place, behind)
    return place


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in lexical order; symbols are small integers >= 0."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    t = np.append(symbols.astype(np.int32) + 1, np.int32(0))
    small = types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    substrings = induce(t, small, lms, None)[lms]
    used = np.zeros(len(t), np.int32)
    used[substrings] = 1
    used = np.cumsum(used, dtype=np.int32)
    names = used[substrings] - 1
    if used[-1] < len(lms):
        order = np.append(len(lms) - 1, suffix_array(names[:-1]))
        names = np.empty(len(lms), np.int32)
        names[order] = np.arange(len(lms))
    place = induce(t, small, lms, names)
    result = np.empty(len(t), np.int64)
    result[place] = np.arange(len(t))
    return result[1:]


def permuted_common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, by position, what it has in common with the one before it in order.

    Where the symbols before both suffixes are equal, the value is one less than
    that of the position before; only the others are compared, eight bytes a step.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    kind = np.dtype(np.uint8 if symbols.max() < 255 else np.uint16)
    step = 8 // kind.itemsize
    t = np.append(symbols.astype(kind) + kind.type(1), np.zeros(2 * step, kind))
    at = np.flatnonzero(before >= 0)
    b = before[at]
    own = at[(at == 0) | (b == 0) | (t[at - 1] != t[b - 1])]
    words = np.ndarray(shape=(n + step,), dtype="<u8", buffer=t, strides=(kind.itemsize,))
    length = np.zeros(n, np.int64)
    open_, left, right = own, own.copy(), before[own]
    while open_.size:
        differ = words[left] ^ words[right]
        over = differ != 0
        low = differ[over] & (~differ[over] + np.uint64(1))
        length[open_[over]] += (np.frexp(low.astype(np.float64))[1] - 1) // (8 * kind.itemsize)
        open_, left, right = open_[~over], left[~over] + step, right[~over] + step
        length[open_] += step
    start = np.zeros(n, np.int64)
    start[own] = own
    start[before < 0] = np.flatnonzero(before < 0)
    start = np.maximum.accumulate(start)
    return length[start] - (np.arange(n) - start)
