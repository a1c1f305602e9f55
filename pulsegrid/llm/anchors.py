"""Anchors: places of a text that depend on the bytes around them only, found with numpy inside tasks."""

from __future__ import annotations

import numpy as np

from .shingles import _BYTE, mix64

_ODD = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PIECE_BYTES = 2 << 20


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` bytes, by doubling: a long run is two shorter ones, one of them multiplied."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    runs, length, out, done, level = _BYTE[data], 1, None, 0, 0
    while True:
        if size & length:
            if out is None:
                out = runs.copy()
            else:  # append this run after what is there already
                n = len(data) - done - length + 1
                out = out[:n] * _ODD[level + 32] + runs[done : done + n]
                out ^= out >> np.uint64(29)
            done += length
        if done == size:
            return mix64(out)
        n = len(runs) - length
        runs = runs[:n] * _ODD[level] + runs[length : length + n]
        runs ^= runs >> np.uint64(31)
        length, level = 2 * length, level + 1


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every ``size`` neighbours."""
    length = 1
    while 2 * length <= size:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    rest = size - length
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes: place, gram hash, and the first and last string start they serve.

    The anchor of a string is its ``gram``-byte run of least hash, the leftmost of equal ones. It depends on the bytes
    of the string alone, so equal strings have their anchors at the same offset. The starts that an anchor serves are
    neighbours. Long data is worked through in overlapping pieces.
    """
    found = [_anchors(data[at : at + PIECE_BYTES + length - 1], length, gram, at) for at in range(0, max(1, len(data) - length + 1), PIECE_BYTES)]
    if len(found) == 1:
        return found[0]
    # An anchor at the seam of two pieces serves starts of both, as two entries; it may be listed twice.
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(data, length, gram, at):
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, np.empty(0, np.uint64), empty, empty
    hashes = gram_hashes(data, gram)
    span = length - gram + 1
    least = window_least(hashes, span)
    # Leftmost place of the least value: the hash's first occurrence at or after the string's start.
    is_least = np.zeros(len(hashes), dtype=bool)
    starts = np.arange(len(least))
    change = np.flatnonzero(np.diff(least, prepend=least[:1] + np.uint64(1)))
    # Within a run of starts with one least value there may be several equal grams; walk those runs only.
    places, first, last = [], [], []
    ends = np.append(change[1:], len(least))
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    lo = np.searchsorted(ranked, least[change], "left")
    hi = np.searchsorted(ranked, least[change], "right")
    single = hi - lo == 1
    place1 = order[lo[single]]
    del is_least, starts
    places.append(place1), first.append(change[single]), last.append(ends[single] - 1)
    for r in np.flatnonzero(~single):
        spots = order[lo[r] : hi[r]]
        s, e = change[r], ends[r] - 1
        spots = spots[np.searchsorted(spots, s) : np.searchsorted(spots, e + span)]
        # start t is served by the first spot >= t
        begin = np.concatenate([[s], spots[:-1] + 1])
        spots, begin = spots[begin <= e], begin[begin <= e]
        places.append(spots), first.append(begin), last.append(np.minimum(spots, e))
    p, f, l = (np.concatenate(x).astype(np.int64) for x in (places, first, last))
    by = np.argsort(f, kind="stable")
    return p[by] + at, hashes[p[by]], f[by] + at, l[by] + at
