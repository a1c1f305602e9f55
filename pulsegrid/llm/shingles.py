"""Word and shingle hashes of texts with numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
WORDS = 5
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 64), _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word ``[^ \\t-\\r]+`` of UTF-8 bytes, A-Z lower-cased.

    Works through pieces of about 2 MB that end at white space, so its memory is a small multiple of a piece, or of a
    longer word.
    """
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data):  # to the next white space
            ahead = np.flatnonzero(_SPACE[data[end : end + CHUNK_BYTES]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(len(data), end + CHUNK_BYTES)
        part = data[at:end]
        inside = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        if len(first):
            values = _BYTE[_LOWER[part]]
            starts = np.concatenate([[0], first]) if first[0] else first
            places = np.arange(len(part)) - np.repeat(starts, np.diff(starts, append=len(part)))
            places[~inside] = 0
            values *= _powers(int((last - first).max()) + 1)[places]
            values[~inside] = 0
            hashes.append(mix64(np.add.reduceat(values, first)))
            begins.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def shingle_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all ``n``-word shingles; fewer words are one shingle, none are none."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        total += words[j : j + len(total)] * _STEP[j]
    return np.unique(mix64(total))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary column and the offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_sets(column: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The shingle set of every text of a column, in order. Short texts are hashed many at a time."""
    data, offsets = text_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        part, own = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        if end == at + 1:
            yield shingle_set(word_hashes(part)[0], n)
            at = end
            continue
        # A line feed between texts keeps their words apart.
        spaced = np.full(len(part) + end - at, 10, dtype=np.uint8)
        spaced[np.arange(len(part)) + np.repeat(np.arange(end - at), np.diff(own))] = part
        hashes, begins = word_hashes(spaced)
        cuts = np.searchsorted(begins, own + np.arange(end - at + 1))
        for i in range(end - at):
            yield shingle_set(hashes[cuts[i] : cuts[i + 1]], n)
        at = end
