"""Words of many texts at once: one byte array, places of words and lines, and their 64-bit hashes, all by numpy.

Words are runs of bytes that are no ASCII white space, so they are the same on UTF-8 bytes as on characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at a time.
BLOCK_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_FULL = 0xFFFFFFFFFFFFFFFF
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Spans of up to so many bytes are hashed eight bytes at a time over all spans at once, longer ones one by one.
_SHORT = 32
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA24BAED4963EE407, 0x27D4EB2F165667C5)]
_AT_A_TIME = 1 << 14


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """data: the texts with a newline after each; off: where texts start; start, end, doc: of each word."""

    def __init__(self, raws: list[bytes], lower: bool = False):
        joined = b"\n".join([*raws, b""])
        padded = (joined.translate(_LOWER) if lower else joined) + bytes(8)
        self.data = np.frombuffer(padded, np.uint8)[: len(joined)]
        self._lanes = np.ndarray(len(joined) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
        self.sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        self.off = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        space = SPACE[self.data]
        edge = np.diff(space.astype(np.int8), prepend=1)
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.start, self.off)  # first word of each text
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raws)), self.counts)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of any spans of data; a span's hash depends on its bytes alone, and not linearly, so no pattern of bytes collides by rule."""
        size = end - start
        out = (size.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        left = np.flatnonzero((size > 0) & (size <= _SHORT))
        for k in range(0, _SHORT, 8):
            rest = size[left] - k
            lane = self._lanes[start[left] + k] & np.where(rest < 8, (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(_FULL))
            out[left] = mix((out[left] ^ lane) * np.uint64(_BASE))
            left = left[rest > 8]
            if not len(left):
                break
        raw = memoryview(self.data)
        for i in np.flatnonzero(size > _SHORT).tolist():
            out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
        return out

    def window_hashes(self) -> np.ndarray:
        """Of the 32 bytes from each place on, one for each place that has so many after it."""
        n = max(0, len(self.data) - 31)
        out = np.empty(n, np.uint64)
        for a in range(0, n, _AT_A_TIME):  # what is worked on at a time stays in the cache
            many = min(_AT_A_TIME, n - a)
            lane = self._lanes[a : a + many + 24] * _STEPS[0]
            lane ^= lane >> np.uint64(29)
            lane *= np.uint64(_BASE)
            lane ^= lane >> np.uint64(32)
            mixed = lane[:many] * _STEPS[1]
            for k, step in enumerate(_STEPS[2:], 1):
                mixed += lane[8 * k : 8 * k + many] * step
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(_BASE)
            out[a : a + many] = mixed ^ (mixed >> np.uint64(29))
        return out

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and text of each line that is split at a newline; an empty text is one empty line."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        return start, end, np.searchsorted(self.off, end, side="right") - 1


def blocks(texts: pa.Array):
    """(first row, texts as bytes) of consecutive rows with about BLOCK_BYTES together; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
    at = 0
    for rows in np.unique(cut, return_counts=True)[1].tolist():
        yield at, pc.fill_null(texts.slice(at, rows), "").cast(pa.binary()).to_pylist()
        at += rows


def rolling(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of n words that lies in one text."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(_BASE)
        out += words[k : len(words) - n + 1 + k]
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return mix(out[at]), at
