"""Encoded words kept in sorted arrays: about 30 bytes an entry, looked up many at a time.

A word is known by 128 bits: two hashes of its first and last eight bytes and its length, which together say all of a word
of 16 bytes or less; longer ones are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from crawlscore.llm import shingles

_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_HALF = (1 << 64) - 1


def keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each large string."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    raw = words.buffers()[2]
    data = np.concatenate((np.frombuffer(raw, np.uint8)[:offsets[-1]] if raw else np.zeros(0, np.uint8), np.zeros(8, np.uint8)))
    begin, end = offsets[:-1], offsets[1:]
    size = end - begin
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    head = eight[begin] & _LOW[np.minimum(size, 8)]
    tail = np.where(size > 8, eight[np.maximum(end - 8, 0)], np.uint64(0))
    both = [shingles.mixed(shingles.mixed(head + size.astype(np.uint64) * odd) ^ tail * odd) for odd in _ODD]
    for k in np.flatnonzero(size > 16).tolist():
        whole = xxhash.xxh3_128_intdigest(data[begin[k]:end[k]])
        both[0][k], both[1][k] = whole >> 64, whole & _HALF
    return both[0], both[1]


class Generation:
    """Sorted keys, and a run of values for each."""

    def __init__(self):
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, "<u4")

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
        """New keys with their runs one after another in `values`."""
        start = len(self.flat) + np.cumsum(size) - size
        merged = np.argsort(np.concatenate((self.key, key)), kind="stable")
        self.key, self.check, self.start, self.size = (
            np.concatenate(pair)[merged] for pair in (
                (self.key, key), (self.check, check), (self.start, start), (self.size, size.astype(np.int32))))
        self.flat = np.concatenate((self.flat, values.astype("<u4")))


class Store:
    """Two generations of at most about `limit` words: when the young one is full it becomes the old one, and words
    met again move over."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young, self.old = Generation(), Generation()

    def runs(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Starts and values of the runs of distinct words, one after another; `encode` gives those of unseen ones
        as (sizes, values) from their places."""
        key, check = keys(words)
        size = np.zeros(len(words), np.int64)
        young = self.young.find(key, check)
        place = np.flatnonzero(young < 0)
        old = self.old.find(key[place], check[place])
        parts = []  # (places of words, their sizes, their values)

        def taken(generation: Generation, words_at: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes, begin = generation.size[at].astype(np.int64), generation.start[at]
            index = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
            parts.append((words_at, sizes, generation.flat[index]))
            return sizes, parts[-1][2]

        here = np.flatnonzero(young >= 0)
        taken(self.young, here, young[here])
        moved = place[old >= 0]
        moved_runs = taken(self.old, moved, old[old >= 0])
        unseen = place[old < 0]
        fresh = encode(unseen) if len(unseen) else (np.zeros(0, np.int64), np.zeros(0, "<u4"))
        parts.append((unseen, *fresh))
        if len(self.young.key) + len(place) > self.limit:
            self.old, self.young = self.young, Generation()
        for at, (sizes, values) in ((moved, moved_runs), (unseen, fresh)):
            if len(at):
                self.young.add(key[at], check[at], sizes, values)
        for at, sizes, _ in parts:
            size[at] = sizes
        starts = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(starts[-1], "<u4")
        for at, sizes, values in parts:
            index = np.arange(len(values)) + np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes)
            out[index] = values
        return starts, out
