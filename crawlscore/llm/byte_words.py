"""Words of a slice of texts as runs of one byte buffer, classified by a table without a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from crawlscore.llm import ragged, shingles

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Digits, letters (A-Z become a-z) and all bytes of characters beyond ASCII stay, other bytes become spaces.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The low bytes of a number, by how many of them belong to a word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Runs:
    """`data` holds the words, each followed by one space; word k is data[starts[k]:ends[k]].

    Text t has the words bounds[t] to bounds[t + 1]. `data` ends with eight spare bytes.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """64-bit keys of the words at the given places, equal for equal words."""
        begin, end = self.starts[at], self.ends[at]
        size = end - begin
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        head = eight[begin] & _LOW[np.minimum(size, 8)]
        tail = np.where(size > 8, eight[np.maximum(end - 8, 0)], np.uint64(0))
        found = shingles.mixed(shingles.mixed(head + size.astype(np.uint64) * _ODD) + tail)
        for k in np.flatnonzero(size > 16).tolist():
            found[k] = xxhash.xxh3_64_intdigest(self.data[begin[k]:end[k]])
        return found

    def packed(self) -> pa.Array:
        """The words as an Arrow array."""
        size = self.ends - self.starts
        offsets = np.concatenate(([0], np.cumsum(size)))
        inside = np.ones(len(self.data) - 8, bool)
        inside[self.ends] = False
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size),
            [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[:-8][inside])])


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line feed, and where each text begins (and the end)."""
    ended = pc.binary_join_element_wise(
        ragged.filled(texts), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if not len(ended):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:ended.offset + len(ended) + 1]
    raw = np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def compact(mapped: np.ndarray, offsets: np.ndarray) -> Runs:
    """Runs of bytes other than a space; the text at offsets[t] must end with one."""
    inside = mapped != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    begins, sizes = edges[0::2], edges[1::2] - edges[0::2]
    inside[edges[1::2]] = True  # the first space after a word stays
    places = np.cumsum(sizes + 1) - sizes - 1
    data = np.concatenate((mapped[inside], np.zeros(8, np.uint8)))
    return Runs(data, places, places + sizes, np.searchsorted(begins, offsets))


def words(texts: pa.Array) -> Runs:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    raw, offsets = joined(texts)
    return compact(np.frombuffer(raw.tobytes().translate(WORD_BYTES), np.uint8), offsets)


def letters(texts: pa.Array) -> Runs:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, as Latin-1 bytes, A-Z in lower case."""
    raw, offsets = joined(texts)
    mapped = np.frombuffer(raw.tobytes().translate(_ASCII_LETTERS), np.uint8).copy()
    leads = np.flatnonzero(raw == 0xC3)  # in UTF-8 these characters are C3 and a byte of six bits
    mapped[leads + 1] = (raw[leads + 1] & 0x3F) | 0xC0
    kept = np.ones(len(raw), bool)
    kept[leads] = False
    return compact(mapped[kept], offsets - np.searchsorted(leads, offsets))


_ASCII_LETTERS = bytes(c if c in _LETTERS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray,
               room: int = 1 << 21) -> np.ndarray:
    """Whether a[a_at:a_at + size] equals b[b_at:b_at + size], for each row, about `room` bytes at a time."""
    out = np.zeros(len(size), bool)
    before = np.cumsum(size) - size
    first = 0
    while first < len(size):
        last = max(int(np.searchsorted(before, before[first] + room)), first + 1)
        some, start = size[first:last], before[first:last] - before[first]
        step = np.arange(int(some.sum())) - np.repeat(start, some)
        equal = a[np.repeat(a_at[first:last], some) + step] == b[np.repeat(b_at[first:last], some) + step]
        out[first:last] = np.logical_and.reduceat(equal, start) if len(equal) else True
        first = last
    return out
