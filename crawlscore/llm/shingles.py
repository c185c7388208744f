"""Sets of word shingles as sorted 64-bit hashes, computed in slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from crawlscore.llm import ragged

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (multiply and shift, three times)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()),
                       np.uint64, len(distinct))


def sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, lower-cased in A-Z.

    A text with fewer words than `width` has one shingle, all its words; without words, none.
    """
    flat, bounds = ragged.words(pc.ascii_lower(ragged.filled(texts)))
    codes, distinct = ragged.coded(flat)
    hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    whole = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        whole = mixed(whole * _ODD + hashes[k:k + len(whole)])
    for first, last in zip(bounds[:-1], bounds[1:]):
        if last - first >= width:
            yield np.unique(whole[first:last - width + 1])
        elif last > first:
            one = np.zeros(1, np.uint64)
            for h in hashes[first:last]:
                one = mixed(one * _ODD + h)
            yield mixed(one + np.uint64(last - first))
        else:
            yield np.zeros(0, np.uint64)
