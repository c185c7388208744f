"""Word-wise work on Arrow string arrays inside tasks: split, code distinct words once, gather.

Every function works on one bounded slice of a batch, so a task's memory depends on the longest
text and not on the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at a time.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about `size` bytes of `column`; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, room = 0, size
    for row, length in enumerate(lengths):
        if length > room and row > start:
            yield batch.slice(start, row - start)
            start, room = row, size
        room -= int(length)
    if batch.num_rows > start:
        yield batch.slice(start)


def filled(texts: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets and '' for null.

    They are copied to a buffer of their own: pc.ascii_lower reads a slice's buffer from its start.
    """
    own = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    return pc.fill_null(own, "")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) of the texts, and each text's first word."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), counts[offsets - offsets[0]]


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words by code."""
    both = flat.dictionary_encode()
    return both.indices.to_numpy(zero_copy_only=False), both.dictionary


def gather(codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value runs of the codes one after another, and where each code's run begins.

    Run c is values[starts[c]:starts[c + 1]].
    """
    lengths = (starts[1:] - starts[:-1])[codes]
    begins = np.concatenate(([0], np.cumsum(lengths)))
    index = np.arange(begins[-1]) + np.repeat(starts[:-1][codes] - begins[:-1], lengths)
    return values[index], begins


class Memo:
    """Encoded words kept between batches of a worker.

    `encode` turns a list of unseen words into byte strings. Two generations are kept: when the young
    one holds `limit` words, or `limit_bytes` bytes of words and codes, it becomes the old one, and words
    met again move over. Looked at before each list, so a generation is beyond its bounds by one list at most.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], dtype: str, limit: int, limit_bytes: int):
        self.encode, self.dtype, self.limit, self.limit_bytes = encode, np.dtype(dtype), limit, limit_bytes
        self.held = 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def runs(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and values of the runs of the distinct words."""
        if len(self.young) >= self.limit or self.held >= self.limit_bytes:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        unseen = []
        for word in distinct:
            if word not in young:
                known = old.get(word)
                if known is None:
                    unseen.append(word)
                else:
                    young[word] = known
                    self.held += len(word) + len(known)
        if unseen:
            fresh = self.encode(unseen)
            young.update(zip(unseen, fresh))
            self.held += sum(map(len, unseen)) + sum(map(len, fresh))
        parts = [young[w] for w in distinct]
        starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=starts[1:])
        return starts // self.dtype.itemsize, np.frombuffer(b"".join(parts), self.dtype)
