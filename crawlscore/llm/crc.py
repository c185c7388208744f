"""CRC-32 of concatenations, many at a time: the checksum of a text followed by another is computed from both checksums.

Appending n bytes moves a checksum by a linear map, which is looked up byte by byte in a table for n.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Appended lengths that have a table of their own; longer ones take several steps.
_LONGEST = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


def _tables() -> np.ndarray:
    """[n, k, b]: the byte b at place k of a checksum, after n more bytes."""
    step, now = _byte_table(), np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    out = [now]
    for _ in range(_LONGEST):
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(0xFF)]
        out.append(now)
    return np.stack(out)


_MOVED = _tables().reshape(-1)


def _moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = size * 1024
    return (_MOVED[at + (crc & np.uint32(0xFF))] ^ _MOVED[at + 256 + (crc >> np.uint32(8) & np.uint32(0xFF))]
            ^ _MOVED[at + 512 + (crc >> np.uint32(16) & np.uint32(0xFF))] ^ _MOVED[at + 768 + (crc >> np.uint32(24))])


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of texts a + b from those of a and of b, which has `size` bytes."""
    rest = size.copy()
    long = np.flatnonzero(rest > _LONGEST)
    if len(long):
        first = first.copy()
        powers = _MOVED.reshape(-1, 4, 256)[_LONGEST]  # the map of _LONGEST bytes, then of twice as many, and so on
        count, rest[long] = rest[long] // _LONGEST, rest[long] % _LONGEST
        while count.any():
            odd = long[count & 1 == 1]
            first[odd] = _mapped(powers, first[odd])
            powers, count = _mapped(powers, powers), count >> 1
    return _moved(first, rest) ^ second


def _mapped(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= table[k][crc >> np.uint32(8 * k) & np.uint32(0xFF)]
    return out


def of_each(distinct: pa.Array) -> np.ndarray:
    """Checksums of binary values."""
    return np.fromiter(map(zlib.crc32, distinct.to_pylist()), np.uint32, len(distinct))


def crc32_sql(text: str) -> str:
    """The same of a text in DuckDB SQL: bit by bit, each byte entering before its first of eight steps."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    steps = f"list_transform(range(0, 8 * len(b)), lambda i: CASE WHEN i % 8 = 0 THEN b[i // 8 + 1] ELSE 0 END)"
    folded = (f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), "
              "lambda c, x: xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1)))")
    return f"(SELECT xor({folded}, 4294967295::BIGINT) FROM (SELECT {octets} AS b))"
