"""Vectorised text kernels on Arrow buffers: UTF-8 bytes, words and prefix hashes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes worked on at once. A longer document is worked on alone.
CHUNK = 1 << 20
#: An odd multiplier of the prefix hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_solid = np.ones(256, bool)
_solid[[0x20, 9, 10, 11, 12, 13]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k += m
    return out


class Prefix:
    """Hashes of any range of a sequence of 64-bit values, equal for equal ranges wherever they stand."""

    _pow = _powers(BASE, 1)
    _inv = _powers(BASE_INV, 1)

    def __init__(self, values: np.ndarray) -> None:
        self.sums = self.sized(len(values) + 1).sums
        np.cumsum(values * Prefix._pow[: len(values)], out=self.sums[1:])

    @classmethod
    def sized(cls, n: int) -> Prefix:
        """One whose ``n`` sums are still 0."""
        if len(Prefix._pow) < n:
            size = max(n, CHUNK + 2)
            Prefix._pow, Prefix._inv = _powers(BASE, size), _powers(BASE_INV, size)
        out = cls.__new__(cls)
        out.sums = np.zeros(n, U)
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.sums.take(end)
        x -= self.sums.take(start)
        x *= Prefix._inv.take(start)
        x += (end - start).astype(U) * U(0xA24BAED4963EE407)
        return mix(x)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their UTF-8 bytes, their offsets in those); null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and the index of the first word of each document."""
    solid = _solid.take(data)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _lower.take(data)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """``Prefix(BYTE_VALUE[data]).of(starts, ends)``, in blocks that stay in a core's cache."""
    prefix = Prefix.sized(len(data) + 1)
    for i in range(0, len(data), block):
        x = BYTE_VALUE.take(data[i : i + block])
        x *= Prefix._pow[i : i + len(x)]
        sums = prefix.sums[i : i + len(x) + 1]
        np.cumsum(x, out=sums[1:])
        sums[1:] += sums[0]
    out = np.empty(len(starts), U)
    for i in range(0, len(starts), block >> 2):
        out[i : i + (block >> 2)] = prefix.of(starts[i : i + (block >> 2)], ends[i : i + (block >> 2)])
    return out
