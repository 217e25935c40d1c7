"""Words of many texts at once, in Arrow and numpy, and numbers in few bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Each byte that is no lower-case letter or digit as a space.
_PLAIN = bytes(b if chr(b).isascii() and chr(b).isalnum() and not chr(b).isupper() else 32 for b in range(256))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words of each text, codes of all words in order, the word of each code) for texts in lower case; a null has no words.

    The words are those of ``text.normal_words``: runs of a-z and 0-9.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, ends, body = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    plain = bytes(memoryview(body)[ends[0] : ends[-1]]).translate(_PLAIN) if body else b""
    parts = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)))
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if blank.any():  # at the ends of texts
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[blank], minlength=len(sizes))
        flat = flat.filter(pa.array(~blank))
    words = flat.dictionary_encode()
    return sizes, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``, runs following each other in the given sizes; 0 for an empty run."""
    out, full = np.zeros(len(sizes)), sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts(sizes)[full])
    return out


def cut(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``most`` bytes of ``column``, whatever the batches are; a longer text is a table of its own."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(max(int(np.searchsorted(ends, before + most - size, "right")), at + (not held)), batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes: planes of equal significance one after the other, as few as the greatest needs, compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""
    return struct.pack("<qq", len(values), width) + body


def unpacked(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<qq", data)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[16:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def joined(*parts: bytes) -> bytes:
    """Several packed arrays as one value."""
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def parted(data: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<q", data)[0]
    ends = np.cumsum(struct.unpack_from(f"<{n}q", data, 8)) + 8 * (n + 1)
    return [unpacked(data[a:b]) for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def mixed(values: np.ndarray, odd: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(odd)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


#: What a byte of zero makes of a CRC-32 of one byte: the usual table of that polynomial.
_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTE = np.where(_BYTE & 1, np.uint32(0xEDB88320) ^ (_BYTE >> 1), _BYTE >> 1).astype(np.uint32)


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


@cache
def _doubled(j: int) -> np.ndarray:
    """For each byte of a CRC-32, what ``2 ** j`` further bytes of zero make of it."""
    if not j:
        c = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
        return _BYTE[c & 255] ^ (c >> 8)
    return _through(_doubled(j - 1), _doubled(j - 1))


def _further(n: int) -> np.ndarray:
    """The same for ``n`` bytes."""
    out = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    for j in range(n.bit_length()):
        if n >> j & 1:
            out = _through(_doubled(j), out)
    return out


def gram_crcs(sizes: np.ndarray, codes: np.ndarray, words: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order up to ``n``: (grams of each text, CRC-32 of each gram, its words joined by spaces)."""
    if not words:
        yield from ((np.zeros_like(sizes), np.zeros(0, np.uint32)) for _ in range(n))
        return
    alone = np.array([zlib.crc32(w.encode()) for w in words], np.uint32)
    after = np.array([zlib.crc32(f" {w}".encode()) for w in words], np.uint32)
    lengths, kind = np.unique([len(w.encode()) + 1 for w in words], return_inverse=True)
    tables = np.stack([_further(int(x)) for x in lengths]).ravel()  # by length, byte of the CRC and its value
    kind = (kind * 1024).astype(np.int64)
    left = np.repeat(sizes, sizes) - (np.arange(len(codes)) - np.repeat(starts(sizes), sizes))  # words from a place to its text's end
    crc, at = alone[codes], np.arange(len(codes))
    yield sizes, crc
    for k in range(2, n + 1):
        fits = left[at] >= k
        crc, at = crc[fits], at[fits]
        last = codes[at + k - 1]
        base = kind[last]
        crc = tables[base + (crc & 255)] ^ tables[base + 256 + ((crc >> 8) & 255)] ^ tables[base + 512 + ((crc >> 16) & 255)] ^ tables[base + 768 + (crc >> 24)] ^ after[last]
        yield np.maximum(sizes - k + 1, 0), crc
