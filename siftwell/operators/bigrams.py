"""Counts of words and word pairs of a corpus, given back to every stretch of texts that holds them.

A word or pair is asked for once by each stretch of about ``STRETCH`` bytes, in packed buckets, not once by each text;
the texts themselves go along as packed codes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import coded, cut, joined, mixed, packed, parted, starts, sums, unpacked
from ..session import written

#: Bytes of text whose words and pairs are counted together, and the buckets that these are dealt to.
STRETCH, BUCKETS = 8 << 20, 1 << 10
#: What stands before the first word of a text; no word is spelt so.
START = "<s>"

INDEX = "stretch string, uids array<string>, sizes binary, codes binary, words binary"
ASKED = "bucket int, stretch string, asks boolean, words binary, pairs binary"
ANSWER = "stretch string, bucket int, words binary, pairs binary, n long, k long"


def index(df: DataFrame) -> DataFrame:
    """The texts of (uid, text) in stretches of packed codes, written; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cut(batches, "text", STRETCH):
            sizes, codes, words = coded(rows["text"].combine_chunks())
            uids = rows["uid"].filter(pa.array(sizes > 0)).to_pylist()
            if uids:
                spelt = pa.compress(" ".join(words).encode(), codec="zstd", asbytes=True)
                size = sum(map(len, words)) + len(words) - 1  # words are plain letters and digits
                cells = ([uuid.uuid4().hex], [uids], [packed(sizes[sizes > 0])], [packed(codes)], [size.to_bytes(8, "little") + spelt])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["stretch", "uids", "sizes", "codes", "words"])

    return written(df.select("uid", F.lower("text").alias("text")).mapInArrow(run, INDEX), "stretches")


class Stretch:
    """The pairs of a stretch: ``left`` and ``right`` word of each distinct one, ``times``, and ``which`` stands at each place."""

    def __init__(self, sizes: bytes, codes: bytes, words: bytes) -> None:
        self.words = [*pa.decompress(words[8:], int.from_bytes(words[:8], "little"), codec="zstd", asbytes=True).decode().split(" "), START]
        self.sizes, v = unpacked(sizes).astype(np.int64), unpacked(codes).astype(np.int64)
        u = np.empty_like(v)
        u[1:], u[starts(self.sizes)] = v[:-1], len(self.words) - 1
        u[starts(self.sizes)] = len(self.words) - 1
        pairs, self.which, self.times = np.unique(u * len(self.words) + v, return_inverse=True, return_counts=True)
        self.left, self.right = pairs // len(self.words), pairs % len(self.words)
        self.as_left, self.as_right = (np.bincount(x, self.times, len(self.words)).astype(np.int64) for x in (self.left, self.right))

    def keys(self) -> tuple[tuple, tuple]:
        """Two 64-bit numbers of each word, and of each pair; the first deals them to buckets."""
        digest = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in self.words), "<u8").reshape(-1, 2)
        a, b = digest[:, 0].copy(), digest[:, 1].copy()
        pair = lambda x, odd: mixed(mixed(x[self.left], odd) + x[self.right], 0x9E3779B97F4A7C15)
        return (a, b), (pair(a, 0xD6E8FEB86659FD93), pair(b, 0xA0761D6478BD642F) >> np.uint64(32))


def _dealt(keys: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket and within, and where each bucket begins."""
    order = np.argsort(keys[0], kind="stable")
    edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS.bit_length() + 1)
    return order, np.append(np.searchsorted(keys[0][order], edges), len(order))


def _body(keys: tuple, order: np.ndarray, *counts: np.ndarray) -> bytes:
    first = keys[0][order]
    return joined(packed(np.diff(first, prepend=np.uint64(0))), packed(keys[1][order]), *(packed(c[order]) for c in counts))


def _asked(rows: DataFrame, counts: bool, asks: bool) -> DataFrame:
    """A row for each stretch and bucket: keys of its words and pairs and, where it counts, how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                name, *cells = (batch[c][row].as_py() for c in ("stretch", "sizes", "codes", "words"))
                s = Stretch(*cells)
                words, pairs = s.keys()
                one = int(counts)
                (wo, wb), (po, pb) = _dealt(words), _dealt(pairs)
                out = [[], []]
                for b in range(BUCKETS):
                    out[0].append(_body(words, wo[wb[b] : wb[b + 1]], s.as_left * one, s.as_right * one))
                    out[1].append(_body(pairs, po[pb[b] : pb[b + 1]], s.times * one))
                cells = (range(BUCKETS), [name] * BUCKETS, [asks] * BUCKETS, *out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["bucket", "stretch", "asks", "words", "pairs"])

    return rows.mapInArrow(run, ASKED)


def _totals(bodies: list) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(place of each asked key among the distinct ones, their total counts, keys asked in each body)."""
    every = [parted(b) for b in bodies]
    first, second = np.concatenate([np.cumsum(e[0], dtype=np.uint64) for e in every]), np.concatenate([e[1] for e in every])
    order = np.argsort(first, kind="stable")
    f, s = first[order], second[order]
    new = np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]))[: len(f)]
    if (new[1:] & (f[1:] == f[:-1])).any():  # keys that only the second number tells apart
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        new = np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]))
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    totals = [np.add.reduceat(np.concatenate([e[i] for e in every])[order], at) if len(at) else np.zeros(0, np.uint64) for i in range(2, len(every[0]))]
    return place, totals, [len(e[0]) for e in every]


def _answers(asked: DataFrame) -> DataFrame:
    """For each stretch that asks, and bucket: the counts of its words and pairs, and the bucket's tokens and distinct words."""

    def run(table: pa.Table) -> pa.Table:
        stretches, asks = table["stretch"].to_pylist(), table["asks"].to_pylist()
        bucket = table["bucket"][0].as_py()
        out = {}
        for kind in ("words", "pairs"):
            place, totals, sizes = _totals(table[kind].to_pylist())
            if kind == "words":
                n, k = int(totals[1].sum()), int((totals[1] > 0).sum())
            ends = np.cumsum(sizes)
            out[kind] = [joined(*(packed(t[place[e - z : e]]) for t in totals)) for e, z, a in zip(ends, sizes, asks, strict=True) if a]
        names = [s for s, a in zip(stretches, asks, strict=True) if a]
        m = len(names)
        cells, kinds = (names, [bucket] * m, out["words"], out["pairs"], [n] * m, [k] * m), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["stretch", "bucket", "words", "pairs", "n", "k"])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def losses(train: DataFrame, rows: DataFrame, alpha: float) -> DataFrame:
    """(uid, nll, n) of the texts of the index ``rows`` under the interpolated bigram model of the index ``train``."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        answers = answers.sort_by("bucket")
        n, k = sum(answers["n"].to_pylist()), sum(answers["k"].to_pylist())
        for row in texts.select(["uids", "sizes", "codes", "words"]).to_pylist():
            uids = row.pop("uids")
            s = Stretch(**row)
            counts = []
            for kind, keys, m in zip(("words", "pairs"), s.keys(), (2, 1), strict=True):
                order, found = _dealt(keys)[0], [parted(b) for b in answers[kind].to_pylist()]
                for i in range(m):
                    c = np.empty(len(order))
                    c[order] = np.concatenate([f[i] for f in found])
                    counts.append(c)
            cu, cv, cuv = counts
            p = 0.5 * (cuv + alpha) / (cu[s.left] + alpha * k) + 0.5 * (cv[s.right] + alpha) / (n + alpha * k)
            out.append(pa.table({"uid": pa.array(uids, pa.string()), "nll": sums(-np.log(p)[s.which], s.sizes), "n": s.sizes}))
        return pa.concat_tables(out) if out else pa.table({"uid": pa.array([], pa.string()), "nll": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})

    same = rows is train
    asked = _asked(train, True, same)
    if not same:
        asked = asked.unionByName(_asked(rows, False, True))
    each = rows.groupBy("stretch").cogroup(_answers(asked).groupBy("stretch")).applyInArrow(run, "uid string, nll double, n long")
    return each.groupBy("uid").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"))
