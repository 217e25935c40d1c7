"""Exact search for windows of fixed length that an earlier document of a corpus holds.

A *front* turns a document into elements (bytes or words) and symbols found from content alone. A symbol
``[lo, hi)`` is found again wherever the elements ``lo .. hi`` stand, so two equal windows hold the same symbols.
Each window is filed under its symbol of least priority; neighbouring windows under one symbol make a *run*.
Four steps then halve in on the repeats, each over only what the step before could not settle:

1. runs whose symbol occurs once hold no repeat;
2. runs with all their elements equal hold the same windows, so one of them stands for all;
3. runs that share a symbol but differ are cut into cells of ``grid`` windows aligned at the symbol, filed by the
   elements that all windows of the cell share, and compared in the same two ways;
4. the windows of cells that still differ are compared one by one.

Equality is that of two independent 64-bit fingerprints, in Spark aggregations with map-side combining; no group is gathered in a
task or on the driver. Windows without a symbol go to step 2 as runs of one window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Prefix, text_chunks
from .store import free, join_counted, stash

_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Front:
    """``elements(data, offsets)`` gives (values of the elements, other values of them, first element of each document);
    ``symbols(data, offsets, elements, prefix)`` gives (lo, hi, priority, document) of each symbol, in text order."""

    window: int
    grid: int
    elements: Callable
    symbols: Callable


def settle(lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, doc: np.ndarray, window: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start for which a symbol is the leftmost of least rank; none where first > last."""
    first = np.maximum(hi - window, begin[doc])
    last = np.minimum(lo, end[doc] - window)
    at, d = np.flatnonzero(first <= last), 1
    while len(at):
        at = at[at >= d]
        j = at - d
        near = (doc[j] == doc[at]) & (lo[j] >= first[at])
        at, j = at[near], j[near]
        hit = rank[j] <= rank[at]
        first[at[hit]] = lo[j[hit]] + 1
        at, d = at[~hit], d + 1
    at, d = np.flatnonzero(first <= last), 1
    while len(at):
        at = at[at + d < len(lo)]
        j = at + d
        near = (doc[j] == doc[at]) & (hi[j] - window <= last[at])
        at, j = at[near], j[near]
        hit = rank[j] < rank[at]
        last[at[hit]] = hi[j[hit]] - window - 1
        at, d = at[~hit], d + 1
    return first, last


def uncovered(first: np.ndarray, last: np.ndarray, window: int, bounds: np.ndarray) -> np.ndarray:
    """Window starts inside documents that no run [first, last] holds."""
    n = int(bounds[-1])
    long = np.flatnonzero(np.diff(bounds) >= window)
    step = np.zeros(n + 1, np.int64)
    step += np.bincount(bounds[long], minlength=n + 1)
    step -= np.bincount(bounds[long + 1] - window + 1, minlength=n + 1)
    step -= np.bincount(first, minlength=n + 1)
    step += np.bincount(last + 1, minlength=n + 1)
    return np.flatnonzero(np.cumsum(step[:n]) > 0)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _i32(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


RUNS = "key long, whole long, other long, rid long, doc long, first int, last int, lo int"


def _runs(front: Front) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, ids = _column(batch, "rid"), _column(batch, "doc")
            for row, _, data, offsets in text_chunks(batch):
                values, others, bounds = front.elements(data, offsets)
                prefix, second = Prefix(values), Prefix(others)
                lo, hi, rank, doc = front.symbols(data, offsets, bounds, values, prefix)
                first, last = settle(lo, hi, rank, doc, front.window, bounds[:-1], bounds[1:])
                ok = first <= last
                first, last, lo, hi, doc = first[ok], last[ok], lo[ok], hi[ok], doc[ok]
                key, whole, other = prefix.of(lo, hi), prefix.of(first, last + front.window), second.of(first, last + front.window)
                lone = uncovered(first, last, front.window, bounds)
                if len(lone):
                    h = prefix.of(lone, lone + front.window)
                    key, whole, other = np.concatenate([key, h]), np.concatenate([whole, h]), np.concatenate([other, second.of(lone, lone + front.window)])
                    first, last, lo = np.concatenate([first, lone]), np.concatenate([last, lone]), np.concatenate([lo, lone])
                    doc = np.concatenate([doc, np.searchsorted(bounds, lone, "right") - 1])
                base = bounds[doc]
                yield pa.RecordBatch.from_arrays(
                    [_i64(key), _i64(whole), _i64(other), _i64(rid[row + doc]), _i64(ids[row + doc]), _i32(first - base), _i32(last - base), _i32(lo - base)],
                    ["key", "whole", "other", "rid", "doc", "first", "last", "lo"],
                )

    return run


def _asked(batch: pa.RecordBatch, row: int, end: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row and fields of every struct in the list column ``asked`` of the rows."""
    col = batch.column(batch.schema.get_field_index("asked")).slice(row, end - row)
    counts = np.diff(np.asarray(col.offsets))
    flat = col.flatten()
    return np.repeat(np.arange(end - row), counts), [np.asarray(x).astype(np.int64) for x in flat.flatten()]


CELLS = "key long, whole long, other long, rid long, doc long, first int, last int"


def _cells(front: Front) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, k = front.grid, front.window
        for batch in batches:
            rid, ids = _column(batch, "rid"), _column(batch, "doc")
            for row, end, data, offsets in text_chunks(batch):
                values, others, bounds = front.elements(data, offsets)
                prefix, second = Prefix(values), Prefix(others)
                doc, (first, last, lo) = _asked(batch, row, end)
                least, most = (lo - last) // g, (lo - first) // g
                times = most - least + 1
                which = np.repeat(np.arange(len(doc)), times)
                cell = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + least[which]
                latest = lo[which] - cell * g
                a, b = np.maximum(first[which], latest - g + 1), np.minimum(last[which], latest)
                base = bounds[doc[which]]
                key = prefix.of(base + latest, base + latest - g + 1 + k)
                whole, other = prefix.of(base + a, base + b + k), second.of(base + a, base + b + k)
                at = row + doc[which]
                yield pa.RecordBatch.from_arrays([_i64(key), _i64(whole), _i64(other), _i64(rid[at]), _i64(ids[at]), _i32(a), _i32(b)], ["key", "whole", "other", "rid", "doc", "first", "last"])

    return run


def _windows(front: Front) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, ids = _column(batch, "rid"), _column(batch, "doc")
            for row, end, data, offsets in text_chunks(batch):
                values, others, bounds = front.elements(data, offsets)
                prefix, second = Prefix(values), Prefix(others)
                doc, (first, last) = _asked(batch, row, end)[0], _asked(batch, row, end)[1][:2]
                times = last - first + 1
                which = np.repeat(np.arange(len(doc)), times)
                at = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + first[which]
                start = bounds[doc[which]] + at
                h, other, r = prefix.of(start, start + front.window), second.of(start, start + front.window), row + doc[which]
                yield pa.RecordBatch.from_arrays([_i64(h), _i64(h), _i64(other), _i64(rid[r]), _i64(ids[r]), _i32(at), _i32(at)], ["key", "whole", "other", "rid", "doc", "first", "last"])

    return run


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``rid``, equal for rows of equal id and text, and ``doc``, the id with null last."""
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("doc"), "doc_id", "text")


KIND = ["key", "whole", "other"]


def _counted(rows: DataFrame, by: list[str], tag: str) -> DataFrame:
    """The values of ``by`` that more than one document has, with their rows and least document."""
    seen = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    return stash(seen.where("least < most").drop("most"), tag)


def _compare(rows: DataFrame, tag: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows settled as repeats of an earlier document, rows to ask among those of one key that differ: all of the kind's
    least document, as those do not settle each other)."""
    several = _counted(rows, ["key"], f"{tag}-several")
    shared = stash(join_counted(rows, several.select("key", "_n"), ["key"]).drop("_n"), f"{tag}-shared")
    free(rows, several)
    kinds = stash(shared.groupBy(*KIND).agg(F.count(F.lit(1)).alias("_n"), F.min("doc").alias("least"), F.max("doc").alias("most")), f"{tag}-kinds")
    mixed = stash(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"), f"{tag}-mixed")
    open_ = stash(join_counted(kinds.select(*KIND, "_n", "least"), mixed, ["key"], "_m").drop("_m"), f"{tag}-open")
    found = join_counted(shared, kinds.where("least < most").select(*KIND, "_n", "least"), KIND).where("doc > least").select("rid", "first", "last")
    ask = join_counted(shared, open_, KIND).where("doc = least").select("rid", *fields)
    found, ask = stash(found, f"{tag}-found"), stash(ask, f"{tag}-asks")
    free(shared, kinds, mixed, open_)
    return found, ask


def repeated_spans(docs: DataFrame, front: Front, tag: str) -> DataFrame:
    """(rid, spans array<struct<a int, b int>>): element ranges of ``identified`` documents covered by windows that start
    in a document with a smaller id. Spans may overlap. Documents without repeats have no row.
    """
    source = docs.select("rid", "doc", "text")

    def asked(reps: DataFrame, fields: list[str], name: str) -> DataFrame:
        asks = stash(reps.groupBy("rid").agg(F.collect_set(F.struct(*fields)).alias("asked")), name)  # bounded by the document
        return source.join(asks.hint("merge"), "rid")

    runs = stash(source.mapInArrow(_runs(front), RUNS), f"{tag}-runs")
    done, reps = _compare(runs, f"{tag}-runs", ["first", "last", "lo"])
    cells = stash(asked(reps, ["first", "last", "lo"], f"{tag}-ask").mapInArrow(_cells(front), CELLS), f"{tag}-cells")
    free()
    done2, reps = _compare(cells, f"{tag}-cells", ["first", "last"])
    last = stash(asked(reps, ["first", "last"], f"{tag}-ask2").mapInArrow(_windows(front), CELLS), f"{tag}-windows")
    free()
    earliest = _counted(last, KIND, f"{tag}-earliest")
    done3 = join_counted(last, earliest, KIND).where("doc > least").select("rid", "first", "last")
    spans = done.unionByName(done2).unionByName(done3)
    return stash(spans.groupBy("rid").agg(F.collect_set(F.struct(F.col("first").alias("a"), (F.col("last") + front.window).alias("b"))).alias("spans")), f"{tag}-spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
