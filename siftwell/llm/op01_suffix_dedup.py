"""Suffix-array dedup by prefix-free parsing.

A rolling hash of the last ``TRIGGER`` bytes cuts every text into phrases, each with the trigger before it, so that equal
bytes are cut alike wherever they stand.

1. Dictionary: the distinct phrases of the corpus with their counts. A string that holds a phrase which occurs once can't
   repeat, so only *regions* between such phrases go on, and of equal regions one.
2. Parse: at every phrase end of a region (an *anchor*) stand the suffix of the phrase before it and the suffix of the
   parse after it. Each window belongs to the first anchor inside it, so it is a pair (suffix of a phrase, prefix of a
   parse suffix), and anchors whose next bytes nobody shares, or share in the same context, are settled by counting.
3. Corpus order: what is left is dealt by those next bytes; the suffix array of the parse suffixes and that of the phrase
   suffixes (read backwards), each with its common prefix lengths, are built and combined: two windows are equal if they
   are in one class of both orders at the depths that add up to the window.

A next-bytes key with more than ``GATHERED`` contexts is not gathered: its windows are compared as fingerprints of 128
bits. The same fingerprints tell equal regions and contexts apart; phrases are counted by 64 bits, where a collision costs
time but no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import BYTE_VALUE, Prefix, mix, text_chunks
from .repeats import _column, _i32, _i64, identified, merged
from .store import free, join_counted, stash

#: Bytes of the rolling hash; a phrase ends at one in 2**PHRASE_BITS bytes, an anchor at one in 2**ANCHOR_BITS.
TRIGGER, PHRASE_BITS, ANCHOR_BITS = 8, 6, 5
#: Contexts of one key that a task may gather; more are compared window by window.
GATHERED = 20_000
#: Contexts that a task combines at once, whole keys together.
_AT_ONCE = 20_000
_OTHER_VALUE = mix(BYTE_VALUE + np.uint64(0x51))


def _trigger(window: int) -> int:
    """Bytes of the rolling hash for a window."""
    return max(1, min(TRIGGER, window // 4))


def _ends(prefix: Prefix, offsets: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the triggers, and their texts: places whose last ``width`` bytes have a hash that ends in ``bits`` zeros."""
    n = len(prefix.sums) - 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled = mix((prefix.sums[width:] - prefix.sums[:-width]) * Prefix._inv[: n - width + 1])
    ends = np.flatnonzero(rolled & np.uint64((1 << bits) - 1) == 0) + width
    doc = np.searchsorted(offsets, ends, "left") - 1
    ok = ends - width >= offsets[doc]
    return ends[ok], doc[ok]


def _parsed(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Start, end, fingerprint, text and place in it of every phrase of texts of at least ``window`` bytes."""
    prefix, width = Prefix(BYTE_VALUE[data]), _trigger(window)
    ends, doc = _ends(prefix, offsets, width, PHRASE_BITS)
    same = doc[1:] == doc[:-1]
    start, end, doc = ends[:-1][same] - width, ends[1:][same], doc[1:][same]
    ok = np.diff(offsets)[doc] >= window
    start, end, doc = start[ok], end[ok], doc[ok]
    return start, end, prefix.of(start, end), doc, np.arange(len(doc)) - np.searchsorted(doc, doc, "left")


def _phrases(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = _column(batch, "rid")
            for row, _, data, offsets in text_chunks(batch):
                _, _, h, doc, at = _parsed(data, offsets, window)
                yield pa.RecordBatch.from_arrays([_i64(h), _i64(rid[row + doc]), _i32(at)], ["phrase", "rid", "at"])

    return run


def _regions(window: int):
    """The stretches of each text whose windows hold no phrase that occurs once, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = _column(batch, "rid")
            marks = batch.column(batch.schema.get_field_index("known"))
            for row, end_row, data, offsets in text_chunks(batch):
                start, end, _, doc, at = _parsed(data, offsets, window)
                part = marks.slice(row, end_row - row)
                size = np.diff(np.asarray(part.offsets))
                size[np.asarray(part.is_null())] = 0
                of, known = np.repeat(np.arange(end_row - row), size), np.asarray(part.flatten()).astype(np.int64)
                lone = ~np.isin((doc << 32) | at, (of << 32) | known)
                start, end, doc = start[lone], end[lone], doc[lone]
                m = end_row - row
                left, right = np.concatenate([offsets[:-1], start + 1]), np.concatenate([np.minimum(end - 1, start + window), offsets[1:]])
                left = left[np.lexsort((left, np.concatenate([np.arange(m), doc])))]
                order = np.lexsort((right, np.concatenate([doc, np.arange(m)])))
                right, doc = right[order], np.concatenate([doc, np.arange(m)])[order]
                ok = right - left >= window
                left, right, doc = left[ok], right[ok], doc[ok]
                if not len(left):
                    continue
                view = memoryview(data)
                pieces = [bytes(view[a:b]) for a, b in zip(left, right, strict=True)]
                names = [hashlib.blake2b(p, digest_size=16).digest() for p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), _i64(rid[row + doc]), _i32(left - offsets[doc]), _i32(right - left), pa.array(pieces, pa.binary())], ["name", "rid", "a", "n", "text"]
                )

    return run


ANCHORS = "key long, c1 long, c2 long, rid long, a int, first int, last int, e int"


def _anchors(window: int):
    """First and last window of every anchor of a region, with fingerprints of its next bytes and of its context."""
    width = _trigger(window)
    far = max(window * 3 // 4, width)  # a window whose first anchor lies further in is filed alone
    near = window - far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, start = _column(batch, "rid"), _column(batch, "a")
            for row, _, data, offsets in text_chunks(batch):
                prefix, other = Prefix(BYTE_VALUE[data]), Prefix(_OTHER_VALUE[data])
                e, doc = _ends(prefix, offsets, width, ANCHOR_BITS)
                before = np.append(-(1 << 40), e[:-1])[: len(e)]
                first = np.maximum(np.maximum(before - width + 1, offsets[doc]), e - far)
                last = np.minimum(e - width, offsets[doc + 1] - window)
                ok = first <= last
                e, doc, first, last = e[ok], doc[ok], first[ok], last[ok]
                key = prefix.of(e - width, e + near)
                step = np.zeros(len(data) + 1, np.int64)  # windows of no anchor
                long = np.flatnonzero(np.diff(offsets) >= window)
                np.add.at(step, offsets[long], 1)
                np.add.at(step, offsets[long + 1] - window + 1, -1)
                np.add.at(step, first, -1)
                np.add.at(step, last + 1, 1)
                alone = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                key = np.concatenate([key, prefix.of(alone, alone + window)])
                first, last, e = np.concatenate([first, alone]), np.concatenate([last, alone]), np.concatenate([e, alone + width])
                doc = np.concatenate([doc, np.searchsorted(offsets, alone, "right") - 1])
                c1, c2, base, r = prefix.of(first, last + window), other.of(first, last + window), offsets[doc], row + doc
                yield pa.RecordBatch.from_arrays(
                    [_i64(key), _i64(c1), _i64(c2), _i64(rid[r]), _i32(start[r]), _i32(first - base), _i32(last - base), _i32(e - base)], ["key", "c1", "c2", "rid", "a", "first", "last", "e"]
                )

    return run


CONTEXTS = "key long, many boolean, rid long, a int, first int, last int, e int, text binary"


def _contexts(window: int):
    """The bytes of the contexts asked of a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            rid, a, asked = _column(batch, "rid"), _column(batch, "a"), batch.column(batch.schema.get_field_index("asked"))
            for i in range(batch.num_rows):
                of = asked.slice(i, 1).flatten()
                text = texts[i].as_py()
                first, last = of.field("first").to_numpy(), of.field("last").to_numpy()
                pieces = [text[x : y + window] for x, y in zip(first, last, strict=True)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [of.field("key"), of.field("many"), pa.array(np.full(n, rid[i])), _i32(np.full(n, a[i])), of.field("first"), of.field("last"), of.field("e"), pa.array(pieces, pa.binary())],
                    ["key", "many", "rid", "a", "first", "last", "e", "text"],
                )

    return run


FOUND = "rid long, a int, first int, last int"


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the rows of a byte matrix, and how many bytes each shares with the one before it."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").reshape(n), kind="stable")
    common = np.zeros(n, np.int64)
    for i in range(1, n, 4096):
        j = min(n, i + 4096)
        differ = rows[order[i:j]] != rows[order[i - 1 : j - 1]]
        common[i:j] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def combine(key: np.ndarray, first: np.ndarray, last: np.ndarray, e: np.ndarray, texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(row, first, last) of the windows of contexts that stand in another context of the same key too."""
    n, width = len(key), _trigger(window)
    reach = int((e - first).max())
    after, before = np.zeros((n, window + 8), np.uint8), np.zeros((n, max(reach - width, 1)), np.uint8)
    after[:, :8] = key.astype(">i8").view(np.uint8).reshape(n, 8)
    for i, text in enumerate(texts):
        b, cut = np.frombuffer(text, np.uint8), e[i] - width - first[i]
        after[i, 8 : 8 + len(b) - cut] = b[cut:]
        before[i, :cut] = b[:cut][::-1]
    parse, common = _order(after)
    phrase, shared = _order(before)
    deep = common - 8
    least, most = e - last - width, e - first - width  # bytes before the trigger
    found = np.zeros((n, reach - width + 1), bool)
    after_class, before_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in np.flatnonzero(np.bincount(np.concatenate([np.arange(a, b + 1) for a, b in set(zip(least.tolist(), most.tolist()))]))):
        at = np.flatnonzero((least <= t) & (t <= most))
        if len(at) < 2:
            continue
        after_class[parse] = np.cumsum(deep < window - t)
        before_class[phrase] = np.cumsum(shared < t)
        _, inverse, count = np.unique(after_class[at] * (n + 1) + before_class[at], return_inverse=True, return_counts=True)
        found[at[count[inverse] > 1], t] = True
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return row, e[row] - width - high, e[row] - width - low


def _combined(window: int):
    """``combine`` over rows that come in order of their keys, some whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(rows: pa.Table) -> pa.RecordBatch:
            key, rid, a, first, last, e = (rows.column(c).to_numpy() for c in ("key", "rid", "a", "first", "last", "e"))
            row, lo, hi = combine(key, first.astype(np.int64), last.astype(np.int64), e.astype(np.int64), rows.column("text").to_pylist(), window)
            return pa.RecordBatch.from_arrays([_i64(rid[row]), _i32(a[row]), _i32(lo), _i32(hi)], ["rid", "a", "first", "last"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _AT_ONCE:
                rows = pa.Table.from_batches(held)
                key = rows.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
                if cut:
                    yield close(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield close(rows)

    return run


def _single(window: int):
    """Every window of the contexts with a fingerprint of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, a, first, last = (_column(batch, c) for c in ("rid", "a", "first", "last"))
            for row, end, data, offsets in text_chunks(batch):
                prefix, other = Prefix(BYTE_VALUE[data]), Prefix(_OTHER_VALUE[data])
                times = (last - first + 1)[row:end].astype(np.int64)
                of = np.repeat(np.arange(end - row), times)
                k = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                at, r = offsets[of] + k, row + of
                yield pa.RecordBatch.from_arrays(
                    [_i64(prefix.of(at, at + window)), _i64(other.of(at, at + window)), _i64(rid[r]), _i32(a[r]), _i32(first[r] + k)], ["c1", "c2", "rid", "a", "first"]
                )

    return run


def repeated_spans(docs: DataFrame, window: int, gathered: int = GATHERED) -> DataFrame:
    """(rid, spans array<struct<a int, b int>>): bytes of ``identified`` documents covered by windows that start elsewhere too.

    Joins on the corpus itself are sorted and merged at every size; what can be hot is joined by count (``join_counted``).
    """
    source = docs.select("rid", "text")
    phrases = stash(source.mapInArrow(_phrases(window), "phrase long, rid long, at int"), "op1-phrases")
    dictionary = stash(phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "op1-dictionary")
    free()
    known = join_counted(phrases, dictionary, ["phrase"]).groupBy("rid").agg(F.collect_set("at").alias("known"))  # bounded by the document
    known = stash(known, "op1-known")
    free(phrases, dictionary)
    regions = stash(source.join(known.hint("merge"), "rid", "left").mapInArrow(_regions(window), "name binary, rid long, a int, n int, text binary"), "op1-regions")
    free(known)
    kinds = stash(regions.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("rid", "a")).alias("one")), "op1-kinds")
    whole = stash(join_counted(regions.select("name", "rid", "a", "n"), kinds.where("_n > 1").select("name", "_n"), ["name"]).select("rid", F.col("a").alias("x"), (F.col("a") + F.col("n")).alias("y")), "op1-whole")
    ones = stash(regions.join(kinds.select("one.rid", "one.a").hint("merge"), ["rid", "a"]).select("rid", "a", "text"), "op1-ones")
    free(regions, kinds)

    anchors = stash(ones.mapInArrow(_anchors(window), ANCHORS), "op1-anchors")
    shared = stash(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "op1-shared")
    shared_anchors = stash(join_counted(anchors, shared, ["key"]).drop("_n"), "op1-shared-anchors")
    free(anchors, shared)
    contexts = stash(shared_anchors.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("rid", "a", "first", "last", "e")).alias("one")), "op1-contexts")
    settled = join_counted(shared_anchors, contexts.where("_n > 1").select("key", "c1", "c2", "_n"), ["key", "c1", "c2"])
    settled = stash(settled.select("rid", (F.col("a") + F.col("first")).alias("x"), (F.col("a") + F.col("last") + window).alias("y")), "op1-settled")
    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    open_ = contexts.select("key", "one").join(several.hint("merge"), "key").select("key", (F.col("m") > gathered).alias("many"), "one.*")
    asked = stash(open_.groupBy("rid", "a").agg(F.collect_list(F.struct("key", "many", "first", "last", "e")).alias("asked")), "op1-asked")  # bounded by the region
    free(shared_anchors, contexts)
    texts = stash(ones.join(asked.hint("merge"), ["rid", "a"]).mapInArrow(_contexts(window), CONTEXTS), "op1-texts")
    free(ones, asked)

    few = texts.where("not many").repartition("key").sortWithinPartitions("key").mapInArrow(_combined(window), FOUND)
    single = stash(texts.where("many").mapInArrow(_single(window), "c1 long, c2 long, rid long, a int, first int"), "op1-single")
    twice = stash(single.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "op1-twice")
    many = join_counted(single, twice, ["c1", "c2"]).select("rid", "a", "first", F.col("first").alias("last"))
    found = few.unionByName(many).select("rid", (F.col("a") + F.col("first")).alias("x"), (F.col("a") + F.col("last") + window).alias("y"))
    spans = whole.unionByName(settled).unionByName(found).groupBy("rid").agg(F.collect_set(F.struct(F.col("x").alias("a"), F.col("y").alias("b"))).alias("spans"))
    spans = stash(spans, "op1-spans")
    free(texts, single, twice, whole, settled)
    return spans


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            spans = batch.column(batch.schema.get_field_index("spans"))
            for row, end, data, offsets in text_chunks(batch):
                view, rows = memoryview(data), []
                lists = spans.slice(row, end - row)
                has = np.asarray(lists.is_valid())
                for i in range(end - row):
                    whole = view[offsets[i] : offsets[i + 1]]
                    cut = merged([(x["a"], x["b"]) for x in lists[i].as_py()]) if has[i] else []
                    digest, at, parts = hashlib.sha256(), 0, []
                    for a, b in [*cut, (len(whole), len(whole))]:
                        digest.update(whole[at:a])
                        if with_text:
                            parts.append(bytes(whole[at:a]))
                        at = b
                    rows.append((len(whole), sum(b - a for a, b in cut), len(cut), digest.hexdigest(), b"".join(parts) if with_text else None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def suffix_dedup(docs: DataFrame, window: int = 400, with_text: bool = False, gathered: int = GATHERED) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts at another place of the corpus.

    ``docs`` has doc_id and text; other columns are not read. Result: one row per row of ``docs`` with doc_id, n_bytes,
    n_removed, n_spans, kept_sha256 and, if ``with_text``, kept (the bytes left). A null text is empty; an empty or short
    text keeps its bytes; long texts are cut whole; repeated rows are two places, so both lose their shared bytes; a null id
    is kept as null; an empty table gives an empty result.
    """
    docs = identified(docs)
    spans = repeated_spans(docs, window, gathered)
    joined = docs.join(spans.hint("merge"), "rid", "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(_cut(with_text), OUT)
    return out if with_text else out.drop("kept")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query; null, empty and repeated rows and empty tables as in ``suffix_dedup``."""
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
