"""Substring dedup by recompression.

Rounds of recompression rewrite the word sequence of every document: first runs of one symbol, then pairs (left,
right), where a hash of a symbol's name puts it on either side. A new symbol's name is a fingerprint of the names it
joins, so all executors give equal substrings the same names without a shared table. A symbol depends on its own words
and those of its neighbours in each round; that range, kept beside it, tells which high-level symbols two equal windows
must share. Windows are filed under such symbols and long repeats are verified on fingerprints of their words
(``repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import BYTE_VALUE, Prefix, mix, text_chunks, word_hashes, words
from .repeats import Front, identified, merged, repeated_spans

ROUNDS = 3
_FAR = 1 << 40
_OTHER_VALUE = mix(BYTE_VALUE + np.uint64(0x51))


def _elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets)
    return word_hashes(data, starts, ends), Prefix(_OTHER_VALUE[data]).of(starts, ends), first


def _join(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, glue: np.ndarray) -> tuple[np.ndarray, ...]:
    """One rewriting: symbols i and i+1 become one where ``glue[i]``. Each range grows by the neighbours looked at."""
    n = len(names)
    same = doc[1:] == doc[:-1]
    head = np.ones(n, bool)
    head[1:] = ~glue
    at = np.flatnonzero(head)
    tail = np.append(at[1:], n) - 1
    prefix = Prefix(mix(names))
    new = np.where(tail > at, prefix.of(at, tail + 1), names[at])
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    left[0], left[1:] = -_FAR, np.where(same, lo[:-1], -_FAR)
    right[-1], right[:-1] = _FAR, np.where(same, hi[1:], _FAR)
    return new, left[at], right[tail], doc[at]


def recompress(names: np.ndarray, bounds: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """(names, lo, hi, doc) of the symbols after ``rounds``; lo and hi are beyond the text where its edge matters."""
    n = len(names)
    doc = np.searchsorted(bounds, np.arange(n), "right") - 1
    lo, hi = np.arange(n), np.arange(1, n + 1)
    for r in range(rounds):
        if not len(names):
            break
        names, lo, hi, doc = _join(names, lo, hi, doc, (names[1:] == names[:-1]) & (doc[1:] == doc[:-1]))
        side = (mix(names + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        names, lo, hi, doc = _join(names, lo, hi, doc, ~side[:-1] & side[1:] & (doc[1:] == doc[:-1]))
    return names, lo, hi, doc


def _front(window: int, rounds: int) -> Front:
    def symbols(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, values: np.ndarray, prefix: Prefix):
        names, lo, hi, doc = recompress(values, bounds, rounds)
        ok = (lo >= bounds[doc]) & (hi <= bounds[doc + 1]) & (hi - lo <= window)
        return lo[ok], hi[ok], mix(names[ok]), doc[ok]

    return Front(window, max(1, window // 12), _elements, symbols)


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            spans = batch.column(batch.schema.get_field_index("spans"))
            for row, end, data, offsets in text_chunks(batch):
                starts, ends, first = words(data, offsets)
                kept = np.ones(len(starts), bool)
                lists = spans.slice(row, end - row)
                for i in np.flatnonzero(np.asarray(lists.is_valid())):
                    for a, b in merged([(x["a"], x["b"]) for x in lists[i].as_py()]):
                        kept[first[i] + a : first[i] + b] = False
                where = np.flatnonzero(kept)
                count = np.searchsorted(where, first)
                gap = np.ones(len(where), bool)  # a space follows, but for the last kept word of a document
                gap[count[1:][np.diff(count) > 0] - 1] = False
                spaced = np.append(data, np.uint8(32))
                spaced[ends[where][gap]] = 32
                step = np.zeros(len(data) + 2, np.int8)
                step[starts[where]] += 1
                step[ends[where] + gap] -= 1
                inside = np.cumsum(step[:-1], dtype=np.int8) > 0
                out = spaced[inside]
                size = np.append(0, np.cumsum(ends[where] + gap - starts[where]))[count]
                view = memoryview(np.ascontiguousarray(out))
                sha = [hashlib.sha256(view[size[i] : size[i + 1]]).hexdigest() for i in range(end - row)]
                text = [bytes(view[size[i] : size[i + 1]]).decode() if with_text else None for i in range(end - row)]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array((n - np.diff(count)).astype(np.int64)), pa.array(sha, pa.string()), pa.array(text, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


def substring_dedup(docs: DataFrame, window: int = 50, rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """Remove every word covered by ``window`` words in a row that also start in a document with a smaller doc_id.

    Result: one row per row of ``docs`` with doc_id, n_words, n_removed, kept_sha256 and, if ``with_text``, kept. A null
    text has no words; texts shorter than the window are kept whole (words joined by one space); rows that repeat an id
    are one document, so they don't cut each other; a null id counts as the largest and stays null; an empty table gives
    an empty result; other columns are not read.
    """
    docs = identified(docs)
    spans = repeated_spans(docs, _front(window, rounds), "op2")
    joined = docs.join(spans.hint("merge"), "rid", "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(_cut(with_text), OUT)
    return out if with_text else out.drop("kept")


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)),
least_ AS (SELECT md5(g) AS k, min(doc_id) AS d FROM win GROUP BY 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM win JOIN least_ ON md5(g) = k AND d < doc_id),
cut AS (SELECT r, list(j) AS js FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(js, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN cut USING (r)
"""
