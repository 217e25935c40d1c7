"""Toxicity by a chain of linear classifiers over hashed words and character n-grams.

A text's features are the presence of its words (runs of letters, A-Z lower-cased) and of the ``GRAM``-byte strings inside
them, hashed to slots. Of all slots those are used that the labels of a category depend on most, for or against it.
Each category has a logistic model; later models also get the log odds of the earlier categories. In training these come
from models fitted without the document's fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import BYTE_VALUE, Prefix, lower_ascii, text_chunks
from .store import free, stash

#: Category names with the condition on a labels row, in the order of the chain; the last one decides.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
#: Labelled documents learned from at most (those whose ids hash lowest); folds; L2 penalty; deciding probability.
SAMPLE, FOLDS, PENALTY, LEAST = 8000, 5, 1.0, 0.5
#: Bits of the slots of words and of n-grams; bytes of an n-gram; slots used of each kind and category at most, and the
#: least dependence (G statistic) of one; log odds are cut at this.
SLOT_BITS, GRAM, FEATURES, EVIDENCE, ODDS = 17, 4, 150, 12.0, 8.0
SLOTS = 2 << SLOT_BITS
#: Bytes of letters; all of UTF-8 outside ASCII counts as letters.
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every word and n-gram of the texts, repeats included."""
    data = lower_ascii(data)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _letter[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    joined = np.zeros(n + 1, bool)  # a letter that goes on the word before
    joined[1:n] = inside[1:] & inside[:-1] & ~edge[1:n]
    starts = np.flatnonzero(inside & ~joined[:n])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    prefix = Prefix(BYTE_VALUE[data])
    run = np.cumsum(joined[1:n], dtype=np.int64)
    run = np.append(0, run)  # letters joined on so far
    at = np.flatnonzero(run[GRAM - 1 :] - run[: n - GRAM + 1] == GRAM - 1) if n >= GRAM else np.zeros(0, np.int64)
    shift = np.uint64(64 - SLOT_BITS)
    words = (prefix.of(starts, ends) >> shift).astype(np.int64)
    grams = (prefix.of(at, at + GRAM) >> shift).astype(np.int64) + (1 << SLOT_BITS)
    where = np.concatenate([starts, at])
    return np.searchsorted(offsets, where, "right") - 1, np.concatenate([words, grams])


def present(data: np.ndarray, offsets: np.ndarray, feature: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each of the ``width`` features that a text has; ``feature`` maps slots, -1 to none."""
    doc, slot = slots_of(data, offsets)
    f = feature[slot]
    key = np.unique(doc[f >= 0] * width + f[f >= 0])
    return key // max(width, 1), key % max(width, 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps on the penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -ODDS, ODDS)


def dependence(a: np.ndarray, b: np.ndarray, n: float, m: float) -> np.ndarray:
    """G statistic of a of n against b of m."""
    rate = (a + b) / max(n + m, 1)
    term = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    return 2 * (term(a, n * rate) + term(b, m * rate) + term(n - a, n * (1 - rate)) + term(m - b, m * (1 - rate)))


def chosen(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Slots to use. ``counts``: texts with a slot, by category, mark (0, 1) and slot; ``total``: texts by category and mark."""
    out: set[int] = set()
    for c, t in zip(counts, total, strict=True):
        g = dependence(c[1], c[0], t[1], t[0])
        for first in (0, 1 << SLOT_BITS):
            part = g[first : first + (1 << SLOT_BITS)]
            best = np.argsort(-part, kind="stable")[:FEATURES]
            out.update((best[part[best] >= EVIDENCE] + first).tolist())
    return np.array(sorted(out), np.int64)


class Chain:
    """Weights of the categories ``names`` over the slots ``used``, from a dense matrix of presence and marks.

    ``marks`` has a column of 0, 1 or NaN (unknown: not learned from) for each category. ``held`` keeps the out-of-fold
    log odds of the training rows.
    """

    def __init__(self, names: list[str], used: np.ndarray, x: np.ndarray, marks: np.ndarray, folds: int = FOLDS) -> None:
        self.names, self.used, self.weights, self.held = names, used, [], []
        fold = np.arange(len(x)) % folds
        for y in marks.T:
            known = ~np.isnan(y)
            if not known.any():
                self.weights.append(np.append(np.zeros(x.shape[1]), -ODDS))
                out = np.full(len(y), -ODDS)
            else:
                self.weights.append(fit_logistic(x[known], y[known]))
                out = np.zeros(len(y))
                for f in range(folds):
                    rest = known & (fold != f)
                    out[fold == f] = _odds(x[fold == f], fit_logistic(x[rest], y[rest]) if rest.any() else self.weights[-1])
            self.held.append(out)
            x = np.hstack([x, out[:, None]])

    def feature(self) -> np.ndarray:
        f = np.full(SLOTS, -1, np.int64)
        f[self.used] = np.arange(len(self.used))
        return f

    def score(self, data: np.ndarray, offsets: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """A row of probabilities for each text; ``feature``: from ``feature()``."""
        n, width = len(offsets) - 1, len(self.used)
        doc, f = present(data, offsets, feature, width) if width else (np.zeros(0, np.int64),) * 2
        odds: list[np.ndarray] = []
        for w in self.weights:
            z = np.bincount(doc, w[f], minlength=n) + w[-1]
            for k, earlier in enumerate(odds):
                z += w[width + k] * earlier
            odds.append(np.clip(z, -ODDS, ODDS))
        return _sigmoid(np.stack(odds, axis=1)) if odds else np.zeros((n, 0))


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark pattern, slot, texts with it) of all texts of a task; slot -1 counts the texts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        pattern = batch.column(batch.schema.get_field_index("pattern")).to_numpy()
        for row, end, data, offsets in text_chunks(batch):
            doc, slot = slots_of(data, offsets)
            key = np.unique(doc * SLOTS + slot)
            for p in np.unique(pattern[row:end]):
                t = total.setdefault(int(p), np.zeros(SLOTS + 1, np.int64))
                t[:SLOTS] += np.bincount(key[pattern[row + key // SLOTS] == p] % SLOTS, minlength=SLOTS)
                t[SLOTS] += int((pattern[row:end] == p).sum())
    for p, t in total.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(at.astype(np.int32)), pa.array(t[at])], ["pattern", "slot", "n"])


def _rows(feature: np.ndarray, width: int):
    """Features of each text as a list of 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch):
                doc, f = present(data, offsets, feature, width) if width else (np.zeros(0, np.int64),) * 2
                cut = np.searchsorted(doc, np.arange(end - row + 1))
                found = [f[a:b].astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("key", "pattern")] + [pa.array(found, pa.binary())], ["key", "pattern", "f"])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """A chain from at most ``sample`` labelled documents, those whose ids hash lowest; equal texts count once.

    A label is unknown for a category where its own mark is null. Texts stay on the executors: only counts by slot and
    each text's numbers of chosen features (at most 2 * 2 * ``FEATURES`` a category) reach the driver.
    """
    names = [n for n, _ in categories]
    mark = lambda c: F.coalesce(F.expr(c).cast("int"), F.lit(2))
    pattern = sum((mark(c) * 3**k for k, (_, c) in enumerate(categories)), F.lit(0))
    marks = labels.where("doc_id is not null").select("doc_id", pattern.alias("pattern")).groupBy("doc_id").agg(F.min("pattern").alias("pattern"))
    marks = marks.where(F.col("pattern") < 3 ** len(categories) - 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(marks), "doc_id")
    found = found.groupBy(F.xxhash64("text").alias("key")).agg(F.min("pattern").alias("pattern"), F.min_by("text", "doc_id").alias("text"))
    rows = stash(found, "op6-labelled")
    counted = rows.mapInArrow(_documents_with, "pattern int, slot int, n long").groupBy("pattern", "slot").agg(F.sum("n").alias("n")).toArrow()
    p, slot, n = (counted.column(c).to_numpy() for c in ("pattern", "slot", "n"))
    counts = np.zeros((len(names), 2, SLOTS + 1), np.int64)
    for k in range(len(names)):
        for v in (0, 1):
            at = p // 3**k % 3 == v
            counts[k, v] = np.bincount(slot[at], n[at], minlength=SLOTS + 1)
    used = chosen(counts[:, :, :SLOTS], counts[:, :, SLOTS])
    feature = np.full(SLOTS, -1, np.int64)
    feature[used] = np.arange(len(used))
    table = rows.mapInArrow(_rows(feature, len(used)), "key long, pattern int, f binary").toArrow().sort_by("key")
    free(rows)
    x = np.zeros((table.num_rows, len(used)))
    for i, f in enumerate(table.column("f")):
        x[i, np.frombuffer(f.as_py(), np.uint16)] = 1
    p = table.column("pattern").to_numpy()
    y = np.stack([p // 3**k % 3 for k in range(len(names))], axis=1).astype(float) if len(p) else np.zeros((0, len(names)))
    y[y == 2] = np.nan
    return Chain(names, used, x, y)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = LEAST, model: Chain | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of ``docs`` with p_<category> and, last, toxic: the last probability is ``least`` or more.

    Of several labels of one document the least pattern of marks counts. A null or empty text has no features, so its
    probabilities are those of no evidence; long texts count whole; repeated rows are judged alike; where there are no
    labels nothing is toxic; an empty table gives an empty result.
    """
    model, keep = model or train(docs, labels), keep or ["doc_id"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", p_{n} double" for n in model.names) + ", toxic boolean"
    names = [*keep, *(f"p_{n}" for n in model.names), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = model.feature()
        for b in batches:
            for row, end, data, offsets in text_chunks(b, "_text"):
                p = model.score(data, offsets, feature)
                part = b.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= least)], names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = LEAST, model: Chain | None = None) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` does not find toxic, with all their columns; its rules on null and empty
    texts, repeated rows and empty tables hold."""
    model = model or train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = model.feature()
        for b in batches:
            for row, end, data, offsets in text_chunks(b):
                yield b.slice(row, end - row).filter(pa.array(model.score(data, offsets, feature)[:, -1] < least))

    return docs.mapInArrow(run, docs.schema)
