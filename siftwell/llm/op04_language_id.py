"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Training documents of a language (about so many, those whose ids and texts hash lowest); words of a language and n-grams
#: of a language and order that the model keeps, the most frequent; longest n-gram; add-constant of the frequencies.
SAMPLE, MOST_WORDS, MOST_GRAMS, LONGEST, SMOOTH = 2000, 20_000, 15_000, 5, 0.5
#: Words whose score a task remembers before it starts afresh.
REMEMBERED = 200_000
_word = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


class Backoff:
    """Scores of words by language. ``counts``: of order 0 (words) and 1 to ``LONGEST`` (n-grams), by language, what was seen how often."""

    def __init__(self, counts: dict[int, dict[str, dict[str, int]]]) -> None:
        self.langs = sorted(counts.get(0, {}))
        place = {lang: k for k, lang in enumerate(self.langs)}
        tables: dict[int, dict[str, np.ndarray]] = {}
        for n, by_lang in counts.items():
            names = sorted({g for seen in by_lang.values() for g in seen})
            at = {g: i for i, g in enumerate(names)}
            m = np.full((len(names), len(self.langs)), SMOOTH)
            for lang, seen in by_lang.items():
                for g, c in seen.items():
                    m[at[g], place[lang]] += c
            tables[n] = dict(zip(names, np.log(m / m.sum(axis=0)), strict=True))
        self.words = tables.get(0, {})
        self.orders = [(n, tables[n]) for n in range(LONGEST, 0, -1) if n in tables]

    @staticmethod
    def grams(word: str, n: int) -> list[str]:
        padded = f"^{word}$" if n > 1 else word
        return [padded[i : i + n] for i in range(len(padded) - n + 1)] or [padded]

    def word(self, w: str) -> np.ndarray:
        """Log frequency by language, less that of the best language."""
        found = self.words.get(w)
        for n, known in self.orders if found is None else ():
            got = [known[g] for g in self.grams(w, n) if g in known]
            if 2 * len(got) >= max(1, len(w) + 3 - n):
                found = np.mean(got, axis=0)
                break
        return np.zeros(len(self.langs)) if found is None else found - found.max()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, count) of words with counts; order 0 is the word."""
    for b in batches:
        found: dict[tuple[str, int, str], int] = Counter()
        for lang, w, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            found[lang, 0, w] += c
            for n in range(1, LONGEST + 1):
                for g in Backoff.grams(w, n):
                    found[lang, n, g] += c
        if found:
            langs, orders, grams = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(orders, pa.int32()), pa.array(grams, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "order", "gram", "n"])


def train(docs: DataFrame, sample: int = SAMPLE, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Backoff:
    """A model of about ``sample`` of the documents of each language, fewer where there are fewer; equal rows count once."""
    known = docs.where("lang is not null and text is not null")
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count(F.lit(1))).alias("_share"))  # one row a language
    place = F.pmod(F.col("_h"), F.lit(1 << 40)) / float(1 << 40)
    rows = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("_h")).join(F.broadcast(share), "lang").where(place < F.col("_share"))
    rows = rows.groupBy("lang", "_h").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], int] = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(_word.findall(text.lower())).items():
                    found[lang, w] += n
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    words = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = words.mapInArrow(_grams, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram"))  # of a bounded sample
    seen = seen.withColumn("_r", top).where(F.col("_r") <= F.when(F.col("order") == 0, most_words).otherwise(most_grams)).drop("_r")
    counts: dict[int, dict[str, dict[str, int]]] = {}
    for lang, order, gram, n in seen.toArrow().to_pandas().itertuples(index=False):
        counts.setdefault(order, {}).setdefault(lang, {})[gram] = n
    return Backoff(counts)


def predict(docs: DataFrame, model: Backoff, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score, of the whole text alone."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((1024, len(model.langs)))
        for b in batches:
            best, score = [], []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                counts = Counter(_word.findall(text.lower())) if text else {}
                if not counts or not model.langs:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                if len(known) > REMEMBERED:
                    known = {}
                at = []
                for w in counts:
                    i = known.get(w)
                    if i is None:
                        i = known[w] = len(known)
                        if i == len(table):
                            table = np.concatenate([table, np.zeros_like(table)])
                        table[i] = model.word(w)
                    at.append(i)
                use = table[at]
                total = np.fromiter(counts.values(), float, len(counts)) @ use
                p = np.exp(total - total.max())
                k = int(total.argmax())
                best.append(model.langs[k])
                score.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang).

    Held-out documents, whose crc32(doc_id as text) leaves ``held`` when divided by ``folds``, are not learned from; a
    null id counts as the empty text. A text that is null or has no letter is ``und`` with score 0, as are all where
    nothing could be learned. Repeated rows are judged alike; an empty table gives an empty result.
    """
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    docs = docs.select("doc_id", "text", "lang", (rest == held).alias("held_out"))
    return predict(docs, train(docs.where("not held_out"), sample), ["doc_id", "held_out"])
