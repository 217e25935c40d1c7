"""Words and n-gram buckets taken in numpy against the column expressions."""

import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as t
from siftwell.functions import words as w
from siftwell.operators import scorers

TEXTS = ["One, two;  THREE.", "", None, " a\tb\nKelvin İx café z ", "x" * 9000 + " y " + "z" * 300, "...", "b b b b"]


def test_words_and_crcs_are_those_of_the_texts(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i long, text string")
    rows = df.select("i", t.normal_words(F.col("text")).alias("w"), F.lower("text").alias("low")).orderBy("i").collect()
    texts = pa.array([None, *[r.low for r in rows], "x"])[1:-1]  # a slice, as Arrow batches are cut
    sizes, codes, words = w.coded(texts)
    assert [words[c] for c in codes] == [x for r in rows for x in r.w or []] and list(sizes) == [len(r.w or []) for r in rows]
    for n, (grams, crc) in enumerate(w.gram_crcs(sizes, codes, words, 3), 1):
        want = [[zlib.crc32(" ".join(r.w[i : i + n]).encode()) for i in range(len(r.w or []) - n + 1)] for r in rows]
        assert list(grams) == [len(x) for x in want] and crc.tolist() == [c for x in want for c in x]


def test_numbers_in_few_bytes_come_back():
    for values in ([], [0], [0, 255, 256, 2**64 - 1]):
        assert w.unpacked(w.packed(w.np.array(values, "u8"))).tolist() == values


@pytest.mark.parametrize("stretch", [1, 8 << 20])
def test_dsir_equals_its_expressions_without_running_them(spark, monkeypatch, stretch):
    monkeypatch.setattr(scorers, "STRETCH", stretch)
    pool = spark.createDataFrame([(f"u{i}", x) for i, x in enumerate(TEXTS)], "uid string, text string")
    d = scorers.Dsir(pool.limit(1), buckets=50, gumbel_noise=False).fit(pool)
    grams = pool.select("uid", t.ngram_buckets(t.normal_words(F.coalesce("text", F.lit(""))), 2, 50).alias("g")).collect()
    want = {r.uid: sum(d.ratios[b] for b in r.g) / max(len(r.g), 1) for r in grams}
    out = d.transform(pool)
    assert {r.uid: r.score for r in out.collect()} == {u: pytest.approx(x, abs=1e-12) for u, x in want.items()}
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()
