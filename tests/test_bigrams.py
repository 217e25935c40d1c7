"""The bigram model against plain Python, and what it moves."""

import math
from collections import Counter

import pytest

from siftwell.operators import bigrams, scorers

TEXTS = ["a b a b c", "", None, "The cat, the CAT; the dog.", "a " * 50, "b", "x y z " * 7, "a b a b c"]


def _brute(train, texts):
    seqs = lambda ts: [["<s>", *"".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()] for t in ts]
    bi = Counter(p for w in seqs(train) for p in zip(w, w[1:]))
    cu, cv = Counter(), Counter()
    for (u, v), c in bi.items():
        cu[u] += c
        cv[v] += c
    n, k = sum(cv.values()), len(cv)
    p = lambda u, v: 0.5 * (bi[u, v] + 0.1) / (cu[u] + 0.1 * k) + 0.5 * (cv[v] + 0.1) / (n + 0.1 * k)
    return [(len(w) - 1, sum(-math.log(p(*g)) for g in zip(w, w[1:]))) for w in seqs(texts)]


def _table(spark, texts):
    return spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "uid string, text string")


@pytest.mark.parametrize("stretch", [1, 30, 16 << 20])
def test_losses_are_those_of_plain_python(spark, monkeypatch, stretch):
    monkeypatch.setattr(bigrams, "STRETCH", stretch)
    train, other = _table(spark, TEXTS), _table(spark, ["a b never seen", "<s> c", "", "dog the"])
    model = scorers.NgramLM(train)
    for df, texts in ((train, TEXTS), (other, [r.text for r in other.collect()])):
        got = {r.uid: (r.n, r.nll) for r in model.nll(df).collect()}
        want = {f"u{i}": x for i, x in enumerate(_brute(TEXTS, texts)) if x[0]}
        assert got.keys() == want.keys()
        assert all(got[u][0] == want[u][0] and got[u][1] == pytest.approx(want[u][1], rel=1e-12) for u in want)


def test_median_and_scores_come_from_one_run_of_the_model(spark, monkeypatch):
    runs, nll = [], scorers.NgramLM.nll
    monkeypatch.setattr(scorers.NgramLM, "nll", lambda self, df: runs.append(1) or nll(self, df))
    pool = _table(spark, TEXTS)
    scored = scorers.Perplexity(scorers.NgramLM(pool)).fit(pool).transform(pool).collect()
    x = [nll / n if n else 0.0 for n, nll in _brute(TEXTS, TEXTS)]
    middle = sum(sorted(x)[3:5]) / 2
    assert {r.uid: pytest.approx(r.score) for r in scored} == {f"u{i}": -abs(v - middle) for i, v in enumerate(x)}
    assert len(runs) == 1


def test_texts_and_pairs_are_not_joined_row_by_row(spark):
    docs = _table(spark, TEXTS)
    plan = scorers.NgramLM(docs).nll(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
