"""The classifier chain against plain Python: features, optimum of every fit, out-of-fold log odds, probabilities."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("siftwell.llm")
from siftwell.llm import op06_toxicity as op6
from siftwell.llm.kernel import BYTE_VALUE, Prefix

SCHEMA = "doc_id long, text string, p_toxic string, toxic int"
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def slot(piece: bytes, gram: bool) -> int:
    data = np.frombuffer(piece, np.uint8)
    h = int(Prefix(BYTE_VALUE[data]).of(np.array([0]), np.array([len(data)]))[0])
    return (h >> (64 - op6.SLOT_BITS)) + (gram << op6.SLOT_BITS)


def features(text: str | None) -> set[int]:
    out = set()
    for w in LETTERS.findall((text or "").encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        out.add((w, False))
        out.update((w[i : i + op6.GRAM], True) for i in range(len(w) - op6.GRAM + 1))
    return {slot(*piece) for piece in out}


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(300):
        bad, junk = i % 3 == 0, i % 4 == 0
        words = [word() for _ in range(30)] + ["Moron"] * bad + ["zzjunkzz"] * junk
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x", 1))
        if i < 240:
            labels.append((i, None if i % 10 == 7 else int(not junk), int(bad)))
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, "é" * 400_000 + " MORON, " + "q " * 400_000, "x", 1), rows[3], (None, "a moron", None, None), (None, None, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_features():
    texts = [r[1] for r in corpus()[0]]
    data = [(t or "").encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data]))
    doc, found = op6.slots_of(np.frombuffer(b"".join(data), np.uint8), offsets)
    got = [set() for _ in texts]
    for d, s in set(zip(doc.tolist(), found.tolist())):
        got[d].add(s)
    assert got == [features(t) for t in texts]


def test_chain(tables):
    docs, labels = tables
    model = op6.train(docs, labels)
    rows = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    marks = {r.doc_id: (np.nan if r.quality is None else 1.0 - r.quality, float(r.toxic)) for r in labels.collect()}
    key = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(text) k").collect()}
    ids = sorted(marks, key=lambda i: key[i])
    y = np.array([marks[i] for i in ids])
    x = np.array([[s in f for s in model.used] for f in (features(rows[i]) for i in ids)], float)
    fold = np.arange(len(ids)) % op6.FOLDS
    assert len(model.used) and slot(b"moron", False) in model.used
    for k, w in enumerate(model.weights):
        known = ~np.isnan(y[:, k])
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        gradient = np.hstack([x, np.ones((len(x), 1))])[known].T @ (y[known, k] - p[known]) - np.append(np.full(len(w) - 1, op6.PENALTY), 1e-3) * w
        assert np.abs(gradient).max() < 1e-4
        for f in range(op6.FOLDS):
            rest = known & (fold != f)
            v = op6.fit_logistic(x[rest], y[rest, k])
            assert np.allclose(model.held[k][fold == f], np.clip(x[fold == f] @ v[:-1] + v[-1], -op6.ODDS, op6.ODDS))
        x = np.hstack([x, model.held[k][:, None]])
    out = {r.doc_id: r for r in op6.toxicity(docs, labels, model=model).collect()}
    for i, text in rows.items():
        f = features(text)
        odds = []
        for w in model.weights:
            z = sum(w[j] for j, s in enumerate(model.used) if s in f) + w[-1] + sum(w[len(model.used) + j] * o for j, o in enumerate(odds))
            odds.append(min(max(z, -op6.ODDS), op6.ODDS))
        want = [1 / (1 + np.exp(-o)) for o in odds]
        assert np.allclose([out[i].p_low_quality, out[i].p_toxic], want) and out[i].toxic == (want[-1] >= op6.LEAST)
    assert {i for i, r in out.items() if r.toxic} - {None} == {i for i, t in rows.items() if t and "moron" in t.lower()}


def test_held_out_recall(tables):
    docs, labels = tables
    held = {i for i in range(240) if i % 5 == 0}
    model = op6.train(docs, labels.where("doc_id % 5 != 0"))
    found = {r.doc_id for r in op6.toxicity(docs, labels, model=model).where("toxic").collect()} & held
    assert found == {i for i in held if i % 3 == 0}


def test_edges(tables):
    docs, labels = tables
    kept = op6.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 2 and kept.where("text = ''").count() == 1
    assert op6.without_toxic(docs.where("false"), labels).count() == 0
    assert op6.toxicity(docs, labels.where("false")).where("toxic").count() == 0
    alone = op6.toxicity(docs.where("text is null or text = ''"), labels)
    assert alone.count() == 3 and alone.where("toxic").count() == 0
