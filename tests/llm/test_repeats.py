"""Operators 1 and 2 against brute force."""

import hashlib
import random
import re

import pytest

pytest.importorskip("siftwell.llm")
from siftwell.llm.op01_suffix_dedup import suffix_dedup
from siftwell.llm.op02_substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, rid string, spans long"


def corpus(seed, alphabet, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 300))) for _ in range(8)]
    texts = [None, "", " ", alphabet[0] * 500, (alphabet[0] + " ") * 300, "é" * 120]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                p[rng.randrange(len(p))] = rng.choice(alphabet)
            parts.append("".join(p))
        texts.append("".join(parts))
    texts += texts[8:12]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return rows + rows[9:11] + [(None, texts[10], "x", 1), (None, texts[13], "x", 1)]


def brute_bytes(rows, k):
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - k + 1):
            seen.setdefault(b[i : i + k], []).append((d, i))
    gone = [set() for _ in raw]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + k))
    out = []
    for (doc, *_), b, g in zip(rows, raw, gone):
        kept = bytes(x for i, x in enumerate(b) if i not in g)
        out.append((doc, len(b), len(g), sum(i - 1 not in g for i in g), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, k):
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    key = [(1 << 63) - 1 if d is None else d for d, *_ in rows]
    least = {}
    for d, w in zip(key, ws):
        for i in range(len(w) - k + 1):
            t = tuple(w[i : i + k])
            least[t] = min(least.get(t, d), d)
    out = []
    for (doc, *_), d, w in zip(rows, key, ws):
        gone = {j for i in range(len(w) - k + 1) if least[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,alphabet,k", [(1, "ab cd", 24), (2, "abcdefghij \n", 40), (3, "aé", 16)])
def test_bytes(spark, seed, alphabet, k):
    rows = corpus(seed, alphabet)
    assert rows_of(suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), window=k)) == sorted(brute_bytes(rows, k), key=repr)


@pytest.mark.parametrize("gathered", [0, 2, 10**6])
def test_bytes_of_wide_windows(spark, gathered):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop  \né") for _ in range(n))
    pool = [text(rng.randint(300, 1500)) for _ in range(6)] + ["ab" * 300, "x" * 900]
    rows = [(0, None, "x", 1), (1, "", "x", 1), (2, "x" * 399, "x", 1), (3, "x" * 400, "x", 1)]
    for i in range(4, 120):
        parts = [text(rng.randint(0, 600))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(pool))
            for _ in range(rng.randint(0, 2)):
                p[rng.randrange(len(p))] = rng.choice("abXY")
            parts += ["".join(p), text(rng.randint(0, 200))]
        rows.append((i, "".join(parts), "x", 1))
    rows += [rows[7], rows[9], (None, rows[11][1], "x", 1), (500, text(120_000) + pool[0] + text(1_300_000), "x", 1)]
    got = rows_of(suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), gathered=gathered))
    assert got == sorted(brute_bytes(rows, 400), key=repr)


@pytest.mark.parametrize("seed,alphabet,k", [(4, "ab   \n", 12), (5, "abc ", 20), (6, "a ", 12)])
def test_words(spark, seed, alphabet, k):
    rows = corpus(seed, alphabet)
    assert rows_of(substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), window=k)) == sorted(brute_words(rows, k), key=repr)


def test_kept_text_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "z a b c d e f", "x", 1)], SCHEMA)
    assert [r.kept for r in substring_dedup(df, window=3, with_text=True).orderBy("doc_id").collect()] == ["a b c d e f", "z"]
    assert [bytes(r.kept) for r in suffix_dedup(df, window=9, with_text=True).orderBy("doc_id").collect()] == [b"", b"z "]
    assert suffix_dedup(df.where("false")).count() == 0
    assert substring_dedup(df.where("false")).count() == 0


def test_words_repeated_in_the_least_document(spark, k=50):
    rng = random.Random(7)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for case in range(12):
        a, n = words(3 * k), 10 * case
        edition = a[: k + k // 2] + ["other"] + a[k + k // 2 + 1 :]
        rows += [(n + 5, a + words(4) + a + a, "x", 1), (n + 3, words(5) + edition, "x", 1)]
        rows += [(None, words(2) + a + words(3) + a, "x", 1), (None, words(case) + edition + edition, "x", 1)]
        b = words(3 * k)
        rows += [(None, words(3) + b + words(3) + b, "x", 1), (n + 4, words(6) + b[: 2 * k], "x", 1), (None, b[k // 2 :] + words(1), "x", 1)]
    rows = [(i, " ".join(w), x, y) for i, w, x, y in rows]
    assert rows_of(substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), window=k)) == sorted(brute_words(rows, k), key=repr)
