"""Operators 3 to 10 against brute force or planted cases, with nulls, empty texts, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("siftwell.llm")
from siftwell.llm import op03_source_mix as op3
from siftwell.llm import op04_language_id as op4
from siftwell.llm import op05_lm_score as op5
from siftwell.llm import op06_toxicity as op6
from siftwell.llm import op07_secret_scan as op7
from siftwell.llm import op08_jaccard_join as op8
from siftwell.llm import op09_decontaminate as op9
from siftwell.llm import op10_quality_rules as op10

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, toxic string, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf that lives in the dark wood".split()
EN, DE = " ".join(BASE), "der schnelle braune fuchs springt über den faulen hund und läuft weit weg von dem bösen wolf der im dunklen wald lebt"


def rows():
    out = [(i, f"{EN} {i} {' '.join(BASE[i % 7 :])}" if i % 2 else f"{DE} {i}", "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, 1, 7, "x", "y") for i in range(60)]
    extra = [None, "", " \n\t", "word", "1234 !!", EN, EN, "a b c d"]
    out += [(100 + i, t, None, "s0", 0, None, None, None) for i, t in enumerate(extra)]
    return [*out, out[1], out[2], (None, EN, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_mix(docs):
    out = op3.mix(docs).collect()
    assert len(out) == len(rows()) and all(0 <= r.taken <= 3 * r.size for r in out)
    taken, goal, most = Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.taken
        goal[r.source] = (r.target, r.source_size)
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - g) <= 2 * most[s] and g <= 3 * n for s, (g, n) in goal.items())
    assert math.isclose(sum(g for g, _ in goal.values()), sum(len(WORD.findall(r[1] or "")) for r in rows()))
    assert sorted(op3.mix(docs).collect(), key=repr) == sorted(out, key=repr)
    assert op3.mix(docs.where("false")).count() == 0 and "toxic" in op3.mixed(docs).columns
    again = op3.mixed(docs.selectExpr("*", "'x' as mix_copies"))
    assert again.columns == op3.mixed(docs).columns and again.count() == op3.mixed(docs).count()


def test_mix_of_null_ids(spark):
    rows = [(None, f"a b c d {i}", f"s{i % 3}") for i in range(300)]
    out = op3.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("s0", "s1", "s2"):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5


def test_language(docs):
    out = op4.identify(docs).collect()
    want = {r[0]: r[2] for r in rows() if r[2]}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1) for r in out)
    assert all(r.lang_pred == want[r.doc_id] for r in out if r.doc_id in want)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {100, 101, 102, 104} and all(0 <= r.score <= 1 for r in out)
    assert op4.identify(docs.where("false")).count() == 0


def test_language_by_hand(docs):
    """Word-first backoff in plain Python, without any bound."""
    rows_ = [r for r in {(r[0], r[1], r[2]) for r in rows()} if r[1] is not None]
    letters = re.compile(r"[^\W\d_]+")
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 3 == 1
    seen = {n: {} for n in range(6)}
    grams = lambda w, n: [w] if n == 0 else [x[i : i + n] for x in [f"^{w}$" if n > 1 else w] for i in range(len(x) - n + 1)] or [f"^{w}$"]
    for i, text, lang in rows_:
        if lang and not held(i):
            for w in letters.findall(text.lower()):
                for n in range(6):
                    for g in grams(w, n):
                        seen[n].setdefault(lang, Counter())[g] += 1
    langs = sorted(seen[0])
    names = {n: {g for c in seen[n].values() for g in c} for n in range(6)}
    total = {n: [sum(seen[n][x].values()) + op4.SMOOTH * len(names[n]) for x in langs] for n in range(6)}
    log = lambda n, g: np.array([math.log((seen[n][x][g] + op4.SMOOTH) / t) for x, t in zip(langs, total[n])])

    def word(w):
        for n in (0, 5, 4, 3, 2, 1):
            got = [log(n, g) for g in grams(w, n) if g in names[n]]
            if got and (n == 0 or 2 * len(got) >= max(1, len(w) + 3 - n)):
                return np.mean(got, axis=0)
        return np.zeros(len(langs))

    for r in op4.identify(docs).collect():
        text = next((t for i, t, *_ in rows() if i == r.doc_id), None)
        found = letters.findall((text or "").lower())
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = sum(word(w) - word(w).max() for w in found)
        p = np.exp(z - z.max())
        assert r.lang_pred == langs[int(z.argmax())] and math.isclose(r.score, p.max() / p.sum(), rel_tol=1e-6)


def test_lm_base(docs):
    toks = [[w.lower() for w in WORD.findall(r[1] or "")] + [""] for r in rows()]
    held = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 10 == 0 for r in rows()]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0] is None, r[0] or 0, h, len(t), sum(w in c for w in t), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r, t, h in zip(rows(), toks, held)))
    out = op5.score(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 for r in out)


def test_lm_phrases(spark):
    def cut(text):
        out, now = [], []
        for w in WORD.findall((text or "").lower()):
            b = np.frombuffer(w.encode(), np.uint8)
            now.append(w)
            if (int(op5.word_hashes(b, np.array([0]), np.array([len(b)]))[0]) >> 32) % op5.SPAN == 0:
                out.append(tuple(now))
                now = []
        return [*out, (*now, None)]

    texts = [r[1] for r in rows()] + [f"{EN} {DE} {EN}", f"{DE} {DE} {EN}"]
    held = [i % 4 == 0 for i in range(len(texts))]
    cuts = [cut(t) for t in texts]
    assert max(map(len, cuts)) > 2
    keyed = [[(q, (c[i - 1] if i else None, q)) for i, q in enumerate(c)] for c in cuts]
    total = [Counter(k[x] for d, h in zip(keyed, held) if not h for k in d) for x in (0, 1)]
    want = []
    for d, h in zip(keyed, held):
        own = [Counter(k[x] for k in d) for x in (0, 1)]
        want.append({(2 * i + x, n) for i, k in enumerate(d) for x in (0, 1) if (n := total[x][k[x]] - (0 if h else own[x][k[x]])) > 0})
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(zip(held, texts))], "rid long, held boolean, text string")
    lists, odds, phrases, begun = op5.train_phrases(df.repartition(3))
    assert {r.rid: {tuple(x) for x in r.found} for r in lists.collect()} == {i: w for i, w in enumerate(want) if w}
    assert (phrases, begun) == (sum(len(c) for c, h in zip(cuts, held) if not h), held.count(False))
    hows = [[2 if 2 * i + 1 in dict(w) else 1 if 2 * i in dict(w) else 0 for i in range(len(c))] for c, w in zip(cuts, want)]
    seen = Counter(p for w, h in zip(hows, held) if not h for p in zip([3, *w], w))
    plain = np.array([[seen[g, o] + 0.5 for o in range(3)] for g in range(4)])
    assert np.allclose(odds, plain / plain.sum(axis=1, keepdims=True))
    for text, h, c, w, how in zip(texts, held, cuts, want, hows):
        data = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends, first = op5.words(data, np.array([0, len(data)]))
        found = op5.pa.array([[{"place": a, "times": b} for a, b in sorted(w)]], op5.pa.list_(op5.pa.struct([("place", op5.pa.int32()), ("times", op5.pa.int64())])))
        got, new = op5.phrase_scores(found, op5.Phrases(op5.word_hashes(data, starts, ends), first), np.array([h]), odds, phrases, begun)
        score, times, steps = 0.0, dict(w), list(zip([3, *how], how))
        for i, (g, o) in enumerate(steps):
            score += math.log10((4 * odds[g, o] + steps[:i].count((g, o))) / (4 + sum(x == g for x, _ in steps[:i])))
            if o == 2:
                score += math.log10(times[2 * i + 1] / (times[2 * i - 2] if i else begun - (not h)))
            elif o == 1:
                score += math.log10(times[2 * i] / phrases)
        assert math.isclose(got[0], score, rel_tol=1e-9) and list(new) == [o == 0 for o in how]


def test_lm_joined_score(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    known = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text", held.alias("held"))
    table = known.collect()
    number = lambda w: int(op5.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])).view(np.int64)[0]) if w else 0
    texts = [re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "") for r in table]
    toks = [[*WORD.findall(t), ""] for t in texts]
    keys, logs = op5.train_classes(known)
    place = {int(k): i for i, k in enumerate(keys)}
    inside = [Counter() for _ in range(op5.CLASSES)]
    for r, t in zip(table, toks):
        if not r.held:
            fit = sum((logs[place[number(w)]] for w in t[:-1] if number(w) in place), np.zeros(op5.CLASSES))
            inside[int(np.argmax(fit))].update(t)
    c = sum(inside, Counter())
    n, kinds, sizes = sum(c.values()), len(c), [sum(k.values()) for k in inside]
    mixer = op5.train_mixer(spark.createDataFrame([(number(w), w.encode(), k) for w, k in c.items()], "h long, word binary, c long"), kinds)
    distinct = sorted({w for t in toks for w in t})
    spelled = dict(zip(distinct, mixer.spell(*op5._with_ends(op5.pa.array([w.encode() for w in distinct], op5.pa.binary())))))
    chance = {w: max(c[w] - op5.DISCOUNT, 0) / n + op5.DISCOUNT * kinds / n * 10 ** spelled[w] for w in distinct}
    lists, odds, phrases, begun = op5.train_phrases(known.select("rid", "held", "text"))
    met = {r.rid: sorted(tuple(x) for x in r.found) for r in lists.collect()}
    kind = op5.pa.list_(op5.pa.struct([("place", op5.pa.int32()), ("times", op5.pa.int64())]))
    want = []
    for r, text, t in zip(table, texts, toks):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, first = op5.words(data, np.array([0, len(data)]))
        p = op5.Phrases(op5.word_hashes(data, starts, ends), first)
        found = op5.pa.array([[{"place": a, "times": b} for a, b in met[r.rid]] if r.rid in met else None], kind)
        got, new = op5.phrase_scores(found, p, np.array([r.held]), odds, phrases, begun)
        use = [*new[p.word], new[p.last[0]]]
        each = []
        for k, size in zip(inside, sizes):
            for s in op5.STRENGTHS:
                steps = [(t[:i].count(w) + s * (k[w] + op5.DRAW * chance[w]) / (size + op5.DRAW)) / (i + s) for i, w in enumerate(t) if use[i]]
                each.append(got[0] + sum(map(math.log10, steps)))
        most = max(each)
        want.append((r.doc_id is None, r.doc_id or 0, most + math.log10(sum(10 ** (x - most) for x in each) / len(each))))
    assert any(r.held for r in table) and any(w not in c for t in toks for w in t)
    for frequent in (op5.FREQUENT, 10):
        monkeypatch.setattr(op5, "FREQUENT", frequent)
        out = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in op5.score(docs).collect())
        assert [x[:2] for x in out] == [x[:2] for x in sorted(want)]
        assert np.allclose([x[2] for x in out], [x[2] for x in sorted(want)], rtol=1e-5, atol=1e-4)


def test_lm_compresses_held_out_text(spark):
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no corpus")
    held = [r for r in op5.score(spark.read.parquet(str(path))).collect() if r.held_out]
    assert held and sum(r.bits_per_byte for r in held) < 3 * len(held)


def test_lm_mixes_from_all_words(spark, monkeypatch):
    monkeypatch.setattr(op5, "SHARD", 2000)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(12_000)})
    table = spark.createDataFrame([(i, w.encode(), 1) for i, w in enumerate(words)], "h long, word binary, c long")
    mixers = [op5.train_mixer(table.repartition(n), len(words)) for n in (1, 5)]
    assert all(m.size.sum() == 8 * sum(len(w) + 1 for w in words) for m in mixers)
    assert np.allclose(mixers[0].weights, mixers[1].weights) and np.allclose(mixers[0].refined, mixers[1].refined)


def test_lm_classes_from_all_documents(spark):
    rng = random.Random(5)
    texts = [" ".join([f"own{i % 900}"] + [f"t{i % 7}x{rng.randrange(8)}" for _ in range(25)]) for i in range(2400)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").selectExpr("rid", "text", "false as held")
    keys, table = op5.train_classes(df.repartition(3), steps=3)
    names = sorted({w for t in texts for w in t.split()})
    place = {w: i for i, w in enumerate(names)}
    x = np.zeros((len(texts), len(names)))
    for i, t in enumerate(texts):
        for w in t.split():
            x[i, place[w]] += 1
    unit = np.sqrt(x / x.sum(axis=1, keepdims=True))
    at = [0]
    while len(at) < op5.CLASSES:
        at.append(int((unit @ unit[at].T).max(axis=1).round(12).argmin()))
    share = np.eye(op5.CLASSES)[(unit @ unit[at].T).argmax(axis=1)]
    for _ in range(3):
        want = share.T @ x + 0.5
        want = np.log(want / want.sum(axis=1, keepdims=True)).T
        fit = x @ want + np.log(share.mean(axis=0) + 1e-3)
        share = np.exp(fit - fit.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    assert len(keys) == len(names) and np.allclose(np.sort(table, axis=0), np.sort(want, axis=0))


def test_toxicity(spark, docs):
    bad = [(1000 + i, f"{EN} you idiot and moron {i}", "en", "s", 1, 1, "x", "y") for i in range(40)]
    good = [(2000 + i, f"{EN} a nice day number {i}", "en", "s", 1, 1, "x", "y") for i in range(80)]
    every = spark.createDataFrame(bad + good, SCHEMA).unionByName(docs)
    labels = spark.createDataFrame([(r[0], 1, 1) for r in bad[:30]] + [(r[0], 1, 0) for r in good[:60]] + [(100, None, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in op6.toxicity(every, labels).where("toxic").collect()} == {r[0] for r in bad}
    kept = op6.without_toxic(every, labels)
    assert kept.count() == len(good) + len(rows()) and kept.columns == every.columns
    assert op6.toxicity(docs, labels.where("false")).where("toxic").count() == 0


def test_secrets(spark):
    texts = [None, "", 'é token = "abcdefgh1234" x PASSWORD:short pwd', "AKIA" + "Z9" * 8 + " and " + "0a" * 20, "secret:token:abcdefgh", "api_key=deadbeef" * 3, "Q7x9" * 2 + "Zk3Lw0Pt8Vb2Nm5Rj6Hy1Gd4", EN]
    out = {r.doc_id: r for r in op7.digest(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        found = [(m.start(), 0, m.end()) for m in re.finditer(op7.ASSIGN, t or "") if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        text = ",".join(f"{op7.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert [out[i].n_assign, out[i].n_access, out[i].n_hex] == [sum(f[1] == k for f in found) for k in range(3)]
        assert out[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(out[i].spans.split(","))
    clean = op7.without_secrets(spark.createDataFrame([(2, texts[2], 1)], "doc_id long, text string, n_chars long")).first()
    assert clean.text == 'é [secret]" x PASSWORD:short pwd' and clean.n_chars == len(clean.text)


def test_near_duplicates(spark, docs):
    data = rows() + [(3000 + i, " ".join(BASE * 3 + [f"w{i}"]) if i % 2 else " ".join(f"u{i}x{k}" for k in range(30)), None, None, 1, 1, "x", "y") for i in range(12)]
    sets = []
    for r in data:
        w = [x.lower() for x in WORD.findall(r[1] or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(data)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    want = sorted(((r[0], len(sets[i]), least.get(top(i)) if sets[i] else r[0]) for i, r in enumerate(data)), key=repr)
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in op8.near_duplicates(df).collect()), key=repr) == want
    assert op8.one_of_each(df).where("text is null").count() == 1
    assert op8.near_duplicates(df.where("false")).count() == 0


def test_one_row_of_each_group(spark):
    copies = [(i, t, f"s{k}") for i, t in [(None, EN), (None, DE), (4, DE), (5, " ".join(BASE[::-1]))] for k in range(3)]
    df = spark.createDataFrame([*copies, (None, None, "a"), (None, "", "b"), (None, "", "b")], "doc_id long, text string, source string").repartition(3)
    out = op8.one_of_each(df)
    want = [(None, EN, "s0"), (4, DE, "s0"), (5, " ".join(BASE[::-1]), "s0"), (None, None, "a"), (None, "", "b"), (None, "", "b")]
    assert out.columns == df.columns and sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_leaks(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    near = item.replace("iota", "IOTA").replace("upsilon", "omega")
    more = spark.createDataFrame([(5000, f"{EN} {item} {EN}", *[None] * 6), (5001, near, *[None] * 6), (5002, " ".join(reversed(item.split())), *[None] * 6), (5003, "say two words now", *[None] * 6)], SCHEMA)
    out = op9.leaks(docs.unionByName(more), bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(5000, 1), (5001, 1), (5003, 4)}
    assert next(r for r in out if r.doc_id == 5000).start_word == len(BASE)
    kept = op9.without_leaks(docs.unionByName(more), bench)
    assert kept.count() == len(rows()) + 1 and kept.columns == docs.columns
    assert op9.leaks(docs, bench.where("false")).count() == 0 and op9.leaks(docs.where("false"), bench).count() == 0


def test_quality(spark, docs):
    out = op10.quality(docs).collect()
    assert len(out) == len(rows()) and all(r.base_failed and not r.kept for r in out if r.n_words < 20)
    line = " ".join(f"w{i}" for i in range(12))
    r = op10.quality(spark.createDataFrame([(1, f"{line}\n{line}\n \n{line} #$")], "doc_id long, text string")).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (37, 2, 1, 36, True)
