"""The secret scan against plain Python: training counts, spans of model and base, recall, false alarms, many matches."""

import base64
import hashlib
import random
import re
import string
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("siftwell.llm")
from siftwell.llm import op07_secret_scan as op7
from siftwell.llm.native import running

SCHEMA = "doc_id long, text string, base string, findings long"
PATTERNS = ((op7.ASSIGN, 8), ("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32))
ALNUM = string.ascii_letters + string.digits


def base_of(text):
    out = []
    for kind, (pattern, least) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == 0 else m[0]) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def code(c):
    return op7.SYMBOLS.find(c) % op7._SIZE if c in op7.SYMBOLS else op7._SIZE - 1


def model_of(texts):
    random_, words = set(), set()
    for t in texts:
        random_ |= {m[2] for m in re.finditer(op7.ASSIGN, t) if len(m[2]) >= 8} | set(re.findall(op7.ACCESS, t)) | set(re.findall(op7.HEX, t))
        words |= set(re.findall(op7.LEARNED, t))
    words -= random_
    samples = [(1, w) for w in random_] + [(1, base64.b64encode(hashlib.md5(w.encode()).digest()).decode().rstrip("=")) for w in words]
    for w in words:
        a, b = w[: len(w) // 2], w[len(w) // 2 :]
        samples += [(0, x) for x in (w, f"{a}_{b}", a.capitalize() + b.capitalize(), f"{a}_{b}".upper(), w + str(len(w) % 10))]
    counts = [[0] * op7._SIZE**2 for _ in range(2)]
    for label, w in samples:
        for a, b in zip(w, w[1:]):
            counts[label][code(a) * op7._SIZE + code(b)] += 1
    return op7.ratios(counts)


def spans_of(text, model):
    base = base_of(text)
    rest = list(text)
    for a, _, b in base:
        rest[a:b] = " " * (b - a)
    more = []
    for m in re.finditer(op7.CANDIDATE, "".join(rest)):
        ratio = sum(model[code(a) * op7._SIZE + code(b)] for a, b in zip(m[0], m[0][1:]))
        if ratio >= op7.LEAST_SUM and ratio >= op7.LEAST_MEAN * (len(m[0]) - 1):
            more.append((m.start(), 3, m.end()))
    return ",".join(f"{op7.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more))


WORDS = """configuration application development information management performance international university government department
experience community technology production environment association opportunity relationship understanding particularly responsibility
organization administration communication characteristics approximately representative infrastructure investigation participation
distribution establishment recommendation professional independence collaboration implementation authentication transaction""".split()


def corpus():
    rng = random.Random(11)
    token = lambda n, of=ALNUM: "".join(rng.choice(of) for _ in range(n))
    rows, planted, names = [], [], []
    for i in range(200):
        words = [rng.choice(WORDS) for _ in range(40)]
        if i % 4 == 0:
            planted.append((i, token(12 + i % 29)))
            words[7] = planted[-1][1]
        if i % 4 == 1:
            a, b = rng.sample(WORDS, 2)
            names.append((i, [f"{a}_{b}", a.capitalize() + b.capitalize(), f"{a}-{b}", f"{a.upper()}_{b.upper()}"][i // 4 % 4]))
            words[7] = names[-1][1]
        if i % 10 == 2:
            words[9] = f"password = {token(14)}"
        rows.append((i, " ".join(words), "x", 1))
    rows += [(300, None, "x", 1), (301, "", "x", 1), (302, "ü" * 50 + " é token: ab_cd-ef9 " + "€" * 9 + "AKIA0000TOKEN=abcdefgh12", "x", 1), (None, rows[0][1], None, None), rows[2], rows[2]]
    return rows, planted, names


def test_spans_and_model(spark):
    rows, planted, names = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = model_of([r[1] or "" for r in rows])
    assert max(abs(a - b) for a, b in zip(op7.train(docs), model)) < 1e-9
    want = Counter()
    for i, text, *_ in rows:
        base = base_of(text or "")
        named = ",".join(f"{op7.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want[(i, *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(named.encode()).hexdigest(), spans_of(text or "", model))] += 1
    got = op7.digest(docs).collect()
    assert Counter(tuple(r) for r in got) == want
    found = {r.doc_id: r.spans for r in got if r.doc_id is not None}
    recall = lambda low, high: sum("random" in found[i] for i, t in planted if low <= len(t) < high) / max(1, sum(low <= len(t) < high for _, t in planted))
    alarms = sum("random" in found[i] for i, _ in names) / len(names)
    print(f"recall 12-19: {recall(12, 20):.2f}, 20-40: {recall(20, 41):.2f}, false alarms on identifiers: {alarms:.2f}")
    assert recall(20, 41) >= 0.95 and recall(12, 20) >= 0.8 and alarms <= 0.05
    assert op7.digest(docs.where("false")).count() == 0


def test_masked(spark):
    rows, *_ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = model_of([r[1] or "" for r in rows])
    want = Counter()
    for i, text, *rest in rows:
        if text is not None:
            out, at = [], 0
            for s in filter(None, spans_of(text, model).split(",")):
                a, b = map(int, s.split(":")[1:])
                if b > at:
                    out += [text[at:a], "[secret]"]
                    at = b
            text = "".join(out) + text[at:]
        want[(i, text, *rest)] += 1
    assert Counter(tuple(r) for r in op7.without_secrets(docs).collect()) == want
    assert op7.without_secrets(docs.where("false")).count() == 0


def test_running(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(-5, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 512, 700, 3000)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    out = df.select("x", running(F.col("x"), F.lit(0), lambda a, b: a + b).alias("s"), running(F.col("x"), F.lit(0), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in out:
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x) + 1)] and r.m == [max([0, *r.x[:i]]) for i in range(len(r.x) + 1)]


def test_many_matches_in_one_text(spark):
    n = 100_000
    text = "".join(f"token=abcdefg{i:07d} é " for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    r = op7.secret_scan(docs, [0.0] * op7._SIZE**2).select(F.size("findings").alias("n"), F.element_at("findings", -1)["end"].alias("end")).first()
    assert (r.n, r.end) == (n, len(text) - 3)
    assert op7.without_secrets(docs).first().text == "[secret] é " * n
    assert time.time() - start < 120
