"""All five stages of the corpus pipeline against plain Python, on the smallest tables with odd rows added."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

pytest.importorskip("siftwell.llm")
import corpus_pipeline as pipeline
import numpy as np
from siftwell.llm import op03_source_mix as op3
from siftwell.llm import op06_toxicity as op6
from siftwell.llm import op07_secret_scan as op7

HERE = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not HERE.exists():
        pytest.skip("no corpus")
    at = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    odd = spark.createDataFrame([(90_002, "some words and password = abcdEFGH1234 in a text", "en", "odd", 1), (90_000, None, None, None, None), (90_001, "", "en", "odd", 0), (None, "a null id and some words to keep", "en", None, 1), (None, None, None, None, None)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.orderBy("doc_id").limit(2)).selectExpr("*", "'x' as rid", "1 as mix")
    docs.write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{HERE}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    rows, out = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before = rows
        stage(spark, rows, str(at)).write.parquet(f"{at}/{name}")
        rows = spark.read.parquet(f"{at}/{name}")
        out.append((before, rows))
    return str(at), out


def listed(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_same_columns_and_run(spark, stages):
    at, done = stages
    assert all(after.columns == before.columns for before, after in done[:-1]) and done[-1][1].columns == [*done[-1][0].columns, "mix_copies"]
    assert listed(pipeline.run(spark, at), "doc_id", "text", "mix_copies") == listed(done[-1][1], "doc_id", "text", "mix_copies")


def test_toxicity(spark, stages):
    at, ((before, after), *_) = stages
    model = op6.train(before, spark.read.parquet(f"{at}/labels.parquet"))
    feature, want = model.feature(), Counter()
    for i, text in before.select("doc_id", "text").collect():
        data = np.frombuffer((text or "").encode(), np.uint8)
        if model.score(data, np.array([0, len(data)]), feature)[0, -1] < op6.LEAST:
            want[i, text] += 1
    assert listed(after, "doc_id", "text") == want and after.count() < before.count()


def test_near_duplicates(stages):
    before, after = stages[1][1]
    rows = sorted({(r.doc_id, r.text) for r in before.collect()}, key=repr)
    sets = []
    for _, text in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if sets[i]:
            groups[top(i)].append(r)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())
    empty = Counter((r.doc_id, r.text) for r in before.collect() if not WORD.findall(r.text or ""))
    assert listed(after, "doc_id", "text") == want + empty


def test_leaks(spark, stages):
    at, done = stages
    before, after = done[2]
    items = [(r.item_id, WORD.findall((r.text or "").lower())) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    shingles = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [(i, w, shingles(w, min(5, len(w)))) for i, w in items if w]
    rare = Counter(g for _, w, s in items for g in s)
    want = Counter()
    for doc, text in before.select("doc_id", "text").collect():
        words, leak = WORD.findall((text or "").lower()), False
        have = {n: shingles(words, n) for n in range(1, 6)}
        for _, w, own in items:
            n = min(5, len(w))
            if leak or not own & have[n]:
                continue
            total = sum(1 / rare[g] for g in own)
            for s in range(max(1, len(words) - len(w) + 1)):
                window = shingles(words[s : s + len(w)], min(n, len(words[s : s + len(w)])))
                both = sum(1 / rare[g] for g in own & window)
                leak = leak or both / (total + len(window - own)) >= 0.75
        want[doc, text] += not leak
    assert listed(after, "doc_id", "text") == +want


def test_secrets(stages):
    before, after = stages[1][3]
    assert listed(before, "doc_id") == listed(after, "doc_id")
    texts = {r.doc_id: r.text for r in before.collect()}
    masked = 0
    for i, text, n in after.select("doc_id", "text", "n_chars").collect():
        for pattern, least in ((op7.ASSIGN, 8), ("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)):
            assert not any(len(m[2] if least == 8 else m[0]) >= least for m in re.finditer(pattern, text or ""))
        if i is not None and text != texts[i]:
            masked += 1
            assert n == len(text) and all(part in texts[i] for part in text.split("[secret]"))
    assert masked


def test_mix(stages):
    at, done = stages
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/secrets/*.parquet'")
    taken = {i: taken // size for i, size, taken in sql.sql(f"SELECT doc_id, size, taken FROM ({op3.ORACLE}) WHERE size > 0").fetchall() if i is not None}
    after = done[4][1]
    assert {r.doc_id: r.mix_copies for r in after.collect() if r.doc_id is not None} == {i: c for i, c in taken.items() if c}
