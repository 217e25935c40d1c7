"""Golden cases of the selection operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as t
from siftwell.operators import evaluate, filters, packing, scorers, select
from siftwell.sources import records
from siftwell.sources.registry import Registry

SCORES = "pos long, score double, cost long"


def test_budget():
    assert select.resolve_budget(0.25, 800) == 200
    assert [select.resolve_budget(0.5, n) for n in (3, 5, 7)] == [2, 2, 4]
    for bad in (1.5, -1):
        with pytest.raises(ValueError):
            select.resolve_budget(bad, 10)
    assert select.parse_budget("500") == 500 and select.parse_budget("0.5") == 0.5


def test_greedy_skips_what_does_not_fit(spark, monkeypatch):
    df = spark.createDataFrame(list(zip(range(5), [9.0, 8.0, 7.0, 6.0, 5.0], [100, 400, 100, 100, 100])), SCORES)
    for small in (select.SMALL, 0):
        monkeypatch.setattr(select, "SMALL", small)
        assert sorted(r.pos for r in select.top_k_cost(df, 400).collect()) == [0, 2, 3, 4]
        assert sorted(r.pos for r in select.top_k_cost(df, 500).collect()) == [0, 1]


def test_quotas():
    assert select.allocate_quotas({"a": 9, "b": 3}, 4) == {"a": 3, "b": 1}
    assert select.allocate_quotas({"a": 98, "b": 1, "c": 1}, 10, 1) == {"a": 8, "b": 1, "c": 1}
    assert select.allocate_quotas({"a": 9, "b": 3}, 0, 2) == {"a": 0, "b": 0}
    with pytest.raises(ValueError, match="needs 15 records"):
        select.allocate_quotas({"a": 9, "b": 9, "c": 9}, 4, 5)


def test_ties_keep_the_earlier_record(spark):
    df = spark.createDataFrame([(2, 1.0, 1), (1, 1.0, 1), (3, 0.5, 1)], SCORES)
    assert [r.pos for r in select.top_k(df, 1).collect()] == [1]


def test_packing(spark):
    docs = spark.createDataFrame([("a", 0, "abcdefghij")], "uid string, pos long, text string")
    chars = F.split("text", "")
    assert [len(r.tokens) for r in packing.pack(docs, chars, 8).collect()] == [8]
    assert [len(r.tokens) for r in packing.pack(docs, chars, 8, True).orderBy("block").collect()] == [8, 3]


def test_exclusion_dedup_and_length_order(spark):
    docs = spark.createDataFrame([(1, 1, "short"), (2, 1, "x" * 300), (3, 2, "y" * 300), (4, None, "z" * 300), (5, None, "z" * 300)], "pos long, key long, text string")
    ids = spark.createDataFrame([(2,)], "key long")
    out = filters.corpus_filter(docs, ids, "key", "key")
    assert sorted(r.pos for r in out.collect()) == [4, 5]


def test_slices():
    assert filters.slices_overlap("train[0:10]", "train[9:]") and not filters.slices_overlap("train[:5]", "train[5:]")


def test_prompt_and_text(spark):
    df = spark.range(1).select(F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes")).alias("o"))
    row = df.select(t.render_prompt(F.lit("q"), F.col("o")).alias("p"), t.normalize_text(F.lit("A-b  C")).alias("n"), t.letter_key(F.lit(1)).alias("k"), t.letter_key(F.lit(-1)).alias("m")).first()
    assert row.p == "Question: q\nA. yes\nB. no\nAnswer:" and row.n == "a b c" and row.k == "B" and row.m is None
    assert len(spark.range(1).select(t.ngram_buckets(t.normal_words(F.lit("one two three")), 2, 100).alias("g")).first().g) == 5


def test_kcenter():
    square = np.array([[0, 0], [0, 1], [1, 0], [1, 1], [0.5, 0.5]], float)
    assert scorers.kcenter_order(square) == [4, 0, 1, 2, 3]
    assert scorers.kcenter_order(square[:1]) == [0] and scorers.kcenter_order(square[:0]) == []


def test_normalisers(spark):
    raw = spark.createDataFrame([("x", "q?", "a", "b", None, "d", 1, "single", " ", "S", None, 0), ("y", "r?", "a", "b", "c", "d", -1, "single", "e", None, None, 1)], "id string, question string, opa string, opb string, opc string, opd string, cop int, choice_type string, exp string, subject_name string, topic_name string, pos long")
    a, b = records.normalize_flat_choice(raw).orderBy("pos").collect()
    assert a.answer_key == "B" and a.answer_text == "b" and a.options["C"] == "" and a.rationale is None and a.labels["subject"] == "S" and "topic" not in a.labels
    assert b.answer_key is None and b.uid == "medmcqa/train/000001"
    assert records.invalid(records.normalize_flat_choice(raw)).count() == 0


def test_ci_and_registry():
    assert evaluate.accuracy_ci(0, 0) is None
    low, high = evaluate.accuracy_ci(50, 100)
    assert low < 0.5 < high
    r = Registry("thing")
    r.register("a")(1)
    with pytest.raises(ValueError):
        r.register("a")(2)
    with pytest.raises(KeyError, match="unknown thing"):
        r.get("b")


def test_cache_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("u1", 0), ("u2", 1)], "uid string, pos long")
    key = records.cache_key("docs", "default", limit=2)
    records.write_cache(df, str(tmp_path), "docs", "train", key)
    assert records.cache_is_valid(spark, str(tmp_path), "docs", "train", key)
    assert not records.cache_is_valid(spark, str(tmp_path), "docs", "train", "other")
    assert records.read_cache(spark, str(tmp_path), "docs", "train", 0).count() == 0
    records.write_selection(df.withColumn("rank", -F.col("pos")), f"{tmp_path}/sel", scorer="x")
    assert [r.uid for r in records.read_selection(spark, f"{tmp_path}/sel").orderBy("rank").collect()] == ["u2", "u1"]


def test_entry_without_llm():
    import __spark_entry__ as e

    assert len(e.queries()) > 55 and set(e.oracle_sql()) <= set(e.queries())


COSTED = "pos long, score double, cost long, g string"


def costed(spark):
    return spark.createDataFrame(list(zip(range(5), [5.0, 4.0, 3.0, 2.0, 1.0], [10, 10, 70, 10, 20], ["a", "a", "b", "b", "c"])), COSTED)


@pytest.mark.parametrize("small", [select.SMALL, 0])
def test_floor_of_records_under_a_token_budget(spark, monkeypatch, small):
    monkeypatch.setattr(select, "SMALL", small)
    for budget in (30, 60):
        with pytest.raises(ValueError, match="costs 100"):
            select.stratified_cost(costed(spark), "g", budget, 1)
    assert [r.pos for r in select.stratified_cost(costed(spark), "g", 110, 1).collect()] == [0, 2, 4]
    assert [r.pos for r in select.stratified_cost(costed(spark), "g", 60).collect()] == [0, 3]
    assert select.stratified_cost(costed(spark), "g", 0, 1).count() == 0


def plain_stratified_cost(rows, total, floor):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    pool = sum(r[2] for r in rows)
    spent, out = 0, []
    for g in groups.values():
        g.sort(key=lambda r: (-r[1], r[0]))
        out += g[:floor]
        spent += sum(r[2] for r in g[:floor])
    for g in groups.values():
        used, share = sum(r[2] for r in g[:floor]), sum(r[2] for r in g) * total / pool
        for r in g[floor:]:
            if used + r[2] <= share and spent + r[2] <= total:
                out.append(r)
                used, spent = used + r[2], spent + r[2]
    return sorted(r[0] for r in out)


@pytest.mark.parametrize("floor", [0, 2, 9])
def test_groups_under_a_token_budget_in_rounds(spark, monkeypatch, floor):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(40)), int(rng.integers(1, 60)), "abcd"[min(3, int(rng.integers(9)))]) for i in range(400)]
    df = spark.createDataFrame(rows, COSTED).repartition(3)
    want = plain_stratified_cost(list(rows), 3000, floor)
    monkeypatch.setattr(select, "SLICE", 37)
    for small in (select.SMALL, 0):
        monkeypatch.setattr(select, "SMALL", small)
        assert [r.pos for r in select.stratified_cost(df, "g", 3000, floor).collect()] == want


def test_quotas_one_at_a_time():
    rng = np.random.default_rng(3)
    for _ in range(300):
        sizes = {g: int(n) for g, n in zip("abcdef", rng.integers(1, 60, size=rng.integers(1, 7)))}
        floor = int(rng.integers(0, 6))
        total = int(rng.integers(floor * len(sizes), sum(sizes.values()) + 20))
        n, want = sum(sizes.values()), min(total, sum(sizes.values()))
        if not want or floor * len(sizes) > want:
            continue
        got = select.allocate_quotas(sizes, total, floor)
        quota = {g: min(s, max(floor, s * want // n)) for g, s in sizes.items()}
        turn = 0
        while (gap := want - sum(quota.values())) != 0:
            order = sorted(sizes, key=lambda g: (-sizes[g] if gap > 0 else sizes[g], g))
            g = order[turn % len(order)]
            turn += 1
            quota[g] += (quota[g] < sizes[g]) if gap > 0 else -(quota[g] > min(floor, sizes[g]))
        assert got == quota and sum(got.values()) == want


def test_records_without_a_group(spark):
    df = spark.createDataFrame([(0, 4.0, 1, "a"), (1, 3.0, 1, None), (2, 2.0, 1, None), (3, 1.0, 1, "b")], COSTED)
    assert [r.pos for r in select.stratified(df, "g", 3).collect()] == [0, 1, 2]


def test_ranks_by_range(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(v), 1) for i, v in enumerate(rng.integers(0, 50, 3000))], SCORES).repartition(7)
    out = select.ranked(df, F.desc("score"), F.asc("pos")).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 3001)) and out == sorted(out, key=lambda r: (-r.score, r.pos))


def test_white_space_at_the_ends(spark):
    for text in ("\n" * 150 + "x" * 100, " \t\x1c x y\x85 ", "", " ", "a" + " " * 5000 + "b"):
        df = spark.createDataFrame([(text,)], "text string")
        assert df.select(t.strip(F.col("text"))).first()[0] == text.strip()
        assert filters.min_chars(df, 200).count() == (len(text.strip()) >= 200)


def test_shards_in_file_and_line_order(spark, tmp_path):
    (tmp_path / "chunk").mkdir()
    names, want = [], []
    for k, n in enumerate((3, 500, 40)):
        names.append(f"chunk/pubmed23n{k + 1:04d}.jsonl")
        ids = [f"{k}-{i}" for i in range(n)]
        (tmp_path / names[-1]).write_text("".join(f'{{"id": "{i}", "title": " t ", "content": "{"x" * 50}", "PMID": 1}}\n' for i in ids))
        want += ids
    rows = records.read_shards(spark, str(tmp_path), names).orderBy("pos").collect()
    assert [r.id for r in rows] == want and [r.pos for r in rows] == list(range(len(want)))
    with pytest.raises(FileNotFoundError):
        records.read_shards(spark, str(tmp_path), ["chunk/none.jsonl"])


def test_cache_of_another_kind_is_not_valid(spark, tmp_path):
    df = spark.createDataFrame([("u1", 0)], "uid string, pos long")
    records.write_cache(df, str(tmp_path), "s", "train", "k")
    valid = lambda key="k", kind=None: records.cache_is_valid(spark, str(tmp_path), "s", "train", key, kind)
    assert valid() and valid(kind="doc") and not valid(kind="qa") and not valid("other")
    df.withColumn("more", F.lit(1)).write.mode("overwrite").parquet(f"{tmp_path}/s/train.parquet")
    assert not valid()
    assert records.clear_cache(spark, str(tmp_path), "s") == 1 and not valid()


def test_three_difficulties_by_k_center(spark):
    points = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [9.0, 9.0], [5.0, 0.0], [0.2, 0.1], [3.0, 4.0], [7.0, 1.0]]
    rows = [(i, "a question of some length", {"A": "x", "B": "y"}, float(i), float(i), float(i), p) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "pos long, question string, options map<string,string>, d1 double, d2 double, d3 double, embedding array<double>")
    got = {r.pos: r.score for r in scorers.ThreeDifficulties(vectors="embedding").transform(df).collect()}
    inside = [i for i in range(8) if 25 <= 100 * i / 7 <= 75]
    order = scorers.kcenter_order(np.array([points[i] for i in inside]))
    assert {i: s for i, s in got.items() if s > -1e9} == {inside[p]: float(len(inside) - k) for k, p in enumerate(order)}
    with pytest.raises(ValueError, match="survivors"):
        scorers.ThreeDifficulties(vectors="embedding", most=2).transform(df)
    bare = df.withColumn("embedding", F.when(F.col("pos") != 3, F.col("embedding")))
    assert {r.pos: r.score for r in scorers.ThreeDifficulties(vectors="embedding").transform(bare).collect()}[3] < 0


def test_caches_and_ids(spark, tmp_path):
    from siftwell.sources import caches

    pool = spark.createDataFrame([(f"u{i}", i) for i in range(6)], "uid string, pos long")
    cache = caches.KeyedCache(spark, f"{tmp_path}/m", kind="grad", epoch=1)
    seen = []

    def compute(df):
        seen.append(sorted(r.uid for r in df.collect()))
        return df.select("uid", (F.col("pos") * 2).alias("metric"))

    cache.complete(pool.where("pos < 2"), compute)
    assert sorted((r.pos, r.metric) for r in cache.complete(pool, compute).collect()) == [(i, 2 * i) for i in range(6)]
    assert seen == [["u0", "u1"], ["u2", "u3", "u4", "u5"]]
    tables = {n: spark.createDataFrame([(i,) for i in ids], "pubid long") for n, ids in (("a", [1, 2, None]), ("b", [2, 3]))}
    assert sorted(r.pubid for r in caches.cached_ids(spark, str(tmp_path), tables, "pubid", ["b", "a"]).collect()) == [1, 2, 3]
    tables["a"] = tables["b"]
    assert caches.cached_ids(spark, str(tmp_path), tables, "pubid", ["a", "b"]).count() == 3
    assert caches.cached_ids(spark, str(tmp_path), tables, "pubid", ["a", "b"], refresh=True).count() == 2
    for bad in ([], ["c"]):
        with pytest.raises(ValueError):
            caches.union_of_ids(tables, "pubid", bad)
    caches.require_space(spark, str(tmp_path), 1)
    with pytest.raises(OSError, match="are free"):
        caches.require_space(spark, str(tmp_path), 1 << 60)
    (tmp_path / "f.bin").write_bytes(b"12345")
    assert tuple(caches.stored_bytes(spark, [f"{tmp_path}/f.bin"]).first()) == (1, 5)


def test_stages_refuse_what_they_cannot_use(spark):
    from siftwell import stages

    qa = spark.createDataFrame([("u", "q" * 12, {"A": "x", "B": "y"}, None, [], None, 0)], "uid string, question string, options map<string,string>, answer_key string, contexts array<string>, rationale string, pos long")
    docs = spark.createDataFrame([("d", "", "some text", 0)], "uid string, title string, text string, pos long")
    for stage, df, why in (("cpt", qa, "reads doc"), ("sft", docs, "reads qa"), ("sft", qa, "no answers"), ("cpt", docs, "no block")):
        with pytest.raises(ValueError, match=why):
            stages.STAGES.get(stage)(df)
    with pytest.raises(ValueError, match="no texts"):
        stages.target_texts(qa, completion=True)
    chosen = spark.createDataFrame([("d", "pages")], "uid string, source string")
    with pytest.raises(ValueError, match="not 'documents'"):
        stages.cpt_prepare(docs, chosen, 2, source="documents")
    assert stages.cpt_prepare(docs, chosen, 2, source="pages").first().labels == ["some", "text"]
    with pytest.raises(NotImplementedError):
        stages.STAGES.get("align")()


def test_command_line(spark, tmp_path):
    from pathlib import Path

    from siftwell import cli

    assert [cli.coerce(x) for x in ("True", "null", "3", "2.5", "x")] == [True, None, 3, 2.5, "x"] and cli.keyed(["a=1"]) == {"a": 1}
    with pytest.raises(SystemExit):
        cli.keyed(["a"])
    here = Path("/root/testdata/sf0.001")
    if not here.exists():
        pytest.skip("no tables")
    run = lambda *a: cli.run(spark, cli.parser().parse_args(a))
    assert "documents" in run("info")["loaders"] and {"name", "about"} <= set(run("data", "list")[0])
    assert run("data", "stats", "--tables", str(here))["n"] == 200
    out = run("select", "--tables", str(here), "--scorer", "length", "--set", "unit=words", "--budget", "0.1", "--output", f"{tmp_path}/m")
    assert out["n"] == 20 and records.read_selection(spark, f"{tmp_path}/m").count() == 20
    assert run("select", "--tables", str(here), "--budget", "4000", "--tokens", "--group", "lang")["tokens"] <= 4000
    assert run("data", "prepare", "--tables", str(here), "--source", "parts", "--output", f"{tmp_path}/c", "--limit", "5")["n"] == 5


def test_experiments(spark, tmp_path):
    from pathlib import Path

    from siftwell import cli, experiment

    pytest.importorskip("yaml")

    def load(text: str):
        (tmp_path / "run.yaml").write_text(text)
        return experiment.load(tmp_path / "run.yaml")

    (tmp_path / "small.yaml").write_text("name_or_path: none\nlora_r: 4\n")
    good = "name: one\nstage: cpt\ndata: {source: documents}\nmodel: small.yaml\n"
    plan = load(good + "train: {block_size: 64}\n")
    assert (plan.model.lora_r, plan.model.lora_alpha, plan.train.block_size, plan.train.seed, plan.data.split, plan.notes) == (4, 32, 64, 42, "train", "")
    assert load(good + "train:\n").train.learning_rate == 2e-5 and experiment.as_dict(plan)["data"]["source"] == "documents"
    for text, why in ((good + "traim: {}\n", "traim"), (good + "train: {learning_rare: 1}\n", "learning_rare"), ("stage: cpt\n", "lacks"), ("- a\n", "no mapping"), (good + "train: 3\n", "neither")):
        with pytest.raises(ValueError, match=why):
            load(text)
    for text in (good.replace("small", "none"), None):
        with pytest.raises(FileNotFoundError):
            load(text) if text else experiment.load(tmp_path / "no.yaml")
    here = Path("/root/testdata/sf0.001")
    if not here.exists():
        pytest.skip("no tables")
    run = lambda *a: cli.run(spark, cli.parser().parse_args(a))
    run("select", "--tables", str(here), "--scorer", "length", "--budget", "0.1", "--output", f"{tmp_path}/m")
    (tmp_path / "run.yaml").write_text(good.replace("documents}", f"documents, selection: {tmp_path}/m}}") + "train: {block_size: 64}\n")
    out = run("stage", "--config", f"{tmp_path}/run.yaml", "--tables", str(here), "--output", f"{tmp_path}/blocks")
    assert out["n"] > 0 and {len(r.labels) for r in spark.read.parquet(f"{tmp_path}/blocks").collect()} == {64}
    with pytest.raises(ValueError, match="not 'pages'"):
        experiment.prepare(spark, load(good.replace("documents}", f"pages, selection: {tmp_path}/m}}")), str(here))
