"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stages
from ..functions import text as t
from ..operators import evaluate, filters, packing, scorers, select
from ..session import shared_dir, ship
from ..sources import caches, records
from ..streaming import select as streaming

SELECTED, SEED = 100, 42


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return records.corpus(ship(spark), d)


def _lengths(spark: SparkSession, d: str, unit: str = "chars") -> DataFrame:
    return scorers.Length(unit).transform(_docs(spark, d))


def _costed(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).select("uid", "pos", "lang", "score", t.token_cost(F.col("text")).alias("cost"))


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    return records.table(spark, d, "labels").where("toxic = 1").select("doc_id")


def _target(spark: SparkSession, d: str) -> DataFrame:
    return records.table(spark, d, "benchmark").select("text")


def _dsir(spark: SparkSession, d: str, noise: bool) -> DataFrame:
    pool = _docs(spark, d)
    return scorers.Dsir(_target(spark, d), gumbel_noise=noise).fit(pool).transform(pool)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = records.table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("uid"), F.col("vec_id").alias("pos"), "embedding", "label")


def _losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses of the documents under a model of themselves."""
    docs = _docs(spark, d)
    return scorers.NgramLM(docs).nll(docs)


def _perplexity(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        pool = _docs(spark, d)
        out = scorers.Perplexity(scorers.NgramLM(pool), mode).fit(pool).transform(pool)
        return out.select("uid", F.round("score", 9).alias("score"))

    return run


def _difficulties(spark: SparkSession, d: str) -> DataFrame:
    """Questions with three difficulties from keyed hashes, in place of a judge model."""
    qa = records.questions(ship(spark), d)
    for k in (1, 2, 3):
        qa = qa.withColumn(f"d{k}", t.hash_uniform(f"d{k}", SEED, F.col("uid")))
    return qa


def _options(spark: SparkSession, d: str) -> DataFrame:
    """Option scores from keyed hashes, in place of a judge model."""
    qa = records.questions(ship(spark), d)
    rows = qa.select("uid", "answer_key", F.col("labels")["subject"].alias("subject"), F.explode("options").alias("key", "option"))
    total = -10.0 * t.hash_uniform("option", SEED, F.concat("uid", "key"))
    return rows.select("uid", "answer_key", "subject", "key", total.alias("total"), F.length("option").alias("n_tok"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.predict(_options(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """An accuracy for each subject, as if each were a run, with a normal interval."""
    by = evaluate.accuracy_by_subject(_predicted(spark, d))
    half = 1.96 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    return by.select(F.col("subject").alias("name"), "accuracy", F.round(F.col("accuracy") - half, 4).alias("low"), F.round(F.col("accuracy") + half, 4).alias("high"))


def _chosen(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Selections of equal size by three scorers."""
    pool = _docs(spark, d).withColumn("cost", t.token_cost(F.col("text"))).select("uid", "pos", "text", "cost")
    named = {"random": scorers.Random(SEED), "length": scorers.Length(), "words": scorers.Length("words")}
    out = None
    for name, s in named.items():
        one = select.top_k(s.transform(pool), SELECTED).select(F.lit(name).alias("scorer"), "uid", "score", "cost")
        out = one if out is None else out.unionByName(one)
    return out, list(named)


def _comparison(spark: SparkSession, d: str) -> DataFrame:
    pool = _docs(spark, d)
    means = None
    for name, s in {"random": scorers.Random(SEED), "length": scorers.Length(), "words": scorers.Length("words")}.items():
        one = s.transform(pool).agg(F.round(F.avg("score"), 9).alias("pool_mean")).select(F.lit(name).alias("scorer"), "pool_mean")
        means = one if means is None else means.unionByName(one)
    return evaluate.scorer_comparison(_chosen(spark, d)[0], means)


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """All that length selection takes for the tokens of a random draw."""
    pool = _docs(spark, d).select("uid", "pos", "text", t.token_cost(F.col("text")).alias("cost"))
    budget = select.top_k(scorers.Random(SEED).transform(pool), SELECTED).agg(F.sum("cost")).first()[0]
    out = select.top_k_cost(scorers.Length().transform(pool), budget)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("tokens"), F.lit(budget).cast("long").alias("budget"))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    scored = _costed(spark, d)
    top = select.top_k(scored, SELECTED).select("uid", F.lit(True).alias("selected"))
    return scored.join(F.broadcast(top), "uid", "left").fillna(False, ["selected"])


def _quotas(spark: SparkSession, d: str) -> DataFrame:
    sizes = {r.lang: r["count"] for r in _docs(spark, d).groupBy("lang").count().collect()}
    return spark.createDataFrame(sorted(select.allocate_quotas(sizes, SELECTED).items()), "lang string, quota long")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    y = records.table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return _docs(spark, d).join(y, "doc_id", "left")


def _gradient_scores(make) -> object:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pool = _labelled(spark, d)
        pool = pool.select("uid", "text", "lang", "y")
        return make(pool.where("lang = 'en'")).fit(pool).transform(pool).select("uid", "score")

    return run


def _sft(spark: SparkSession, d: str) -> DataFrame:
    qa = records.questions(ship(spark), d).where("answer_key is not null")
    return qa.select("uid", t.render_prompt(F.col("question"), F.col("options"), F.col("contexts")).alias("prompt"), t.render_completion(F.col("answer_key"), F.col("rationale")).alias("completion"))


def _applied(spark: SparkSession, d: str) -> DataFrame:
    scored = _lengths(spark, d)
    return filters.apply_selection(scored, select.top_k(scored, SELECTED)).select("uid", "pos")


def _ci(spark: SparkSession, d: str) -> DataFrame:
    row = evaluate.accuracy(_predicted(spark, d)).first()
    low, high = evaluate.accuracy_ci(row.n_correct, row.n_scored)
    return spark.createDataFrame([(row.accuracy, low, high)], "accuracy double, low double, high double")


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each subject in three thirds of its questions, as if by seed."""
    p = _predicted(spark, d).withColumn("seed", F.regexp_extract("uid", r"(\d+)$", 1).cast("long") % 3)
    runs = p.groupBy(F.col("subject").alias("scorer"), "seed").agg(F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"))
    return evaluate.seed_sweep(runs)


def _stream(group: str | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        state = streaming.select_stream(streaming.read_documents(ship(spark), d), scorers.Length(), SELECTED, group)
        return streaming.stratified(state) if group else streaming.ranked(state)

    return run


def _stream_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Selection over a stream by a scorer fitted on its first 200 records."""
    scorer = scorers.Dsir(_target(spark, d), gumbel_noise=False)
    state = streaming.select_stream(streaming.read_documents(ship(spark), d), scorer, SELECTED, prefix=_docs(spark, d), fit_size=200)
    return streaming.ranked(state).select("uid", F.round("score", 9).alias("score"))


def _cpt(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the longest documents."""
    chosen = select.top_k(_lengths(spark, d), SELECTED).select("uid").withColumn("source", F.lit("documents"))
    docs = _docs(spark, d).where("text is not null")
    blocks = stages.cpt_prepare(docs, chosen, 512, source="documents")
    return blocks.select("block", F.size("input_ids").cast("long").alias("n"), F.md5(F.array_join("input_ids", " ")).alias("digest"))


def _cached(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of all records, half of which a first run left in the cache."""
    pool, root = _docs(spark, d).select("uid", "pos", "text"), f"{shared_dir(ship(spark))}/siftwell/metrics-{uuid.uuid4().hex}"
    cache = caches.KeyedCache(spark, root, kind="length")
    measure = lambda df: df.select("uid", F.length("text").alias("metric"))
    cache.complete(pool.where("pos < 100"), measure)
    return cache.complete(pool, measure).select("uid", "metric")


def _named_runs(spark: SparkSession, d: str) -> DataFrame:
    """``_runs`` with the least name as the base run."""
    runs = _runs(spark, d)
    first = runs.agg(F.min("name").alias("base"))
    return runs.crossJoin(F.broadcast(first)).withColumn("name", F.when(F.col("name") == F.col("base"), F.lit("__base__")).otherwise(F.col("name"))).drop("base")


def _judges(spark: SparkSession, d: str) -> list[str]:
    """The two greatest names."""
    return [r.name for r in _runs(spark, d).select("name").orderBy(F.desc("name")).limit(2).collect()]


def _stream_stats(spark: SparkSession, d: str) -> DataFrame:
    state = streaming.select_stream(streaming.read_documents(ship(spark), d), scorers.Length(), SELECTED, "lang")
    return state.stats().select("grp", "n", "total", "least", "most")


def _shards(spark: SparkSession, d: str) -> DataFrame:
    names = records.shard_names(10, 1160)
    return spark.createDataFrame([(n,) for n in names], "shard string")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    blocks = packing.pack(_docs(spark, d), t.tokens(F.col("text")), 1024)
    return blocks.select("block", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def _top(spark: SparkSession, d: str, budget: int | float) -> DataFrame:
    return select.top_k(_lengths(spark, d), budget).select("uid", "score", F.col("rank").cast("long").alias("rank"))


def queries() -> dict:
    doc, q = _docs, records.questions
    return {
        "corpus_view": lambda s, d: doc(s, d).select("uid", "source", "text", "title", "pos", F.col("meta")["lang"].alias("lang")),
        "pages_view": lambda s, d: records.pages(ship(s), d).select("uid", "title", t.full_text(F.col("title"), F.col("text")).alias("full_text")),
        "qa_view": lambda s, d: q(ship(s), d).select("uid", "question", *[F.col("options")[k].alias(f"option_{k.lower()}") for k in "ABCD"], "answer_key", "answer_text", F.col("answer_key").isNotNull().alias("is_labeled"), F.size("options").alias("n_options")),
        "dialogue_view": lambda s, d: records.dialogue(ship(s), d),
        "make_uid": lambda s, d: doc(s, d).select("pos", t.make_uid(F.lit("documents"), F.lit("train"), F.col("pos")).alias("uid")),
        "shard_prune": _shards,
        "human_bytes": lambda s, d: doc(s, d).select("uid", t.human_bytes(F.pow(F.lit(3.7), F.col("pos") % 23)).alias("size")),
        "limit_raw": lambda s, d: filters.min_chars(doc(s, d).orderBy("pos").limit(SELECTED)).select("uid"),
        "limit_kept": lambda s, d: filters.min_chars(doc(s, d)).orderBy("pos").limit(SELECTED).select("uid"),
        "split_slice": lambda s, d: doc(s, d).where((F.col("pos") >= filters.split_slice("train[50:120]")[1]) & (F.col("pos") < filters.split_slice("train[50:120]")[2])).select("uid"),
        "filter_min_chars_padded": lambda s, d: filters.min_chars(doc(s, d).withColumn("text", F.expr(_PADDED))).select("uid"),
        "filter_min_chars": lambda s, d: filters.min_chars(doc(s, d)).select("uid"),
        "dedup_first": lambda s, d: filters.dedup_first(doc(s, d).withColumn("key", F.md5("text")), "key").select("uid", "pos"),
        "contamination_anti_join": lambda s, d: filters.exclude(doc(s, d), _excluded(s, d), "doc_id").select("uid"),
        "corpus_pipeline": lambda s, d: filters.corpus_filter(doc(s, d).withColumn("key", F.md5("text")), _excluded(s, d), "doc_id", "key").select("uid", "pos"),
        "corpus_stats": lambda s, d: evaluate.corpus_stats(doc(s, d), t.full_text(F.col("title"), F.col("text"))),
        "qa_stats": lambda s, d: evaluate.qa_stats(q(ship(s), d)),
        "top_subjects": lambda s, d: evaluate.top_subjects(q(ship(s), d)),
        "fingerprint": lambda s, d: _excluded(s, d).agg(t.fingerprint(F.col("doc_id")).alias("fingerprint")),
        "score_random": lambda s, d: scorers.Random(SEED).transform(doc(s, d)).select("uid", "score"),
        "score_length_chars": lambda s, d: _lengths(s, d).select("uid", "score"),
        "score_length_words": lambda s, d: _lengths(s, d, "words").select("uid", "score"),
        "dsir_normalize": lambda s, d: doc(s, d).select("uid", t.normalize_text(F.col("text")).alias("norm")),
        "dsir_ngrams": lambda s, d: scorers.bucket_counts(_target(s, d), 2, 10_000),
        "dsir_bucket_model": lambda s, d: scorers.bucket_model(_target(s, d)).select("bucket", F.round("logp", 9).alias("logp")),
        "dsir_weight": lambda s, d: _dsir(s, d, False).select("uid", F.round("score", 9).alias("score")),
        "dsir_gumbel": lambda s, d: _dsir(s, d, True).select("uid", F.round("score", 6).alias("score")),
        "embed_centroid": lambda s, d: scorers.centroid(_vectors(s, d).where("label = 3")).select("i", F.round("c", 9).alias("c")),
        "embed_similarity": lambda s, d: scorers.EmbedSimilarity(_vectors(s, d).where("label = 3")).fit(_vectors(s, d)).transform(_vectors(s, d)).select("uid", F.round("score", 9).alias("score")),
        "ngram_lm_nll": lambda s, d: _losses(s, d).select("uid", F.round("nll", 6).alias("nll"), "n"),
        "perplexity_low": _perplexity("low"),
        "perplexity_mid": _perplexity("mid"),
        "perplexity_high": _perplexity("high"),
        "corpus_perplexity": lambda s, d: evaluate.perplexity_report(_losses(s, d)),
        "percentile_rank": lambda s, d: _lengths(s, d).select("uid", F.round(scorers.percentile_rank(F.col("score"), F.col("pos"), ["lang"]), 9).alias("rank")),
        "quality_filter": lambda s, d: q(ship(s), d).where(filters.good_question(F.col("options"), F.col("question"))).select("uid"),
        "goldilocks": lambda s, d: scorers.ThreeDifficulties().transform(_difficulties(s, d)).where("score > double('-infinity')").select("uid"),
        "kcenter_order": lambda s, d: scorers.kcenter(_vectors(s, d), "label"),
        "tds_score": lambda s, d: scorers.ThreeDifficulties().transform(_difficulties(s, d)).select("uid", F.round("score", 9).alias("score")),
        "less_score": _gradient_scores(scorers.Less),
        "pds_score": _gradient_scores(scorers.Pds),
        "select_top_k": lambda s, d: _top(s, d, SELECTED),
        "select_top_k_fraction": lambda s, d: _top(s, d, 0.1),
        "select_top_k_tokens": lambda s, d: select.top_k_cost(_costed(s, d), 50_000).select("uid", "cost"),
        "select_stratified": lambda s, d: select.stratified(_lengths(s, d), "lang", SELECTED).select("uid", "lang"),
        "select_stratified_floor": lambda s, d: select.stratified(_lengths(s, d), "lang", SELECTED, 20).select("uid", "lang"),
        "select_stratified_unknown": lambda s, d: select.stratified(_lengths(s, d).withColumn("grp", F.expr(_SOME_GROUPS)), "grp", SELECTED).select("uid", F.coalesce("grp", F.lit("unknown")).alias("grp")),
        "select_stratified_tokens_floor": lambda s, d: select.stratified_cost(_costed(s, d), "lang", 0.3, 5).select("uid", "lang", "cost"),
        "select_stratified_tokens": lambda s, d: select.stratified_cost(_costed(s, d), "lang", 50_000).select("uid", "lang", "cost"),
        "allocate_quotas": _quotas,
        "token_costs": lambda s, d: _costed(s, d).select("uid", "cost"),
        "matched_budget_comparison": _matched,
        "scorer_comparison": _comparison,
        "jaccard_pairs": lambda s, d: evaluate.jaccard_pairs(*_chosen(s, d)),
        "score_summary": lambda s, d: evaluate.score_summary(_selected(s, d)),
        "token_summary": lambda s, d: evaluate.token_summary(_selected(s, d)),
        "render_prompt": lambda s, d: q(ship(s), d).select("uid", t.render_prompt(F.col("question"), F.col("options"), F.col("contexts")).alias("prompt")),
        "render_completion": lambda s, d: q(ship(s), d).select("uid", t.render_completion(F.col("answer_key"), F.col("rationale")).alias("completion")),
        "truncate_context": lambda s, d: doc(s, d).select("uid", t.truncate_head(F.array("text")).alias("context")),
        "mcq_accuracy": lambda s, d: evaluate.accuracy(_predicted(s, d)),
        "accuracy_by_subject": lambda s, d: evaluate.accuracy_by_subject(_predicted(s, d)),
        "subject_spread": lambda s, d: evaluate.subject_spread(evaluate.accuracy_by_subject(_predicted(s, d))),
        "accuracy_ci": _ci,
        "ci_overlap_pairs": lambda s, d: evaluate.ci_overlap_pairs(_runs(s, d)),
        "seed_sweep": _sweep,
        "pack_blocks": _packed,
        "apply_selection": _applied,
        "sft_prepare": _sft,
        "cpt_prepare": _cpt,
        "target_texts": lambda s, d: stages.target_texts(q(ship(s), d)),
        "target_texts_completion": lambda s, d: stages.target_texts(q(ship(s), d), 50, completion=True),
        "metric_cache_join": _cached,
        "exclusion_union": lambda s, d: caches.union_of_ids({"toxic": records.table(s, d, "labels").where("toxic = 1"), "low": records.table(s, d, "labels").where("quality = 0")}, "doc_id", ["toxic", "low"]),
        "mean_pool": lambda s, d: _vectors(s, d).select("uid", F.posexplode(scorers.mean_pool(F.array("embedding", F.reverse("embedding")), F.array(F.lit(1), F.col("label") % 2))).alias("i", "x")).select("uid", "i", F.round("x", 9).alias("x")),
        "delta_vs_base": lambda s, d: evaluate.delta_vs_base(_named_runs(s, d)),
        "results_table": lambda s, d: evaluate.results_table(_named_runs(s, d)),
        "judge_ablation": lambda s, d: evaluate.judge_ablation(_named_runs(s, d), *_judges(s, d)),
        "stream_fit_prefix": _stream_prefix,
        "stream_top_k": _stream(None),
        "stream_stratified": _stream("lang"),
        "stream_stats": _stream_stats,
    }


#: Texts of 150 line breaks and 50 to 249 characters; groups that most records lack.
_PADDED = "concat(repeat(decode(unhex('0A'), 'UTF-8'), 150), substr(text, 1, cast(50 + pos % 200 as int)))"
_PADDED_SQL = "concat(repeat(chr(10), 150), substr(text, 1, (50 + pos % 200)::INT))"
_SOME_GROUPS = "case when pos % 3 = 0 then lang end"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"


_UNI = "concat('0x', substr(md5(concat('{ns}:42:', {key})), 1, 13))::BIGINT::DOUBLE / 4503599627370496"
_D = "d AS (SELECT concat('documents/', doc_id) AS uid, doc_id AS pos, * FROM documents)"
_TOK = r"greatest(1, len(regexp_extract_all(text, '\w+|[^\w\s]')))"
_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_LEN = f"{_D}, l AS (SELECT uid, pos, lang, text, length(text)::DOUBLE AS score, {_TOK}::BIGINT AS cost FROM d)"
_Q = """br AS (SELECT list_sort(list(DISTINCT p_brand)) AS b FROM part),
q0 AS (SELECT *, list_position(b, p_brand) - 1 AS o, p_partkey % 4 AS g FROM part, br),
q AS (SELECT concat('parts/', p_partkey) AS uid, p_partkey::BIGINT AS pos, p_name AS question, p_type AS subject,
  b[(o + (0 - g + 4) % 4 * 5) % len(b) + 1] AS oa, b[(o + (1 - g + 4) % 4 * 5) % len(b) + 1] AS ob, b[(o + (2 - g + 4) % 4 * 5) % len(b) + 1] AS oc, b[(o + (3 - g + 4) % 4 * 5) % len(b) + 1] AS od,
  CASE WHEN p_size % 10 <> 0 THEN substr('ABCD', (g + 1)::INT, 1) END AS answer_key, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS answer_text,
  CASE WHEN p_size % 2 = 0 THEN concat('size ', p_size) END AS rationale FROM q0)"""
_PROMPT = "concat('Context: ', subject, chr(10), 'Question: ', question, chr(10), 'A. ', oa, chr(10), 'B. ', ob, chr(10), 'C. ', oc, chr(10), 'D. ', od, chr(10), 'Answer:')"
_COMPLETION = "' ' || answer_key || CASE WHEN rationale IS NULL THEN '' ELSE concat(chr(10), chr(10), 'Explanation: ', rationale) END"
_PRED = f"""{_Q}, o1 AS (SELECT uid, answer_key, subject, unnest(['A', 'B', 'C', 'D']) AS key, unnest([oa, ob, oc, od]) AS opt FROM q WHERE answer_key IS NOT NULL),
o2 AS (SELECT *, -10.0 * ({_UNI.format(ns='option', key='uid, key')}) AS total FROM o1),
pr AS (SELECT uid, answer_key, subject, arg_max(key, (total, -ascii(key))) = answer_key AS correct, arg_max(key, (total / length(opt), -ascii(key))) = answer_key AS correct_norm FROM o2 GROUP BY uid, answer_key, subject),
by_ AS (SELECT subject, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT), 4) AS accuracy FROM pr GROUP BY subject)"""
_DIFF = f"""{_Q}, df AS (SELECT uid, pos, {', '.join(f"({_UNI.format(ns=f'd{k}', key='uid')}) AS d{k}" for k in (1, 2, 3))} FROM q WHERE length(trim(question)) >= 10 AND len(list_distinct([oa, ob, oc, od])) >= 2),
pc AS (SELECT uid, {', '.join(f"100.0 * (row_number() OVER (ORDER BY d{k}, pos) - 1) / greatest(count(*) OVER () - 1, 1) AS p{k}" for k in (1, 2, 3))} FROM df),
sc AS (SELECT q.uid, CASE WHEN p1 BETWEEN 25 AND 75 AND p2 BETWEEN 25 AND 75 AND p3 BETWEEN 25 AND 75 THEN -(abs(p1 - 50) + abs(p2 - 50) + abs(p3 - 50)) ELSE '-Infinity'::DOUBLE END AS score FROM q LEFT JOIN pc USING (uid))"""
_CRC = """tab AS (SELECT list(list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tb FROM range(256) r(n)),
crc AS (SELECT g, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(g, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(tb[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket FROM (SELECT DISTINCT g FROM grams), tab)"""


def _grams(source: str) -> str:
    return f"""nw AS (SELECT id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS w FROM ({source})),
grams AS (SELECT id, unnest(w) AS g FROM nw UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS g FROM nw WHERE len(w) > 1)"""


_BOTH = f"""WITH {_grams("SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id AS id, text FROM benchmark")}, {_CRC},
gb AS (SELECT id, bucket FROM grams JOIN crc USING (g)), bk AS (SELECT r AS bucket FROM range(10000) t(r)),
m AS (SELECT bk.bucket, ln((count(*) FILTER (id < 0) + 1.0) / (sum(count(*) FILTER (id < 0)) OVER () + 10000.0)) - ln((count(*) FILTER (id >= 0) + 1.0) / (sum(count(*) FILTER (id >= 0)) OVER () + 10000.0)) AS ratio FROM bk LEFT JOIN gb USING (bucket) GROUP BY bk.bucket),
wt AS (SELECT id, sum(ratio) / count(*) AS w FROM gb JOIN m USING (bucket) WHERE id >= 0 GROUP BY id),
sc AS (SELECT concat('documents/', doc_id) AS uid, coalesce(w, 0.0) AS w FROM documents LEFT JOIN wt ON id = doc_id)"""
_LM = f"""WITH {_D}, ws AS (SELECT uid, doc_id, list_concat(['<s>'], list_filter(string_split({_NORM}, ' '), lambda x: x <> '')) AS w FROM d),
bg AS (SELECT uid, doc_id, unnest(w[1:-2]) AS u, unnest(w[2:]) AS v FROM ws WHERE len(w) > 1), tr AS (SELECT * FROM bg),
uni AS (SELECT v, count(*) AS cv FROM tr GROUP BY v), lf AS (SELECT u, count(*) AS cu FROM tr GROUP BY u), bi AS (SELECT u, v, count(*) AS cuv FROM tr GROUP BY u, v), tt AS (SELECT sum(cv) AS n, count(*) AS k FROM uni),
nl AS (SELECT uid, sum(-ln(0.5 * (coalesce(cuv, 0) + 0.1) / (coalesce(cu, 0) + 0.1 * k) + 0.5 * (coalesce(cv, 0) + 0.1) / (tt.n + 0.1 * k))) AS nll, count(*) AS n FROM bg LEFT JOIN bi USING (u, v) LEFT JOIN lf USING (u) LEFT JOIN uni USING (v), tt GROUP BY uid),
mn AS (SELECT uid, coalesce(nll / nl.n, 0.0) AS x FROM d LEFT JOIN nl USING (uid))"""
_CHOSEN = f"""WITH RECURSIVE {_LEN}, s AS (SELECT uid, pos, cost, unnest(['random', 'length', 'words']) AS scorer, unnest([{_UNI.format(ns='random', key='uid')}, score, len(regexp_extract_all(text, '[^\\s\\x1c-\\x1f\\p{{Z}}]+'))::DOUBLE]) AS score FROM l),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY score DESC, pos) AS r FROM s) WHERE r <= 100)"""
_GREEDY = """rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS r FROM {pool}),
go AS (SELECT 0::BIGINT AS r, {budget}::BIGINT AS rest, false AS took UNION ALL SELECT rk.r, CASE WHEN cost <= rest THEN rest - cost ELSE rest END, cost <= rest FROM go JOIN rk ON rk.r = go.r + 1)"""
_SHARE = """cg AS (SELECT lang, count(*) AS size, count(*)::HUGEINT * 100 // sum(count(*)) OVER () AS share FROM d GROUP BY lang),
qf AS (SELECT lang, size, least(size, greatest({floor}, share)) AS b FROM cg)"""


#: Quotas with a floor of 20: what is above or below the budget goes off or on in whole rounds, the rest one each in order.
_FLOOR_QUOTA = """cg AS (SELECT lang, count(*) AS size, count(*)::HUGEINT * 100 // sum(count(*)) OVER () AS share FROM d GROUP BY lang),
q1 AS (SELECT lang, size, least(size, greatest(20, share)) AS b FROM cg), q2 AS (SELECT *, sum(b) OVER () - 100 AS ex FROM q1),
q3 AS (SELECT *, CASE WHEN ex > 0 THEN b - least(20, size) ELSE size - b END AS room FROM q2),
rd AS (SELECT arg_max(r, r) AS r, arg_max(m, r) AS m FROM (SELECT r, sum(least(r, room)) AS m, any_value(abs(ex)) AS ex FROM q3, range(101) t(r) GROUP BY r) WHERE m <= ex),
qt AS (SELECT lang, b - sign(ex) * (least(r, room) + CASE WHEN room > r AND row_number() OVER (PARTITION BY room > r ORDER BY CASE WHEN ex > 0 THEN size ELSE -size END, lang) <= abs(ex) - m THEN 1 ELSE 0 END) AS quota FROM q3, rd)"""
_FLOOR_TOKENS = f"""WITH RECURSIVE {_LEN}, rk AS (SELECT uid, lang, cost, pos, row_number() OVER (PARTITION BY lang ORDER BY score DESC, pos) AS r FROM l),
bt AS (SELECT round_even(0.3 * sum(cost), 0) AS t FROM l), gr AS (SELECT lang, row_number() OVER (ORDER BY min(pos)) AS gi, sum(cost)::DOUBLE * (SELECT t FROM bt) / sum(sum(cost)) OVER () - sum(cost) FILTER (r <= 5) AS room, sum(cost) FILTER (r <= 5) AS fl FROM rk GROUP BY lang),
ca AS (SELECT uid, cost::DOUBLE AS cost, gi, room, row_number() OVER (ORDER BY gi, r) AS rr FROM rk JOIN gr USING (lang) WHERE r > 5),
go AS (SELECT 0::BIGINT AS rr, ((SELECT t FROM bt) - (SELECT sum(fl) FROM gr))::DOUBLE AS rest, 0.0::DOUBLE AS lft, 0::BIGINT AS gi, false AS took, '' AS uid
  UNION ALL SELECT ca.rr, CASE WHEN ca.cost <= CASE WHEN ca.gi <> go.gi THEN least(room, rest) ELSE lft END THEN rest - ca.cost ELSE rest END,
    CASE WHEN ca.gi <> go.gi THEN least(room, rest) ELSE lft END - CASE WHEN ca.cost <= CASE WHEN ca.gi <> go.gi THEN least(room, rest) ELSE lft END THEN ca.cost ELSE 0 END,
    ca.gi, ca.cost <= CASE WHEN ca.gi <> go.gi THEN least(room, rest) ELSE lft END, ca.uid FROM go JOIN ca ON ca.rr = go.rr + 1)
SELECT uid, lang, cost FROM rk WHERE r <= 5 OR uid IN (SELECT uid FROM go WHERE took)"""
_RUNS = f"""WITH {_PRED}, ru AS (SELECT subject AS name, accuracy, round(accuracy - 1.96 * sqrt(accuracy * (1 - accuracy) / n), 4) AS low, round(accuracy + 1.96 * sqrt(accuracy * (1 - accuracy) / n), 4) AS high FROM by_),
nr AS (SELECT CASE WHEN name = min(name) OVER () THEN '__base__' ELSE name END AS name, accuracy, low, high FROM ru)"""


_KCENTER = """
WITH RECURSIVE v AS (SELECT label, vec_id AS pos, embedding::DOUBLE[] AS a FROM embeddings),
m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(a[i]) AS x FROM v, range(1, 65) t(i) GROUP BY ALL) GROUP BY label),
f AS (SELECT v.*, row_number() OVER (PARTITION BY label ORDER BY list_distance(a, c), pos) = 1 AS now FROM v JOIN m USING (label)),
k AS (
  SELECT 0::BIGINT AS rank, label, pos, a, 'inf'::DOUBLE AS gap, now, now AS taken FROM f
  UNION ALL
  SELECT rank + 1, label, pos, a, gap, n, taken OR n FROM (
    SELECT *, NOT taken AND row_number() OVER (PARTITION BY label ORDER BY taken, gap DESC, pos) = 1 AS n FROM (
      SELECT rank, label, pos, a, taken, least(gap, list_distance(a, first_value(a) OVER (PARTITION BY label ORDER BY now DESC))) AS gap, bool_and(taken) OVER (PARTITION BY label) AS over_
      FROM k) WHERE NOT over_))
SELECT label, pos, rank FROM k WHERE now"""


def oracle_sql() -> dict[str, str]:
    uni = _UNI.format(ns="random", key="uid")
    top = f"WITH {_LEN} SELECT uid, score, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM l QUALIFY rank <= "
    sel = f"WITH {_LEN}, s AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) <= 100 AS selected FROM l) "
    # shares round down; what is missing goes one by one to the largest groups
    quota = f"{_SHARE.format(floor=0)}, qt AS (SELECT lang, (b + CASE WHEN row_number() OVER (ORDER BY size DESC, lang) <= 100 - sum(b) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM qf)"
    ranked = "SELECT uid, l.lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, pos) AS r FROM l) l JOIN qt ON qt.lang = l.lang WHERE r <= quota"
    return {
        "corpus_view": f"WITH {_D} SELECT uid, 'documents' AS source, text, '' AS title, pos, lang FROM d",
        "pages_view": r"WITH p AS (SELECT concat('pages/', page_id) AS uid, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages) SELECT uid, title, CASE WHEN trim(title) <> '' THEN concat(title, chr(10), chr(10), body) ELSE body END AS full_text FROM p",
        "qa_view": f"WITH {_Q} SELECT uid, question, oa AS option_a, ob AS option_b, oc AS option_c, od AS option_d, answer_key, answer_text, answer_key IS NOT NULL AS is_labeled, len(list_distinct(['A', 'B', 'C', 'D']))::INTEGER AS n_options FROM q",
        "dialogue_view": "SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
        "make_uid": "SELECT doc_id AS pos, printf('documents/train/%06d', doc_id) AS uid FROM documents",
        "shard_prune": "SELECT printf('chunk/pubmed23n%04d.jsonl', i) AS shard FROM range(1161, 1167) t(i)",
        "human_bytes": f"WITH {_D}, n AS (SELECT uid, pow(3.7, pos % 23) AS n FROM d) SELECT uid, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824) ELSE printf('%.1f TB', n / 1099511627776) END AS size FROM n",
        "limit_raw": f"WITH {_D} SELECT uid FROM (SELECT * FROM d ORDER BY pos LIMIT 100) WHERE length({_strip('text')}) >= 200",
        "limit_kept": f"WITH {_D} SELECT uid FROM d WHERE length({_strip('text')}) >= 200 ORDER BY pos LIMIT 100",
        "split_slice": f"WITH {_D} SELECT uid FROM d WHERE pos >= 50 AND pos < 120",
        "filter_min_chars": f"WITH {_D} SELECT uid FROM d WHERE length({_strip('text')}) >= 200",
        "filter_min_chars_padded": f"WITH {_D} SELECT uid FROM d WHERE length({_strip(_PADDED_SQL)}) >= 200",
        "dedup_first": f"WITH {_D} SELECT uid, pos FROM d QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY pos) = 1",
        "contamination_anti_join": f"WITH {_D} SELECT uid FROM d ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) x USING (doc_id)",
        "corpus_pipeline": f"WITH {_D}, a AS (SELECT * FROM d ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) x USING (doc_id)), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY pos) = 1) SELECT uid, pos FROM b WHERE length({_strip('text')}) >= 200",
        "corpus_stats": "SELECT count(*) AS n, 0::BIGINT AS with_title, round(avg(length(text)), 1) AS mean_chars, sum(length(text))::BIGINT AS total_chars FROM documents",
        "qa_stats": f"WITH {_Q} SELECT count(*) AS n, count(answer_key) AS n_labelled, round(count(answer_key) / count(*), 4) AS labelled_share, round(avg(length(question)), 1) AS mean_question_chars, count(*) AS with_four_options FROM q",
        "top_subjects": f"WITH {_Q} SELECT subject, count(*) AS n FROM q GROUP BY subject ORDER BY n DESC, min(pos) LIMIT 10",
        "fingerprint": "SELECT CASE WHEN count(*) = 0 THEN 'none' ELSE concat(count(DISTINCT doc_id), '@', substr(sha256(array_to_string(list_sort(list(DISTINCT doc_id)), ',')), 1, 10)) END AS fingerprint FROM labels WHERE toxic = 1",
        "score_random": f"WITH {_D} SELECT uid, {uni} AS score FROM d",
        "score_length_chars": f"WITH {_LEN} SELECT uid, score FROM l",
        "score_length_words": f"WITH {_D} SELECT uid, len(regexp_extract_all(text, '[^\\s\\x1c-\\x1f\\p{{Z}}]+'))::DOUBLE AS score FROM d",
        "dsir_normalize": f"WITH {_D} SELECT uid, {_NORM} AS norm FROM d",
        "dsir_ngrams": f"WITH {_grams('SELECT item_id AS id, text FROM benchmark')}, {_CRC} SELECT bucket::INTEGER AS bucket, count(*) AS cnt FROM grams JOIN crc USING (g) GROUP BY bucket",
        "dsir_bucket_model": f"WITH {_grams('SELECT item_id AS id, text FROM benchmark')}, {_CRC}, gb AS (SELECT bucket FROM grams JOIN crc USING (g)) SELECT r::INTEGER AS bucket, round(ln((count(gb.bucket) + 1.0) / (sum(count(gb.bucket)) OVER () + 10000.0)), 9) AS logp FROM range(10000) t(r) LEFT JOIN gb ON gb.bucket = r GROUP BY r",
        "dsir_weight": f"{_BOTH} SELECT uid, round(w, 9) AS score FROM sc",
        "dsir_gumbel": f"{_BOTH} SELECT uid, round(w + 0.3 * stddev_pop(w) OVER () * -ln(-ln({_UNI.format(ns='dsir', key='uid')} + 1e-12) + 1e-12), 6) AS score FROM sc",
        "embed_centroid": "WITH x AS (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 3), m AS (SELECT i, avg(x) AS m FROM x GROUP BY i) SELECT i::INTEGER AS i, round(m / sqrt(sum(m * m) OVER ()), 9) AS c FROM m",
        "embed_similarity": "WITH x AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS z FROM x), m AS (SELECT i, avg(z) AS m FROM u WHERE label = 3 GROUP BY i), c AS (SELECT i, m / sqrt(sum(m * m) OVER ()) AS c FROM m) SELECT concat('vec/', vec_id) AS uid, round(sum(z * c), 9) AS score FROM u JOIN c USING (i) GROUP BY vec_id",
        "ngram_lm_nll": f"{_LM} SELECT uid, round(nll, 6) AS nll, n FROM nl",
        "perplexity_low": f"{_LM} SELECT uid, round(-x, 9) AS score FROM mn",
        "perplexity_mid": f"{_LM} SELECT uid, round(-abs(x - median(x) OVER ()), 9) AS score FROM mn",
        "perplexity_high": f"{_LM} SELECT uid, round(x, 9) AS score FROM mn",
        "corpus_perplexity": f"{_LM} SELECT sum(n)::BIGINT AS n_tokens, round(sum(nll) / sum(n), 6) AS mean_nll, round(exp(sum(nll) / sum(n)), 4) AS perplexity FROM nl",
        "percentile_rank": f"WITH {_LEN} SELECT uid, round(100.0 * (row_number() OVER (PARTITION BY lang ORDER BY score, pos) - 1) / greatest(count(*) OVER (PARTITION BY lang) - 1, 1), 9) AS rank FROM l",
        "quality_filter": f"WITH {_Q} SELECT uid FROM q WHERE length(trim(question)) >= 10 AND len(list_distinct([oa, ob, oc, od])) >= 2",
        "goldilocks": f"WITH {_DIFF} SELECT uid FROM sc WHERE score > '-Infinity'::DOUBLE",
        "tds_score": f"WITH {_DIFF} SELECT uid, round(score, 9) AS score FROM sc",
        "select_top_k": top + "100",
        "select_top_k_fraction": top + "(SELECT round_even(0.1 * count(*), 0) FROM l)",
        "select_top_k_tokens": f"WITH RECURSIVE {_LEN}, {_GREEDY.format(pool='l', budget=50_000)} SELECT uid, cost FROM rk JOIN go USING (r) WHERE took",
        "select_stratified": f"WITH {_LEN}, {quota} {ranked} ",
        "select_stratified_floor": f"WITH {_LEN}, {_FLOOR_QUOTA} {ranked}",
        "select_stratified_unknown": f"WITH {_LEN}, g AS (SELECT uid, score, pos, coalesce(CASE WHEN pos % 3 = 0 THEN lang END, 'unknown') AS grp FROM l), cg AS (SELECT grp, count(*) AS size, count(*)::HUGEINT * 100 // sum(count(*)) OVER () AS b FROM g GROUP BY grp), qt AS (SELECT grp, b + CASE WHEN row_number() OVER (ORDER BY size DESC, grp) <= 100 - sum(b) OVER () THEN 1 ELSE 0 END AS quota FROM cg) SELECT uid, grp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, pos) AS r FROM g) JOIN qt USING (grp) WHERE r <= quota",
        "select_stratified_tokens_floor": _FLOOR_TOKENS,
        "cpt_prepare": rf"WITH {_LEN}, tk AS (SELECT pos, list_concat(regexp_extract_all(text, '\w+|[^\w\s]'), ['</s>']) AS w FROM (SELECT * FROM l ORDER BY score DESC, pos LIMIT 100)), st AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM tk), fl AS (SELECT s + unnest(range(len(w))) AS o, unnest(w) AS x FROM st) SELECT o // 512 AS block, count(*) AS n, md5(string_agg(x, ' ' ORDER BY o)) AS digest FROM fl GROUP BY block HAVING count(*) = 512",
        "target_texts": f"WITH {_Q} SELECT uid, {_PROMPT} AS text FROM q ORDER BY pos LIMIT 2000",
        "target_texts_completion": f"WITH {_Q} SELECT uid, concat({_PROMPT}, {_COMPLETION}) AS text FROM q WHERE answer_key IS NOT NULL ORDER BY pos LIMIT 50",
        "metric_cache_join": f"WITH {_D} SELECT uid, length(text)::INTEGER AS metric FROM d",
        "exclusion_union": "SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 OR quality = 0",
        "kcenter_order": _KCENTER,
        "mean_pool": "WITH v AS (SELECT concat('vec/', vec_id) AS uid, label % 2 AS m, embedding::DOUBLE[] AS a FROM embeddings), x AS (SELECT uid, unnest(range(64)) AS i, unnest(list_transform(range(1, 65), lambda j: (a[j] + m * a[65 - j]) / (1 + m))) AS x FROM v) SELECT uid, i::INTEGER AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY uid)), 9) AS x FROM x",
        "delta_vs_base": f"{_RUNS} SELECT name, accuracy, round(accuracy - (SELECT accuracy FROM nr WHERE name = '__base__'), 9) AS delta FROM nr WHERE name <> '__base__'",
        "results_table": rf"{_RUNS}, rt AS (SELECT *, round(accuracy - (SELECT accuracy FROM nr WHERE name = '__base__'), 9) AS delta FROM nr) SELECT name, accuracy, low, high, delta, printf('%s & %.4f & [%.4f, %.4f] & %+.4f \\', replace(name, '_', '\_'), accuracy, low, high, delta) AS latex FROM rt",
        "judge_ablation": f"{_RUNS}, j AS (SELECT * FROM nr WHERE name IN (SELECT name FROM ru ORDER BY name DESC LIMIT 2)) SELECT a.name AS name_a, b.name AS name_b, round(a.accuracy - b.accuracy, 9) AS delta, a.low <= b.high AND b.low <= a.high AS overlap, CASE WHEN NOT (a.low <= b.high AND b.low <= a.high) THEN CASE WHEN a.accuracy > b.accuracy THEN a.name ELSE b.name END END AS winner FROM j a JOIN j b ON a.name < b.name",
        "stream_fit_prefix": f"{_BOTH.replace('id >= 0', 'id BETWEEN 0 AND 199').replace('FROM gb JOIN m USING (bucket) WHERE id BETWEEN 0 AND 199', 'FROM gb JOIN m USING (bucket) WHERE id >= 0')} SELECT uid, round(w, 9) AS score FROM sc JOIN documents ON uid = concat('documents/', doc_id) ORDER BY w DESC, doc_id LIMIT 100",
        "select_stratified_tokens": f"""WITH RECURSIVE {_LEN}, sh AS (SELECT lang, sum(cost) * 50000.0 / sum(sum(cost)) OVER () AS share FROM l GROUP BY lang), rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, pos) AS r FROM l),
go AS (SELECT lang, 0::BIGINT AS r, share AS rest, false AS took FROM sh UNION ALL SELECT rk.lang, rk.r, CASE WHEN cost <= rest THEN rest - cost ELSE rest END, cost <= rest FROM go JOIN rk ON rk.lang = go.lang AND rk.r = go.r + 1) SELECT uid, lang, cost FROM rk JOIN go USING (lang, r) WHERE took""",
        "allocate_quotas": f"WITH {_D}, {quota} SELECT lang, quota FROM qt",
        "token_costs": f"WITH {_LEN} SELECT uid, cost FROM l",
        "matched_budget_comparison": f"WITH RECURSIVE {_LEN}, bd AS (SELECT sum(cost)::BIGINT AS budget FROM (SELECT cost FROM l ORDER BY {uni} DESC, pos LIMIT 100)), {_GREEDY.format(pool='l', budget='(SELECT budget FROM bd)')} SELECT count(*) AS n, sum(cost)::BIGINT AS tokens, any_value(budget) AS budget FROM rk JOIN go USING (r), bd WHERE took",
        "scorer_comparison": f"{_CHOSEN}, pm AS (SELECT scorer, round(avg(score), 9) AS pool_mean FROM s GROUP BY scorer), pp AS (SELECT scorer, count(*) AS n, sum(cost)::BIGINT AS tokens, round(avg(cost), 9) AS mean_tokens, round(avg(score), 9) AS sel_mean FROM c GROUP BY scorer) SELECT scorer, n, tokens, mean_tokens, sel_mean, pool_mean, round(tokens / (SELECT tokens FROM pp WHERE scorer = 'random'), 9) AS vs_random FROM pp JOIN pm USING (scorer)",
        "jaccard_pairs": f"{_CHOSEN}, pr AS (SELECT * FROM (VALUES ('random', 'length'), ('random', 'words'), ('length', 'words')) v(a, b)) SELECT pr.a AS scorer_a, pr.b AS scorer_b, round((SELECT count(*) FROM c x JOIN c y USING (uid) WHERE x.scorer = pr.a AND y.scorer = pr.b) / (SELECT count(DISTINCT uid) FROM c WHERE scorer IN (pr.a, pr.b)), 9) AS jaccard FROM pr",
        "score_summary": sel + "SELECT min(score) AS pool_min, max(score) AS pool_max, round(avg(score), 9) AS pool_mean, min(score) FILTER (selected) AS sel_min, max(score) FILTER (selected) AS sel_max, round(avg(score) FILTER (selected), 9) AS sel_mean FROM s",
        "token_summary": sel + "SELECT sum(cost) FILTER (selected)::BIGINT AS selected_tokens, sum(cost)::BIGINT AS pool_tokens FROM s",
        "render_prompt": f"WITH {_Q} SELECT uid, {_PROMPT} AS prompt FROM q",
        "render_completion": f"WITH {_Q} SELECT uid, {_COMPLETION} AS completion FROM q",
        "truncate_context": f"WITH {_D} SELECT uid, CASE WHEN length(t) > 2000 THEN concat('...', right(t, 2000)) ELSE t END AS context FROM (SELECT uid, {_strip('text')} AS t FROM d)",
        "mcq_accuracy": f"WITH {_PRED} SELECT count(*) AS n_scored, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT), 4) AS accuracy, round(avg(correct_norm::INT), 4) AS accuracy_norm FROM pr",
        "accuracy_by_subject": f"WITH {_PRED} SELECT * FROM by_",
        "subject_spread": f"WITH {_PRED} SELECT count(*) AS n_subjects, round(avg(accuracy), 9) AS mean, round(var_pop(accuracy), 9) AS variance, round(stddev_pop(accuracy), 9) AS std, min(accuracy) AS min, max(accuracy) AS max, round(max(accuracy) - min(accuracy), 9) AS range, arg_min(subject, (accuracy, subject)) AS worst, arg_max(subject, (accuracy, subject)) AS best FROM by_ WHERE n >= 10",
        "ci_overlap_pairs": f"WITH {_PRED}, ru AS (SELECT subject AS name, accuracy, round(accuracy - 1.96 * sqrt(accuracy * (1 - accuracy) / n), 4) AS low, round(accuracy + 1.96 * sqrt(accuracy * (1 - accuracy) / n), 4) AS high FROM by_) SELECT a.name AS name_a, b.name AS name_b, round(a.accuracy - b.accuracy, 9) AS delta, a.low <= b.high AND b.low <= a.high AS overlap, CASE WHEN NOT (a.low <= b.high AND b.low <= a.high) THEN CASE WHEN a.accuracy > b.accuracy THEN a.name ELSE b.name END END AS winner FROM ru a JOIN ru b ON a.name < b.name",
        "seed_sweep": f"WITH {_PRED}, sw AS (SELECT subject AS scorer, regexp_extract(uid, '([0-9]+)$', 1)::BIGINT % 3 AS seed, round(avg(correct::INT), 4) AS accuracy FROM pr GROUP BY ALL) SELECT scorer, count(*) AS n, round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS std, min(accuracy) AS min, max(accuracy) AS max FROM sw GROUP BY scorer",
        "pack_blocks": rf"WITH {_D}, tk AS (SELECT pos, list_concat(regexp_extract_all(text, '\w+|[^\w\s]'), ['</s>']) AS w FROM d), st AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM tk), fl AS (SELECT s + unnest(range(len(w))) AS o, unnest(w) AS x FROM st) SELECT o // 1024 AS block, count(*) AS n, md5(string_agg(x, ' ' ORDER BY o)) AS digest FROM fl GROUP BY o // 1024 HAVING count(*) = 1024",
        "apply_selection": f"WITH {_LEN} SELECT uid, pos FROM l ORDER BY score DESC, pos LIMIT 100",
        "sft_prepare": f"WITH {_Q} SELECT uid, {_PROMPT} AS prompt, {_COMPLETION} AS completion FROM q WHERE answer_key IS NOT NULL",
        "stream_top_k": f"WITH {_LEN} SELECT uid, score, pos, (row_number() OVER (ORDER BY score DESC, pos))::INTEGER AS rank FROM l QUALIFY rank <= 100",
        "stream_stratified": f"WITH {_LEN}, {quota} SELECT uid, l.lang AS grp, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, pos) AS r FROM l) l JOIN qt ON qt.lang = l.lang WHERE r <= quota",
        "stream_stats": f"WITH {_LEN} SELECT lang AS grp, count(*) AS n, sum(score) AS total, min(score) AS least, max(score) AS most FROM l GROUP BY lang",
    }
