"""Statistics of pools, selections and evaluation runs."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def corpus_stats(docs: DataFrame, full: Column) -> DataFrame:
    n = F.length(full)
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(strip(F.col("title")) != "").alias("with_title"), F.round(F.avg(n), 1).alias("mean_chars"), F.sum(n).cast("long").alias("total_chars"))


def qa_stats(qa: DataFrame) -> DataFrame:
    labelled = F.count_if(F.col("answer_key").isNotNull())
    return qa.agg(
        F.count(F.lit(1)).alias("n"), labelled.alias("n_labelled"), F.round(labelled / F.count(F.lit(1)), 4).alias("labelled_share"),
        F.round(F.avg(F.length("question")), 1).alias("mean_question_chars"), F.count_if(F.coalesce(F.size("options"), F.lit(0)) == 4).alias("with_four_options"),
    )


def top_subjects(qa: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent subjects; of equals the one seen first."""
    rows = qa.groupBy(F.coalesce(F.col("labels")["subject"], F.lit("unknown")).alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(k).select("subject", "n")


def score_summary(scored: DataFrame) -> DataFrame:
    """Least, most and mean score of a pool and of its rows with ``selected``; and the token sums of both."""
    pick = F.when(F.col("selected"), F.col("score"))
    return scored.agg(
        F.min("score").alias("pool_min"), F.max("score").alias("pool_max"), F.round(F.avg("score"), 9).alias("pool_mean"),
        F.min(pick).alias("sel_min"), F.max(pick).alias("sel_max"), F.round(F.avg(pick), 9).alias("sel_mean"),
    )


def token_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.coalesce(F.sum(F.when(F.col("selected"), F.col("cost"))), F.lit(0)).alias("selected_tokens"), F.sum("cost").alias("pool_tokens"))


def jaccard_pairs(chosen: DataFrame, names: list[str]) -> DataFrame:
    """Overlap of the uid sets of scorers (scorer, uid), a row for each pair in list order; 0 for two empty sets."""
    sizes = chosen.groupBy("scorer").agg(F.count(F.lit(1)).alias("n"))
    order = chosen.sparkSession.createDataFrame([(s, i) for i, s in enumerate(names)], "scorer string, i int")
    sizes = order.join(sizes, "scorer", "left").fillna(0, ["n"])
    a, b = (sizes.select(F.col("scorer").alias(f"scorer_{x}"), F.col("i").alias(f"i{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    both = chosen.select(F.col("scorer").alias("scorer_a"), "uid").join(chosen.select(F.col("scorer").alias("scorer_b"), "uid"), "uid").groupBy("scorer_a", "scorer_b").agg(F.count(F.lit(1)).alias("both"))
    pairs = a.join(F.broadcast(b), F.col("ia") < F.col("ib")).join(both, ["scorer_a", "scorer_b"], "left").fillna(0, ["both"])
    union = F.col("na") + F.col("nb") - F.col("both")
    return pairs.select("scorer_a", "scorer_b", F.round(F.when(union > 0, F.col("both") / union).otherwise(0.0), 9).alias("jaccard"))


def scorer_comparison(chosen: DataFrame, pool_mean: DataFrame) -> DataFrame:
    """Of each scorer's selection (scorer, score, cost): size, tokens, mean score against the pool's, tokens against random's."""
    per = chosen.groupBy("scorer").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("tokens"), F.round(F.avg("cost"), 9).alias("mean_tokens"), F.round(F.avg("score"), 9).alias("sel_mean"))
    base = per.where("scorer = 'random'").select(F.col("tokens").alias("base"))
    return per.join(pool_mean, "scorer").crossJoin(F.broadcast(base)).select("scorer", "n", "tokens", "mean_tokens", "sel_mean", "pool_mean", F.round(F.col("tokens") / F.col("base"), 9).alias("vs_random"))


def predict(options: DataFrame) -> DataFrame:
    """(uid, answer_key, subject, correct, correct_norm) from option scores (uid, key, total, n_tok); first key of equals."""
    best = lambda c: F.max_by("key", F.struct(c, -F.ascii("key")))
    rows = options.where("answer_key is not null").groupBy("uid", "answer_key", "subject").agg(best(F.col("total")).alias("raw"), best(F.col("total") / F.greatest(F.lit(1), F.col("n_tok"))).alias("norm"))
    return rows.select("uid", "answer_key", "subject", (F.col("raw") == F.col("answer_key")).alias("correct"), (F.col("norm") == F.col("answer_key")).alias("correct_norm"))


def accuracy(predicted: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    return predicted.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if("correct").alias("n_correct"), mean("correct").alias("accuracy"), mean("correct_norm").alias("accuracy_norm"))


def accuracy_by_subject(predicted: DataFrame) -> DataFrame:
    return predicted.where("subject is not null").groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"))


def subject_spread(by_subject: DataFrame, least: int = 10) -> DataFrame:
    """Spread of the rounded accuracies over subjects with enough records; names break ties."""
    acc = F.col("accuracy")
    return by_subject.where(F.col("n") >= least).agg(
        F.count(F.lit(1)).alias("n_subjects"), F.round(F.avg(acc), 9).alias("mean"), F.round(F.var_pop(acc), 9).alias("variance"), F.round(F.stddev_pop(acc), 9).alias("std"),
        F.min(acc).alias("min"), F.max(acc).alias("max"), F.round(F.max(acc) - F.min(acc), 9).alias("range"),
        F.min_by("subject", F.struct(acc, "subject")).alias("worst"), F.max_by("subject", F.struct(acc, "subject")).alias("best"),
    )


def accuracy_ci(correct: int, scored: int, confidence: float = 0.95, resamples: int = 2000, seed: int = 0) -> tuple[float, float] | None:
    """Percentile interval of binomial draws at the observed rate."""
    if not scored:
        return None
    draws = np.random.default_rng(seed).binomial(scored, correct / scored, resamples) / scored
    tail = 100 * (1 - confidence) / 2
    low, high = np.percentile(draws, [tail, 100 - tail])
    return round(float(low), 4), round(float(high), 4)


def ci_overlap_pairs(runs: DataFrame) -> DataFrame:
    """Pairs of runs (name, accuracy, low, high): do the intervals overlap, and if not, which is better; few rows."""
    a, b = (reduce(lambda d, c: d.withColumnRenamed(c, f"{c}_{x}"), ("name", "accuracy", "low", "high"), runs.select("name", "accuracy", "low", "high")) for x in "ab")
    overlap = (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a"))
    better = F.when(F.col("accuracy_a") > F.col("accuracy_b"), F.col("name_a")).otherwise(F.col("name_b"))
    return a.join(F.broadcast(b), F.col("name_a") < F.col("name_b")).select("name_a", "name_b", F.round(F.col("accuracy_a") - F.col("accuracy_b"), 9).alias("delta"), overlap.alias("overlap"), F.when(~overlap, better).alias("winner"))


def delta_vs_base(runs: DataFrame, base: str = "__base__") -> DataFrame:
    """Accuracy of each run less that of the base run."""
    one = runs.where(F.col("name") == base).select(F.col("accuracy").alias("base"))
    return runs.where(F.col("name") != base).crossJoin(F.broadcast(one)).select("name", "accuracy", F.round(F.col("accuracy") - F.col("base"), 9).alias("delta"))


def seed_sweep(runs: DataFrame) -> DataFrame:
    """Mean, population deviation and range of accuracies (scorer, accuracy) over seeds."""
    a = F.col("accuracy")
    return runs.groupBy("scorer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(a), 9).alias("mean"), F.round(F.stddev_pop(a), 9).alias("std"), F.min(a).alias("min"), F.max(a).alias("max"))


def perplexity_report(losses: DataFrame) -> DataFrame:
    """Token-weighted mean loss of (nll, n) rows and its exponential; null without tokens."""
    mean = F.sum("nll") / F.nullif(F.sum("n"), F.lit(0))
    return losses.agg(F.sum("n").alias("n_tokens"), F.round(mean, 6).alias("mean_nll"), F.round(F.exp(mean), 4).alias("perplexity"))


def results_table(runs: DataFrame, base: str = "__base__") -> DataFrame:
    """Runs (name, accuracy, low, high) best first, with the gain on the base run and a row of a LaTeX table."""
    one = runs.where(F.col("name") == base).select(F.col("accuracy").alias("base"))
    rows = runs.join(F.broadcast(one), how="left").withColumn("delta", F.round(F.col("accuracy") - F.col("base"), 9)).drop("base")
    cells = [F.replace("name", F.lit("_"), F.lit("\\_")), F.format_string("%.4f", "accuracy"), F.format_string("[%.4f, %.4f]", "low", "high"), F.coalesce(F.format_string("%+.4f", "delta"), F.lit("--"))]
    return rows.select("name", "accuracy", "low", "high", "delta", F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("latex"))


def judge_ablation(runs: DataFrame, one: str, other: str) -> DataFrame:
    """Two judges' runs (name, accuracy, low, high) under one budget: difference, whether the intervals overlap, the better."""
    return ci_overlap_pairs(runs.where(F.col("name").isin(one, other)))


def report(predicted: DataFrame, by_subject: DataFrame, source: str, split: str, model: str, mode: str = "letter") -> dict:
    """What one evaluation run is written down as: counts, accuracies, interval, subjects and their spread."""
    row = accuracy(predicted).first().asDict()
    interval = accuracy_ci(row["n_correct"], row["n_scored"])
    subjects = {r.subject: {"n": r.n, "accuracy": r.accuracy} for r in by_subject.orderBy("subject").collect()}
    return {"source": source, "split": split, "model": model, "mode": mode, **row, "accuracy_ci": interval, "by_subject": subjects, "spread": subject_spread(by_subject).first().asDict()}
