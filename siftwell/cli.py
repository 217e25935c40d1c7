"""Command line: info, data list, data stats, data prepare, select, eval, stage (the data of an experiment); results are printed as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import experiment
from .functions import text as t
from .operators import evaluate, select
from .session import get_spark
from .sources import records
from .sources.registry import LOADERS, SCORERS
from .stages import STAGES, record_text, record_type


def coerce(value: str) -> bool | None | int | float | str:
    """What a word of the command line means: truth value, nothing, whole number, number, else itself."""
    words = {"true": True, "false": False, "none": None, "null": None}
    if value.lower() in words:
        return words[value.lower()]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def keyed(pairs: list[str]) -> dict:
    """Settings given as key=value."""
    out = {}
    for pair in pairs:
        key, sign, value = pair.partition("=")
        if not sign:
            raise SystemExit(f"{pair!r} is not of the form key=value")
        out[key.strip()] = coerce(value.strip())
    return out


def stats(df: DataFrame) -> dict:
    """The statistics of a loader's records."""
    if record_type(df) == "doc":
        return evaluate.corpus_stats(df, record_text(df)).first().asDict()
    subjects = [r.asDict() for r in evaluate.top_subjects(df).collect()]
    return evaluate.qa_stats(df).first().asDict() | {"top_subjects": subjects}


def run(spark: SparkSession, args: argparse.Namespace) -> dict | list:
    if args.command == "info":
        return {"spark": spark.version, "loaders": LOADERS.names(), "scorers": SCORERS.names(), "stages": STAGES.names()}
    if args.command == "data" and args.what == "list":
        return [{"name": n, "about": (LOADERS.get(n).__doc__ or "").split("\n")[0]} for n in LOADERS.names()]
    if args.command == "stage":
        plan = experiment.load(args.config)
        df = experiment.prepare(spark, plan, args.tables)
        if args.output:
            df.write.mode("overwrite").parquet(args.output)
            df = spark.read.parquet(args.output)
        return {"experiment": experiment.as_dict(plan), "n": df.count(), "written_to": args.output}
    df = LOADERS.get(args.source)(spark, args.tables)
    if args.limit is not None:
        df = df.orderBy("pos").limit(args.limit)
    if args.command == "data" and args.what == "stats":
        return stats(df)
    if args.command == "data":
        key = records.cache_key(args.source, "default", limit=args.limit)
        return {"written_to": records.write_cache(df, args.output, args.source, "train", key), "n": df.count()}
    if args.command == "eval":
        predicted = evaluate.predict(spark.read.parquet(args.scores))
        body = evaluate.report(predicted, evaluate.accuracy_by_subject(predicted), args.source, "train", args.model)
        if args.output:
            spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(args.output)
        return body
    df = df.withColumn("text", record_text(df, as_prompt=True))
    df = df.withColumn("cost", t.token_cost(F.col("text")))
    scorer = SCORERS.get(args.scorer)(**keyed(args.set)).fit(df)
    scored = scorer.transform(df)
    budget = select.parse_budget(args.budget)
    if args.group and args.tokens:
        chosen = select.stratified_cost(scored, args.group, budget, args.floor)
    elif args.group:
        chosen = select.stratified(scored, args.group, budget, args.floor)
    else:
        chosen = select.top_k_cost(scored, budget) if args.tokens else select.top_k(scored, budget)
    chosen = select.ranked(chosen.select("uid", "pos", "score", "cost"), F.desc("score"), F.asc("pos"))
    facts = {"source": args.source, "split": "train", "scorer": args.scorer, "budget": args.budget}
    if args.output:
        records.write_selection(chosen, args.output, **facts)
    n, tokens = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("cost"), F.lit(0))).first()
    return facts | {"n": n, "tokens": tokens, "written_to": args.output}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siftwell")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    stage = sub.add_parser("stage")
    stage.add_argument("--config", required=True, help="YAML file of the experiment")
    stage.add_argument("--tables", help="folder of the tables")
    stage.add_argument("--output")
    for name, *extra in (("data", "what"), ("select",), ("eval",)):
        cmd = sub.add_parser(name)
        if extra:
            cmd.add_argument("what", choices=("list", "stats", "prepare"))
        cmd.add_argument("--source", default="documents")
        cmd.add_argument("--tables", help="folder of the tables")
        cmd.add_argument("--limit", type=int)
        cmd.add_argument("--output")
        if name == "select":
            cmd.add_argument("--scorer", default="random")
            cmd.add_argument("--set", nargs="*", default=[], help="settings of the scorer, key=value")
            cmd.add_argument("--budget", required=True, help="a count, or a fraction with a point")
            cmd.add_argument("--tokens", action="store_true", help="the budget counts tokens")
            cmd.add_argument("--group", help="column to stratify by")
            cmd.add_argument("--floor", type=int, default=0)
        if name == "eval":
            cmd.add_argument("--scores", required=True, help="table of option scores: uid, answer_key, subject, key, total, n_tok")
            cmd.add_argument("--model", default="unnamed")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_spark()
    print(json.dumps(run(spark, args), indent=2, default=str))


if __name__ == "__main__":
    main()
