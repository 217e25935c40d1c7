"""A corpus pipeline of five stages, each calling one operator of ``siftwell.llm``.

Each stage takes and returns documents with all their columns (the last adds mix_copies); a column of its own name in the
input is kept. Null and empty texts are never toxic, near duplicates, leaks or secrets, and are left out by the mix, which
takes no words from them; rows with one id and text are one document and one of them stays; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import op03_source_mix, op06_toxicity, op07_secret_scan, op08_jaccard_join, op09_decontaminate
from siftwell.llm.store import free, stash
from siftwell.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return op06_toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates stays."""
    ship(spark)
    return op08_jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op09_decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return op07_secret_scan.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with mix_copies."""
    return op03_source_mix.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("source_mix", mix_sources),
]

#: SQL can't express the stages that learn a model; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    kept = None
    for name, stage in STAGES[:-1]:
        last, kept = kept, stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            free(last)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
