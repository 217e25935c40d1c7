"""Queries opN_<name> and pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import op01_suffix_dedup as op1
from . import op02_substring_dedup as op2
from . import op03_source_mix as op3
from . import op04_language_id as op4
from . import op05_lm_score as op5
from . import op06_toxicity as op6
from . import op07_secret_scan as op7
from . import op08_jaccard_join as op8
from . import op09_decontaminate as op9
from . import op10_quality_rules as op10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    docs = lambda s, d: _table(s, d, "documents")
    return {
        "op1_suffix_dedup": lambda s, d: op1.digest(docs(s, d)),
        "op2_substring_dedup": lambda s, d: op2.substring_dedup(docs(s, d)),
        "op3_source_mix": lambda s, d: op3.digest(docs(s, d)),
        "op4_language_id": lambda s, d: op4.identify(docs(s, d)),
        "op5_lm_score": lambda s, d: op5.score(docs(s, d)),
        "op6_toxicity": lambda s, d: op6.toxicity(docs(s, d), _table(s, d, "labels")),
        "op7_secret_scan": lambda s, d: op7.digest(docs(s, d)),
        "op8_jaccard_join": lambda s, d: op8.near_duplicates(docs(s, d)),
        "op9_decontaminate": lambda s, d: op9.leaks(docs(s, d), _table(s, d, "benchmark")),
        "pipeline": corpus_pipeline.run,
        "op10_quality_rules": lambda s, d: op10.quality(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": op2.ORACLE, "op3_source_mix": op3.ORACLE, "op8_jaccard_join": op8.ORACLE, "op9_decontaminate": op9.ORACLE, "op10_quality_rules": op10.ORACLE}
