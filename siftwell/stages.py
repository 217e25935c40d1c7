"""Data assembly of the training stages: what a stage reads, with the checks before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as t
from .operators import filters, packing
from .sources.registry import Registry

STAGES = Registry("stage")


def record_type(records: DataFrame) -> str:
    return "qa" if "options" in records.columns else "doc"


def has_labels(records: DataFrame) -> bool:
    """Whether any record has an answer."""
    return record_type(records) == "qa" and not records.where("answer_key is not null").isEmpty()


def _need(records: DataFrame, kind: str, stage: str) -> None:
    if record_type(records) != kind:
        raise ValueError(f"the stage {stage} reads {kind} records, not {record_type(records)}")


def record_text(records: DataFrame, as_prompt: bool = False) -> Column:
    """The text a scorer sees: of documents title and text, of questions the question or the whole prompt."""
    if record_type(records) == "doc":
        return t.full_text(F.col("title"), F.col("text"))
    return t.render_prompt(F.col("question"), F.col("options"), F.col("contexts")) if as_prompt else F.col("question")


@STAGES.register("cpt")
def cpt_prepare(docs: DataFrame, selection: DataFrame | None = None, block_size: int = 1024, keep_rest: bool = False, source: str | None = None, split: str | None = None) -> DataFrame:
    """Token blocks of the selected documents."""
    _need(docs, "doc", "cpt")
    docs = docs if selection is None else filters.apply_selection(docs, selection, source, split)
    return packing.pack_to_dataset(docs, t.tokens(record_text(docs)), block_size, keep_rest)


@STAGES.register("sft")
def sft_prepare(qa: DataFrame, selection: DataFrame | None = None, rationale: bool = True, source: str | None = None, split: str | None = None) -> DataFrame:
    """Prompt, completion and their tokens of every labelled question."""
    _need(qa, "qa", "sft")
    if not has_labels(qa):
        raise ValueError("these questions have no answers to train on")
    qa = qa if selection is None else filters.apply_selection(qa, selection, source, split)
    prompt = t.render_prompt(F.col("question"), F.col("options"), F.col("contexts"))
    completion = t.render_completion(F.col("answer_key"), F.col("rationale") if rationale else None)
    rows = qa.where("answer_key is not null").select("uid", prompt.alias("prompt"), completion.alias("completion"))
    return rows.withColumn("cost", t.token_cost(F.concat("prompt", "completion")))


@STAGES.register("align")
def align_prepare(*_) -> DataFrame:
    raise NotImplementedError("there is no data assembly for alignment")


def target_texts(qa: DataFrame, limit: int = 2000, completion: bool = False) -> DataFrame:
    """(uid, text) of the first ``limit`` questions as prompts; with ``completion``, of labelled ones with their answers."""
    prompt = t.render_prompt(F.col("question"), F.col("options"), F.col("contexts"))
    if completion:
        qa = qa.where("answer_key is not null")
        prompt = F.concat(prompt, t.render_completion(F.col("answer_key"), F.col("rationale")))
    out = qa.orderBy("pos").limit(limit).select("uid", prompt.alias("text"))
    if out.isEmpty():
        raise ValueError("the target has no texts")
    return out
