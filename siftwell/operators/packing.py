"""Token blocks of equal size from documents in pool order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

EOS = "</s>"


def offsets(docs: DataFrame, tokens: Column, slice_rows: int = 100_000) -> DataFrame:
    """``docs`` with ``toks`` (an end mark last) and ``start``, the tokens before them in pool order.

    Running sums are taken within slices of ``slice_rows`` positions and joined with the sums of the slices before.
    """
    toks = F.concat(tokens, F.array(F.lit(EOS)))
    rows = written(docs.select("pos", F.floor(F.col("pos") / slice_rows).alias("part"), F.size(toks).alias("n")), "sizes")
    sums = rows.groupBy("part").agg(F.sum("n").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.withColumn("inner", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(before), "part").select("pos", (F.col("inner") + F.col("base")).alias("start"))
    return docs.select("uid", "pos", toks.alias("toks")).join(starts, "pos").select("uid", "pos", "toks", "start")


def pack_to_dataset(docs: DataFrame, tokens: Column, block_size: int = 1024, keep_rest: bool = False) -> DataFrame:
    """``pack`` with input_ids and labels alike; a corpus too small for one block is refused."""
    blocks = pack(docs, tokens, block_size, keep_rest)
    if blocks.limit(1).count() == 0:
        raise ValueError(f"the corpus has fewer than {block_size} tokens, so there is no block")
    return blocks.select("block", F.col("tokens").alias("input_ids"), F.col("tokens").alias("labels"))


def pack(docs: DataFrame, tokens: Column, block_size: int = 1024, keep_rest: bool = False) -> DataFrame:
    """(block, tokens): arrays of exactly ``block_size`` tokens; the rest at the end is dropped unless asked for.

    Documents are cut into one piece a block before anything is shuffled, so a long document is spread over tasks.
    """
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    at = offsets(docs, tokens)
    first, last = F.floor(F.col("start") / block_size), F.floor((F.col("start") + F.size("toks") - 1) / block_size)
    pieces = at.select("start", "toks", F.explode(F.sequence(first, last)).alias("block"))
    a = F.greatest(F.lit(0), F.col("block") * block_size - F.col("start")).cast("int")
    b = F.least(F.size("toks").cast("long"), (F.col("block") + 1) * block_size - F.col("start")).cast("int")
    pieces = pieces.select("block", F.struct("start", F.slice("toks", a + 1, b - a).alias("part")).alias("x"))
    blocks = pieces.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"])).alias("tokens"))
    return blocks if keep_rest else blocks.where(F.size("tokens") == block_size)
