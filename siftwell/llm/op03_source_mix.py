"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import unit_hash, words_of
from .store import join_small, stash

#: Weights of the sources in order, repeating; and the most copies of one document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of the hash, and of each level of the histogram.
HASH_BITS, LEVEL_BITS = 52, 13


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) of one row a source; ``sizes`` has source and size.

    Sources by code point with null last weigh ``weights``, repeating. The sum of all sizes times ``share`` is dealt by
    weight; no target is above ``most`` times its source's size, the excess going to the others by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    row = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), (row % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.select("*", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"), F.sum("w").over(after).alias("open"))
    full = F.col("cap") * F.col("open") <= F.col("w") * F.col("left")
    level = F.max(F.when(~full, F.struct(F.col("open"), (F.col("left") / F.col("open")).alias("of")))).over(everything)["of"]
    return per.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def _hash() -> Column:
    """The place of a document in its source: a hash of its id and text, so that null ids don't share one."""
    return unit_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")))


def _bounds(docs: DataFrame, weights: tuple[int, ...], most: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(sizes and hashes of the documents; of each source its target, whole copies and the hash below which one more is taken)."""
    sized = stash(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), _hash().alias("h")), "op3-sizes")
    goal = targets(sized, weights, most, share)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    goal = stash(goal.select(F.col("source").alias("of_source"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest")), "op3-goals")
    state = goal.select("of_source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("used"))
    shift = HASH_BITS
    while shift:
        rows = join_small_null(sized, state).where(F.shiftright("h", shift) == F.col("prefix"))
        shift = max(0, shift - LEVEL_BITS)
        hist = rows.groupBy("source", "rest", "used", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("b"))  # at most 2**LEVEL_BITS rows a source
        hist = hist.select("*", (F.col("used") + run).alias("upto")).where("upto > rest")
        first = hist.groupBy("source", "rest").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("used"), "upto")).alias("x"))
        state = stash(first.select(F.col("source").alias("of_source"), "rest", F.col("x.b").alias("prefix"), F.col("x.used").alias("used"), F.col("x.upto").alias("upto")), "op3-level")
    near = (F.col("upto") - F.col("rest") < F.col("rest") - F.col("used")).cast("long")
    edge = state.select("of_source", (F.col("prefix") + near).alias("below"))
    bound = goal.alias("g").join(edge.alias("e"), F.col("g.of_source").eqNullSafe(F.col("e.of_source")), "left").select("g.of_source", "g.source_size", "g.target", "g.whole", F.coalesce("e.below", F.lit(0)).alias("below"))
    return sized, stash(bound, "op3-bounds")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and, last, mix_copies (in place of a column of that
    name); as ``mix`` otherwise."""
    _, bound = _bounds(docs, weights, most, share)
    held = docs.select(F.struct("*").alias("_row"), "source", _hash().alias("h"), F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("some"))
    rows = join_small_null(held, bound).withColumn("mix_copies", F.when(F.col("some"), F.col("whole") + (F.col("h") < F.col("below")).cast("long")).otherwise(0))
    return rows.where("mix_copies > 0").select(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "mix_copies"], "mix_copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """How many words the mix takes from each document.

    ``docs`` has doc_id, text, source. A source whose target is q times its size and a rest gives every document q
    times, and once more those documents whose id and text hash below the source's threshold: token sums by hash bucket find
    the bucket in which the rest is used up, and only that bucket is split further, until one hash value is left,
    which is in if that comes nearer to the target. Result: doc_id, size, source_size, target, taken, copies, source;
    one row a row. A null or empty text has size 0 and takes 0; a null source is a source of its own, last; rows of
    equal id and text share their fate within a source; reruns agree; an empty table gives an empty result.
    """
    sized, bound = _bounds(docs, weights, most, share)
    out = join_small_null(sized, bound)
    copies = F.col("whole") + F.when(F.col("size") > 0, (F.col("h") < F.col("below")).cast("long")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def join_small_null(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with what their source has, null matching null."""
    keyed = lambda df, c: df.withColumn("_none", F.col(c).isNull()).withColumn("_key", F.coalesce(F.col(c), F.lit("")))
    return join_small(keyed(rows, "source"), keyed(per_source, "of_source"), ["_none", "_key"]).drop("_none", "_key", "of_source")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("copies", "source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    concat('0x', substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 13))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rem,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM s1),
s3 AS (SELECT *, cap * op <= w * rem AS full_ FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * max_by(rem / op, CASE WHEN full_ THEN NULL ELSE op END) OVER () END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS q FROM s4),
s6 AS (SELECT *, target - q * source_size AS rest FROM s5),
g AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, s6.rest, sum(n) OVER (PARTITION BY g.source ORDER BY h)::BIGINT AS upto, n FROM g JOIN s6 ON g.source IS NOT DISTINCT FROM s6.source),
e AS (SELECT source, min(h) AS h, min_by(upto - rest < rest - (upto - n), h)::INT AS near FROM c WHERE upto > rest GROUP BY source)
SELECT d.doc_id, d.size, s6.source_size, s6.target, (s6.q + CASE WHEN d.h < coalesce(e.h + e.near, 0) THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
