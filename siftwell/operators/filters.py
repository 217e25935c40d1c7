"""Filters, first-wins dedup and the joins that keep or drop records by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def min_chars(df: DataFrame, least: int = 200) -> DataFrame:
    """Records whose text has ``least`` characters or more, white space at its ends not counted."""
    return df.where(F.length(strip(F.col("text"))) >= least)


def dedup_first(df: DataFrame, key: str) -> DataFrame:
    """The first record of each key in pool order; records without a key all stay."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("pos").alias("pos")).select("pos")  # combined before the shuffle
    return df.where(F.col(key).isNotNull()).join(first, "pos", "left_semi").unionByName(df.where(F.col(key).isNull()))


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Records whose key is not among ``ids``; records without a key stay."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def corpus_filter(df: DataFrame, excluded: DataFrame, key: str, dedup_key: str, least: int = 200, limit: int | None = None) -> DataFrame:
    """Exclusion, then dedup, then length: a short first copy still hides a long later one; then the first ``limit``."""
    out = min_chars(dedup_first(exclude(df, excluded, key), dedup_key), least)
    return out if limit is None else out.orderBy("pos").limit(limit)


def apply_selection(pool: DataFrame, selected: DataFrame, source: str | None = None, split: str | None = None) -> DataFrame:
    """The pool's records named by a manifest, in pool order; unknown or no uids are refused, and so is a manifest whose
    columns source and split, where it has them, are not those given."""
    for name, want in (("source", source), ("split", split)):
        if want is not None and name in selected.columns and (other := selected.where(F.col(name) != want).select(name).first()):
            raise ValueError(f"the selection is of {name} {other[0]!r}, not {want!r}")
    wanted = selected.select("uid").distinct()
    missing = wanted.join(pool, "uid", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"{missing[0].uid} is not in the pool")
    if wanted.isEmpty():
        raise ValueError("the selection is empty")
    return pool.join(wanted, "uid", "left_semi").orderBy("pos")


def good_question(options: Column, question: Column) -> Column:
    """A question of ten characters and two different options, none of them blank."""
    values = F.map_values(options)
    return F.coalesce((F.length(strip(question)) >= 10) & (F.size(F.array_distinct(values)) >= 2) & ~F.exists(values, lambda v: strip(v) == ""), F.lit(False))


def split_slice(spec: str) -> tuple[str, int, float]:
    """Name and half-open range of ``name[a:b]``; the whole split without a range."""
    name, _, rest = spec.partition("[")
    if not rest:
        return name, 0, float("inf")
    a, _, b = rest.rstrip("]").partition(":")
    return name, int(a or 0), float(b) if b else float("inf")


def slices_overlap(one: str, other: str) -> bool:
    (n, a, b), (m, c, d) = split_slice(one), split_slice(other)
    return n == m and max(a, c) < min(b, d)
