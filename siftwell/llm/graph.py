"""Connected components by label propagation with pointer jumping, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free, stash


def components(links: DataFrame, tag: str) -> DataFrame:
    """A stashed table (id, label, old): the smallest id reachable over ``links`` (a, b), for every id that has a link."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stash(both, f"{tag}-links")
    table = stash(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), f"{tag}-label")
    while True:
        label = table.select("id", "label")
        seen = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(seen, F.col("id") == F.col("a")).select("id", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        step = stash(step, f"{tag}-step")
        jump = step.select(F.col("id").alias("of"), F.col("next").alias("root"))
        new = stash(step.join(jump, F.col("next") == F.col("of"), "left").select("id", F.coalesce(F.least("next", "root"), "next").alias("label"), "old"), f"{tag}-label")
        done = new.where("label != old").isEmpty()
        free(step, table)
        table = new
        if done:
            free(both)
            return table
