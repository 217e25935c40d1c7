"""Tables that grow by key, id sets of several configurations, and space checks."""

from __future__ import annotations

import shutil
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_bytes


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class KeyedCache:
    """Results by uid, kept in ``root`` in parts such as (kind, epoch): what is there is not computed again.

    Serves metrics and gradients alike. A run that ends early leaves whole batches, and the next one computes the rest.
    """

    def __init__(self, spark: SparkSession, root: str, **part) -> None:
        self.spark, self.path = spark, "/".join([root, *(f"{k}={v}" for k, v in sorted(part.items()))])

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path).dropDuplicates(["uid"]) if _exists(self.spark, self.path) else None

    def missing(self, pool: DataFrame) -> DataFrame:
        have = self.read()
        return pool if have is None else pool.join(have.select("uid"), "uid", "left_anti")

    def complete(self, pool: DataFrame, compute) -> DataFrame:
        """``pool`` with its results by uid; ``compute`` gets the records that have none yet."""
        compute(self.missing(pool)).write.mode("append").parquet(self.path)
        return pool.join(self.read(), "uid", "left")


def union_of_ids(tables: dict[str, DataFrame], column: str, configs: list[str]) -> DataFrame:
    """Distinct ids, nulls left out, over the named configurations; no or unknown names are refused."""
    if not configs:
        raise ValueError("no configuration is named")
    if unknown := sorted(set(configs) - set(tables)):
        raise ValueError(f"unknown configurations {', '.join(unknown)}; available: {', '.join(sorted(tables))}")
    every = reduce(DataFrame.unionByName, [tables[c].select(column) for c in sorted(set(configs))])
    return every.where(F.col(column).isNotNull()).distinct()


def cached_ids(spark: SparkSession, root: str, tables: dict[str, DataFrame], column: str, configs: list[str], refresh: bool = False) -> DataFrame:
    """``union_of_ids``, written once for each set of configurations."""
    path = f"{root}/ids-{'+'.join(sorted(set(configs)))}.parquet"
    if refresh or not _exists(spark, path):
        union_of_ids(tables, column, configs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stored_bytes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """n and bytes of the files at ``paths``, from their listing alone."""
    files = spark.read.format("binaryFile").load(paths).select("length")
    return files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def require_space(spark: SparkSession, folder: str, need: int, spare: float = 0.2) -> None:
    """Refuse a download that leaves less than a fifth more than it needs."""
    free, wanted = shutil.disk_usage(folder).free, int(need * (1 + spare))
    if free < wanted:
        sizes = spark.range(1).select(human_bytes(F.lit(wanted)).alias("a"), human_bytes(F.lit(free)).alias("b")).first()
        raise OSError(f"{sizes.a} are needed in {folder}, {sizes.b} are free")
