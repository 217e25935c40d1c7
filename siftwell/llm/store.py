"""Tables written to the shared folder of the session, to cut lineage between steps."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: A side of a join is broadcast only if its rows times their width are below this many bytes.
BROADCAST_LIMIT = 24 << 20


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that a lost executor costs one step."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwell_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete stashed tables that no later step reads, and let Spark drop the shuffle files of finished steps."""
    spark = SparkSession.getActiveSession()
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._siftwell_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # the frames of finished steps hold their shuffles
    spark._jvm.System.gc()


def _width(schema: T.StructType) -> int | None:
    """Bytes of a row in a hash table; None where a column has no fixed width."""
    if any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in schema.fields):
        return None
    return 24 + 8 * len(schema.fields)


def real_size(df: DataFrame) -> int:
    """Bytes that a stashed table takes in memory: its rows times their width, measured where columns vary."""
    width = _width(df.schema)
    if width is not None:
        return df.count() * width
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return rows * (24 + 8 * len(df.columns)) + 2 * size


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``small``, a stashed table, by broadcast if it is below ``BROADCAST_LIMIT``, else by sort and merge."""
    if real_size(small) <= BROADCAST_LIMIT:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


#: Keys that ``join_counted`` may broadcast: those that hold more than one row in so many.
HEAVY = 1 << 17


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], n: str = "_n") -> DataFrame:
    """Join ``rows`` with the stashed table ``counted``, which has one row a key and its number of rows ``n``.

    Keys with more than one row in ``HEAVY`` are fewer than ``HEAVY`` and are broadcast; the others are sorted and merged,
    and none of them is hot.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    limit = total // HEAVY + 1
    hot = counted.where(F.col(n) > limit)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counted.where(F.col(n) <= limit).hint("merge"), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)
