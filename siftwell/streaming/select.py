"""Selection over Structured Streaming: bounded state of the best rows so far, folded in batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scorers import Scorer
from ..operators.select import allocate_quotas
from ..session import shared_dir


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siftwell-stream-{uuid.uuid4().hex}"


def read_documents(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """``documents`` as a stream of text records."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/documents.parquet*")
    return d.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("uid"), "text", "lang", F.col("doc_id").alias("pos"))


class TopKState:
    """The best ``capacity`` rows of each group, group counts and running score statistics, in a table per batch.

    Batch n writes version n from version n-1, so a repeated batch gives the same state.
    """

    def __init__(self, spark: SparkSession, capacity: int, group: str | None = None) -> None:
        self.spark, self.capacity, self.group, self.root, self.last = spark, capacity, group, _shared(spark), None

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        scored = batch.select("uid", "score", "pos", (F.col(self.group) if self.group else F.lit("all")).alias("grp")).persist()  # for both tables
        rows, stats = scored, scored.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.min("score").alias("least"), F.max("score").alias("most"))
        if self.last is not None:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(f"{self.root}/top-{self.last}"))
            stats = stats.unionByName(self.spark.read.schema(stats.schema).parquet(f"{self.root}/stats-{self.last}"))
            stats = stats.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
        w = Window.partitionBy("grp").orderBy(F.desc("score"), "pos")
        rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= self.capacity).drop("_r").write.mode("overwrite").parquet(f"{self.root}/top-{batch_id}")
        stats.write.mode("overwrite").parquet(f"{self.root}/stats-{batch_id}")
        scored.unpersist()
        self.last = batch_id

    def top(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/top-{self.last}")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/stats-{self.last}")


def select_stream(stream: DataFrame, scorer: Scorer, budget: int, group: str | None = None, prefix: DataFrame | None = None, fit_size: int = 10_000) -> TopKState:
    """Run a finite stream to its end; the state then holds all that a selection of up to ``budget`` records needs.

    ``prefix`` is the stream's source read as a table: the scorer is fitted on its first ``fit_size`` records, which the
    stream then scores again with all others.
    """
    if not isinstance(budget, int) or isinstance(budget, bool):
        raise ValueError("a stream needs a whole number of records as its budget")
    if not scorer.streams:
        raise ValueError("this scorer ranks within a pool and cannot stream")
    if prefix is not None:
        scorer.fit(prefix.orderBy("pos").limit(fit_size))
    state = TopKState(stream.sparkSession, budget, group)
    query = stream.writeStream.foreachBatch(lambda batch, n: state.fold(scorer.transform(batch), n)).option("checkpointLocation", f"{state.root}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return state


def ranked(state: TopKState) -> DataFrame:
    w = Window.orderBy(F.desc("score"), "pos")  # at most the budget's rows
    return state.top().select("uid", "score", "pos", F.row_number().over(w).alias("rank")).where(F.col("rank") <= state.capacity)


def stratified(state: TopKState, floor: int = 0) -> DataFrame:
    sizes = {r.grp: r.n for r in state.stats().collect()}  # one row a group
    quota = allocate_quotas(sizes, min(state.capacity, sum(sizes.values())), floor)
    limits = state.spark.createDataFrame(list(quota.items()), "grp string, quota int")
    w = Window.partitionBy("grp").orderBy(F.desc("score"), "pos")
    return state.top().join(F.broadcast(limits), "grp").withColumn("_r", F.row_number().over(w)).where("_r <= quota").select("uid", "grp", "score", "pos")
