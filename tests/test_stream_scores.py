"""How often a stream scores its records."""

from pyspark.sql import functions as F

from siftwell.streaming import select as streaming


def test_a_stream_scores_each_record_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        seen.add(1)
        return float(x)

    for n in range(3):
        batch = spark.range(10 * n, 10 * n + 10).select(F.col("id").cast("string").alias("uid"), F.col("id").alias("pos"), score("id").alias("score"))
        state = state if n else streaming.TopKState(spark, 4)  # noqa: F821
        state.fold(batch, n)
    assert [r.uid for r in streaming.ranked(state).orderBy("rank").collect()] == ["29", "28", "27", "26"]
    assert state.stats().first().n == 30 and seen.value == 30
