"""Cutting lineage in loops."""

from pyspark.sql import functions as F

from netlex.functions.shared import settle


def test_estimates_do_not_grow_over_rounds(spark):
    df = settle(spark.range(50).select(F.col("id").alias("a"), F.lit("x").alias("s"), F.array("id").alias("l"), F.struct("id").alias("t")))
    want = sorted(df.collect())
    for _ in range(6):
        other = df.select("a", F.col("a").alias("b"))
        df = settle(df.join(other, "a").join(other.withColumnRenamed("b", "c"), "a").select("a", "s", "l", "t"))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size).bit_length() <= 64 and sorted(df.collect()) == want
