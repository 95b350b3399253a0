"""The folder that driver and executors share, and cutting lineage in loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session names none and runs in one process (tests), a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: the plan behind it is cut, and lost executors don't matter.

    A checkpoint keeps its plan's estimate of size, a product over joins: over the rounds of a loop that number gets millions
    of digits, which fills the driver. So the rows go on without it; joins are adapted to the sizes found at run time."""
    spark = df.sparkSession
    shared_dir(spark)
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(held.toJavaRDD(), held.schema()), spark)
