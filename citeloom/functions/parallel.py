"""Spreading small inputs over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df with as many partitions as there are cores, if its scan would give fewer; larger inputs are left as they are.

    Work per row in Python is worth a shuffle of an input that is no larger than a split per core. Only the plan's statistics and the
    names of few files are looked at, nothing runs.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= want * split or len(df.inputFiles()) >= want:
        return df
    return df.repartition(want)
