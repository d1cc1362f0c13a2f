"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Inputs below this size may be spread over all cores; larger ones have enough splits of their own.
SMALL_INPUT = 1 << 30


def spread_small(df: DataFrame) -> DataFrame:
    """Give a small input one partition per core.

    A file with a single row group is read by one task, which then does all
    the text work.  The size comes from the plan statistics, so an input above
    ``SMALL_INPUT`` is never shuffled by this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SMALL_INPUT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
