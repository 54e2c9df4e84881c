"""Reading the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder that holds one ``name.parquet`` (file or directory) per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: a small table in one file would keep one core busy
    with all its texts. Tables with enough splits, so all large ones, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
