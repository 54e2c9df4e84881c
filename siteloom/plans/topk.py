"""Bounded collections per key: the limit is applied before the shuffle (window group limit), so hot keys stay small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, which must be total for a stable result."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def examples(df: DataFrame, keys: list[str], value: str, k: int, name: str = "examples") -> DataFrame:
    """``keys`` and the array of their ``k`` least values."""
    return top(df, keys, [F.col(value)], k, "__rank").groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))
