"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_PARTS of all rows; so at most HOT_PARTS keys can be hot.
HOT_PARTS = 2000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """``rows`` left-joined to ``table``, which is unique on ``keys`` and has in ``weight`` (at least) the number of rows of each key.

    Keys with more than ``total / HOT_PARTS`` rows are broadcast. As the weights sum to ``total``, there are at most
    HOT_PARTS of them, whatever the size of the data. Their rows are then shuffled by ``spread`` instead of by the key,
    so no task receives a whole hot key; all other keys are shuffled and joined as usual.
    """
    hot_at = max(1, total // HOT_PARTS)
    hot = table.filter(F.col(weight) > hot_at).select(*keys, *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__hot"))
    cold = table.filter(F.col(weight) <= hot_at).select(*keys, *values, F.lit(0).alias("__salt"))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int") + 1).otherwise(0)
    )
    joined = marked.join(cold, [*keys, "__salt"], "left")
    return joined.select(
        *[c for c in rows.columns], *[F.coalesce(F.col(f"__hot_{v}"), F.col(v)).alias(v) for v in values]
    )
