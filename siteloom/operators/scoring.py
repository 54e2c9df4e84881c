"""Scores of audits: penalties per category, a damped curve, the weighted overall score and its grade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import grade
from ..plans.topk import examples


def _map(d: dict):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def severity_counts(issues: DataFrame, key: list[str]) -> DataFrame:
    """``key``, errors, warnings, notices."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy(*key).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("notice").alias("notices"))


def category_scores(issues: DataFrame, pages: int | DataFrame) -> DataFrame:
    """``category, penalty, score`` for all categories, also those without issues. ``pages``: their number, or the pages."""
    spark = issues.sparkSession
    dim = spark.createDataFrame(list(dims.CATEGORY_WEIGHT.items()), "category string, weight double")
    penalty = issues.groupBy("category").agg(F.sum(_map(dims.SEVERITY_WEIGHT)[F.col("severity")]).alias("penalty"))
    count = pages.count() if isinstance(pages, DataFrame) else pages
    p = F.coalesce("penalty", F.lit(0))
    score = F.round(F.lit(10000) / (F.lit(100) + F.lit(dims.SCORE_CURVE) * p / F.lit(max(count, 1))))
    return dim.join(penalty, "category", "left").select(
        "category", "weight", p.cast("long").alias("penalty"), F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("long").alias("score")
    )


def overall_score(scores: DataFrame) -> DataFrame:
    """``score, grade``: the weighted mean of the categories."""
    return scores.agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).cast("long").alias("score")).select("score", grade(F.col("score")).alias("grade"))


def rollup(issues: DataFrame, urls: int = 5) -> DataFrame:
    """Issues grouped by severity, category and rule: how many, the detail of the first URL, and up to ``urls`` example URLs."""
    keys = ["severity", "category", "rule_id"]
    counts = issues.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("url", "detail")).alias("first"))
    return counts.select(*keys, "n", F.col("first.detail").alias("first_detail")).join(examples(issues.select(*keys, "url").distinct(), keys, "url", urls), keys)


def page_rank_by_issues(issues: DataFrame, key: list[str]) -> DataFrame:
    """Pages by 100 x errors + 10 x warnings + notices."""
    return severity_counts(issues, key).withColumn("weight", F.col("errors") * 100 + F.col("warnings") * 10 + F.col("notices"))
