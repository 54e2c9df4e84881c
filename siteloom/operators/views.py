"""Views of an audit: filters, search and orders of issues, pages, categories and topic pages; totals of a topic graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from .scoring import page_rank_by_issues

ORDERS = ("issues", "status", "time")


def with_severity(issues: DataFrame, severity: str | None = None) -> DataFrame:
    """Issues of one severity; all without one."""
    return issues if severity is None else issues.filter(F.col("severity") == severity)


def repeated_issues(issues: DataFrame) -> DataFrame:
    """``severity, rule_id, pages``: on how many pages each issue stands."""
    return issues.groupBy("severity", "rule_id").agg(F.count_distinct("url").alias("pages"))


def search_pages(pages: DataFrame, issues: DataFrame, words: str = "", order: str = "issues") -> DataFrame:
    """``pages(page_id, url, status, response_time_ms)`` whose URL holds ``words`` (case aside), with their issue weight, in the order of
    most issues, highest status or longest time (ties: page_id)."""
    if order not in ORDERS:
        raise ValueError(f"order is one of {ORDERS}")
    weight = page_rank_by_issues(issues, ["page_id"]).select("page_id", "weight")
    some = pages.filter(F.contains(F.lower("url"), F.lit(words.lower()))).join(weight, "page_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    return some.orderBy(F.desc({"issues": "weight", "status": "status", "time": "response_time_ms"}[order]), "page_id")


def categories_by_score(scores: DataFrame) -> DataFrame:
    """Categories, the weakest first."""
    return scores.orderBy("score", "category")


def topic_pages(pages: DataFrame, words: str = "") -> DataFrame:
    """``pages(type, title, url, topic, completeness)`` whose title holds ``words`` (case aside), by kind of page, the least complete first (unknown
    last), then by URL: the rows of a content checklist."""
    rank = F.coalesce(*[F.when(F.col("type") == t, i) for i, t in enumerate(dims.TYPE_ORDER.split())], F.lit(len(dims.TYPE_ORDER.split())))
    some = pages.filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(words.lower())))
    return some.orderBy(rank, F.coalesce("completeness", F.lit(101)), "url")


def type_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("type").agg(F.count("*").alias("pages"))


def graph_totals(topics: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per site: topics, their pages, topics covered well (70 or more), pillars missing, average coverage, gaps. ``topics`` as of ``topics.metrics``."""
    t = topics.groupBy("site").agg(
        F.count("*").alias("topics"), F.sum("size").alias("pages"), F.count_if(F.col("coverage") >= 70).alias("well_covered"), F.count_if(~F.col("has_pillar") & (F.col("size") >= 3)).alias("pillars_missing"), F.round(F.avg("coverage")).cast("long").alias("coverage")
    )
    g = gaps.groupBy("site").agg(F.count("*").alias("gaps"))
    return t.join(g, "site", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
