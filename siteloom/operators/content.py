"""Content planning and scoring: plan by month, term profiles of reference texts, scores against them, briefs, batch ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..plans.lineage import stored
from ..plans.topk import examples, top


def plan(items: DataFrame, months: int = 6, per_month: int = 4) -> DataFrame:
    """``action, title, priority, place, month``: ``items(action, title, priority)`` without repeats of action and title (the highest priority
    stays). The first ``months x per_month`` have a place and their month; all others follow in the last month, without a place.

    Places come from a top-k, so no window goes over all rows.
    """
    once = stored(items.groupBy("action", "title").agg(F.max("priority").alias("priority")), "plan-items")
    best = once.orderBy(F.desc("priority"), "action", "title").limit(months * per_month)
    place = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "action", "title")))
    month = F.coalesce(F.floor((F.col("place") - 1) / per_month) + 1, F.lit(months)).cast("int")
    return once.join(F.broadcast(place.drop("priority")), ["action", "title"], "left").select("action", "title", "priority", "place", month.alias("month"))


def plan_items(clusters: DataFrame, topics: DataFrame, pages: DataFrame) -> DataFrame:
    """Union of new pages (``clusters(title, intent, local, keywords)``), pillars (``topics(label, size, has_pillar)``) and expansions (``pages(title, completeness)``)."""
    base = F.create_map(*[F.lit(x) for kv in {"transactional": 3.0, "informational": 2.2, "navigational": 1.0, "general": 2.0}.items() for x in kv])
    new = clusters.select(F.lit("new page").alias("action"), "title", (base[F.col("intent")] + F.when(F.col("local"), 0.4).otherwise(0.0) + F.least(F.lit(1.0), F.col("keywords") * 0.2)).alias("priority"))
    pillars = topics.filter((F.col("size") >= 3) & ~F.col("has_pillar")).select(F.lit("pillar").alias("action"), F.col("label").alias("title"), F.lit(3.2).alias("priority"))
    more = pages.filter(F.col("completeness") < 60).select(F.lit("expand").alias("action"), "title", (F.lit(2.5) + (F.lit(60) - F.col("completeness")) / 40).alias("priority"))
    return new.unionByName(pillars).unionByName(more)


def reference_terms(docs: DataFrame, grp: Column, doc: str, text: Column, share: float = 0.3, most: int = 40, least_words: int = 80) -> DataFrame:
    """``grp, term, df, weight, rank``: terms in at least max(2, ceil(share x n)) of a group's texts of ``least_words`` words, by summed tf-idf."""
    from .ir import tfidf

    some = docs.withColumn("__grp", grp).filter(F.col("__grp").isNotNull() & (X.word_count(text) >= least_words))
    w = tfidf(some, doc, text).join(some.select(F.col(doc).alias("doc"), F.col("__grp").alias("grp")), "doc")
    n = some.groupBy(F.col("__grp").alias("grp")).agg(F.count("*").alias("n")).filter("n >= 2")
    t = w.groupBy("grp", "term").agg(F.count("*").alias("df"), F.round(F.sum("weight"), 6).alias("weight")).join(n, "grp")
    t = t.filter(F.col("df") >= F.greatest(F.lit(2), F.ceil(F.col("n") * share - 1e-9))).drop("n")
    return top(t, ["grp"], [F.desc("weight"), F.col("term")], most)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, median``: element floor(n / 2) of the ascending values, counted over a histogram of values rather than a list."""
    hist = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    total = hist.groupBy(*keys).agg(F.sum("c").alias("n"))
    run = F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    at = hist.withColumn("upto", run).join(total, keys).filter(F.col("upto") > F.floor(F.col("n") / 2))
    return at.groupBy(*keys).agg(F.min(value).alias("median"))


def score_texts(docs: DataFrame, grp: Column, doc: str, text: Column, terms: DataFrame, target: DataFrame) -> DataFrame:
    """``grp, doc, coverage, words, score, grade``: 0.7 x share of the group's terms + 0.3 x length against ``target(grp, median)``."""
    d = docs.select(grp.alias("grp"), F.col(doc).alias("doc"), X.word_count(text).alias("words")).filter("grp is not null")
    want = terms.groupBy("grp").agg(F.count("*").alias("wanted"))
    tokens = X.token_rows(docs, [grp.alias("grp"), F.col(doc).alias("doc")], text)
    # the terms of a group are at most as many as its profile holds, so they are matched before repeats are dropped
    has = tokens.join(terms.select("grp", "term"), ["grp", "term"]).distinct().groupBy("grp", "doc").agg(F.count("*").alias("has"))
    j = d.join(want, "grp").join(target, "grp").join(has, ["grp", "doc"], "left")
    cover = F.coalesce("has", F.lit(0)) * 100 / F.col("wanted")
    score = F.round(cover * 0.7 + F.least(F.lit(1.0), F.col("words") / F.greatest("median", F.lit(1))) * 30).cast("long")
    return j.select("grp", "doc", F.round(cover).cast("long").alias("coverage"), "words", score.alias("score")).withColumn("grade", X.grade(F.col("score"), dims.CONTENT_GRADES))


def batch_ranking(scored: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` weakest texts of each group, weakest first."""
    return top(scored, ["grp"], [F.col("score"), F.col("doc")], k)


def outline(headings: DataFrame, grp: str, most: int = 6) -> DataFrame:
    """``grp, headings, questions``: up to ``most`` headings and question headings of a group, for a brief."""
    h = headings.filter(F.length("text") > 8).select(grp, F.lower(F.trim("text")).alias("text")).distinct()
    plain = examples(h.filter(~F.col("text").contains("?")), [grp], "text", most, "headings")
    return plain.join(examples(h.filter(F.col("text").contains("?")), [grp], "text", most, "questions"), grp, "full_outer")


def link_sources(pages: DataFrame, keyword: str, k: int = 8, least: float = 0.1) -> DataFrame:
    """Pages to link from: title and headings most similar to the keyword's tokens."""
    q = F.array_distinct(X.tokens(F.lit(keyword)))
    s = X.jaccard(q, F.array_distinct(X.tokens(F.concat_ws(" ", "title", "headings"))))
    return pages.select("page_id", F.round(s, 6).alias("similarity")).filter(F.col("similarity") > least).orderBy(F.desc("similarity"), "page_id").limit(k)


def link_opportunities(similar: DataFrame, linked: DataFrame) -> DataFrame:
    """``query, doc, cosine`` of similar documents that do not link to the query document yet (``linked(src, dst)``)."""
    return similar.join(linked.select(F.col("src").alias("doc"), F.col("dst").alias("query")).distinct(), ["query", "doc"], "left_anti")


def brief_targets(pages: DataFrame, headings: DataFrame, least: int = 800) -> DataFrame:
    """``grp, words, headings``: for each group of pages (``pages(grp, url, word_count)``) the length to aim at, that of its longest page and at least ``least``, and
    its different headings of more than six characters, equal ones by their normalised text (``headings(url, text)``)."""
    words = pages.groupBy("grp").agg(F.greatest(F.lit(least), F.max(F.coalesce("word_count", F.lit(0)))).alias("words"))
    h = headings.withColumn("text", F.trim("text")).filter(F.length("text") > 6).join(pages.select("grp", "url").distinct(), "url")
    one = h.groupBy("grp", X.normalized(F.col("text")).alias("key")).agg(F.min("text").alias("text"))
    return words.join(one.groupBy("grp").agg(F.sort_array(F.collect_list("text")).alias("headings")), "grp", "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<string>")))
