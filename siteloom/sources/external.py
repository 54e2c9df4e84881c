"""What outside services answered, as tables: search results, suggestions, and entities of knowledge bases. Nothing here calls a
service; an absent table is an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..plans.topk import top


def search_results(serp: DataFrame, most: int = 10) -> DataFrame:
    """``keyword, rank, url, title``: the first ``most`` different URLs of each keyword (``serp(keyword, rank, url, title)``), ranked anew."""
    first = serp.filter(F.length("url") > 0).groupBy("keyword", "url").agg(F.min(F.struct("rank", "title")).alias("x")).select("keyword", "url", "x.*")
    return top(first, ["keyword"], [F.col("rank"), F.col("url")], most, "place").select("keyword", F.col("place").alias("rank"), "url", "title")


def _key(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def suggestions(answers: DataFrame) -> DataFrame:
    """``seed, suggestion, kind, modifier``: different continuations of each seed (``answers(seed, query, suggestion)``), case aside, without the seed
    itself; ``kind`` is question or suggestion, ``modifier`` the first group of words that a suggestion holds, if any."""
    one = answers.filter(F.length(_key("suggestion")) > 0).groupBy("seed", _key("suggestion").alias("key")).agg(F.min("suggestion").alias("suggestion")).filter(F.col("key") != _key("seed"))
    asks = F.col("key").rlike(dims.ASKS) | F.col("key").contains("?")
    groups = [F.when(~asks & F.col("key").rlike(p), name) for name, p in dims.MODIFIERS.items()]
    return one.select("seed", "suggestion", F.when(asks, "question").otherwise("suggestion").alias("kind"), F.coalesce(*groups).alias("modifier"))


def entities(titles: DataFrame, terms: DataFrame, words: int = 4, most_titles: int = 80, most_terms: int = 25) -> DataFrame:
    """``keyword, entity, source``: titles that a knowledge base links with a keyword (``titles(keyword, title)``: short ones, without ``:``
    or brackets) and related terms (``terms(keyword, id)``: the last part of the path), each once without regard to case. At most
    ``most_titles`` and ``most_terms`` of a keyword, the first by name, as the services give them."""
    t = titles.filter(~F.col("title").rlike("[:()]") & (F.size(F.split(F.trim("title"), r"\s+")) <= words) & (F.length(F.trim("title")) > 0)).select("keyword", F.trim("title").alias("entity"), F.lit("titles").alias("source"))
    last = F.trim(F.replace(F.element_at(F.split("id", "/"), -1), F.lit("_"), F.lit(" ")))
    r = terms.select("keyword", last.alias("entity"), F.lit("terms").alias("source")).filter(F.length("entity") > 0)
    both = [top(d.distinct(), ["keyword"], [F.col("entity")], n).drop("rank") for d, n in ((t, most_titles), (r, most_terms))]
    every = both[0].unionByName(both[1])
    return every.groupBy("keyword", F.lower("entity").alias("k")).agg(F.min(F.struct(F.when(F.col("source") == "titles", 0).otherwise(1).alias("o"), "entity", "source")).alias("x")).select("keyword", "x.entity", "x.source")


def related(keyword_terms: DataFrame) -> DataFrame:
    """The first two tokens of each keyword: what a term base is asked for (``keyword, token``)."""
    return keyword_terms.select("keyword", F.explode(F.slice(X.tokens(F.col("keyword")), 1, 2)).alias("token"))
