"""robots.txt: parsing into rules, and admission of URLs by the longest matching pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import origin_of, path_of, robots_regex

SCHEMA = "origin string, group_no int, agents array<string>, rule_no int, type string, path string"


def parse(text: str | None) -> tuple[list[tuple[int, list[str], int, str, str]], list[str]]:
    """(rules as (group, agents, number, type, path), sitemaps). Agent lines in a row share a group until a rule follows."""
    rules, sitemaps, agents, group, number, open_ = [], [], [], -1, 0, False
    for line in (text or "").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not open_:
                agents, group, open_ = [], group + 1, True
            agents.append(value.lower())
        elif name in ("allow", "disallow", "crawl-delay"):
            open_ = False
            if agents:
                rules.append((group, list(agents), number, name, value))
                number += 1
        elif name == "sitemap":
            sitemaps.append(value)
    return rules, sitemaps


def rules(robots: DataFrame) -> DataFrame:
    """Rules of ``robots(origin, raw)``; a null or empty file has none."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(o, g, a, n, t, p) for o, raw in zip(f["origin"], f["raw"]) for g, a, n, t, p in parse(raw)[0]]
            yield pd.DataFrame(rows, columns=["origin", "group_no", "agents", "rule_no", "type", "path"])

    return robots.select("origin", "raw").mapInPandas(run, SCHEMA)


def for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """Of each origin the rules of the first group that names a part of ``agent``, else of the group for all."""
    name = agent.lower()
    named = F.exists("agents", lambda a: (a != "*") & (a != "") & F.lit(name).contains(a))
    every = F.array_contains("agents", "*")
    rank = F.when(named, F.struct(F.lit(0).alias("r"), "group_no")).when(every, F.struct(F.lit(1).alias("r"), "group_no"))
    chosen = rules.withColumn("g", rank).filter("g is not null")
    best = chosen.groupBy("origin").agg(F.min("g").alias("g"))
    return chosen.join(best, ["origin", "g"]).drop("g")


def admitted(urls: DataFrame, rules: DataFrame, url: Column | None = None) -> DataFrame:
    """``urls`` with ``allowed``: the longest matching pattern decides, the first of equal length; allowed if none matches.

    ``rules`` are those of one agent (``for_agent``); they are gathered per origin, so each URL meets its own origin's only.
    """
    u = url if url is not None else F.col("url")
    lists = rules.filter(F.col("type").isin("allow", "disallow") & (F.col("path") != "")).groupBy("origin").agg(
        F.collect_list(F.struct(F.length("path").alias("n"), (-F.col("rule_no")).alias("r"), (F.col("type") == "allow").alias("ok"), robots_regex(F.col("path")).alias("re"))).alias("rules")
    )
    path = path_of(u)
    hit = F.array_max(F.filter("rules", lambda x: F.regexp_like(path, x["re"])))
    return urls.withColumn("__o", origin_of(u)).join(lists, F.col("__o") == F.col("origin"), "left").withColumn("allowed", F.coalesce(hit["ok"], F.lit(True))).drop("__o", "origin", "rules")
