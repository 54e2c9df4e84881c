"""Sitemaps: locations in a fetched file, and recursive expansion of sitemap indexes."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_norm
from ..plans.lineage import stored


def locations(body: str | None) -> tuple[list[str], list[str]]:
    """(nested sitemaps, page URLs). Malformed XML and entity declarations give none."""
    if not body or "<!ENTITY" in body:
        return [], []
    try:
        root = ET.fromstring(body.encode())
    except (ET.ParseError, ValueError):
        return [], []
    loc = [(e.text or "").strip() for entry in root for e in entry if e.tag.rsplit("}", 1)[-1] == "loc"]
    kind = root.tag.rsplit("}", 1)[-1]
    return ([x for x in loc if x], []) if kind == "sitemapindex" else ([], [x for x in loc if x]) if kind == "urlset" else ([], [])


def entries(files: DataFrame) -> DataFrame:
    """``file, nested, url`` of ``files(url, body)``."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(u, nested, x) for u, b in zip(f["url"], f["body"]) for nested, xs in zip((True, False), locations(b)) for x in xs]
            yield pd.DataFrame(rows, columns=["file", "nested", "url"])

    return files.select("url", "body").mapInPandas(run, "file string, nested boolean, url string")


def expand(roots: DataFrame, files: DataFrame, depth: int = 3) -> DataFrame:
    """``url`` of all pages below the root sitemaps (``roots(url)``), at most ``depth`` levels of indexes; each file is read once."""
    e = stored(entries(files), "sitemap-entries")
    front = stored(roots.select(url_norm(F.col("url")).alias("file")).distinct(), "sitemap-front")
    seen = pages = None
    for _ in range(depth + 1):
        seen = front if seen is None else seen.unionByName(front)
        got = e.withColumn("f", url_norm(F.col("file"))).join(front.select(F.col("file").alias("f")), "f", "left_semi")
        new = got.filter("not nested").select("url")
        pages = new if pages is None else pages.unionByName(new)
        front = stored(got.filter("nested").select(url_norm(F.col("url")).alias("file")).distinct().join(seen, "file", "left_anti"), "sitemap-front")
        if front.isEmpty():
            break
    return pages.distinct()


def candidates(origins: DataFrame, listed: DataFrame) -> DataFrame:
    """``origin, url``: where sitemaps may be: what robots.txt lists (``listed(origin, url)``) and the usual two places."""
    usual = origins.select("origin", F.explode(F.array(F.concat("origin", F.lit("/sitemap.xml")), F.concat("origin", F.lit("/sitemap_index.xml")))).alias("url"))
    return listed.select("origin", "url").unionByName(usual).distinct()


def discovered(candidates_: DataFrame, fetches: DataFrame) -> DataFrame:
    """Candidates that answered with a sitemap: ``origin, url, body``. ``fetches(url, ok, body)``."""
    got = fetches.filter(F.col("ok") & F.col("body").rlike("(?i)<(urlset|sitemapindex)")).groupBy("url").agg(F.min("body").alias("body"))
    return candidates_.join(got, "url").select("origin", "url", "body")


def llms_files(origins: DataFrame, fetches: DataFrame) -> DataFrame:
    """``origin, has_llms``: whether /llms.txt answered with more than ten characters."""
    got = fetches.filter(F.col("ok") & (F.length(F.trim("body")) > 10)).select(F.col("url").alias("__u")).distinct()
    return origins.join(got.withColumn("has_llms", F.lit(True)), F.concat("origin", F.lit("/llms.txt")) == F.col("__u"), "left").select("origin", F.coalesce("has_llms", F.lit(False)).alias("has_llms"))
