"""Rule columns from the stored tables (page_facts, fetches, headings, links), for pages whose HTML was not kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.urls import path_of, query_of

PAGE_COLUMNS = ("page_id", "audit_id", "url", "depth", "status", "title", "meta_description", "html_lang", "word_count", "avg_sentence_length", "readability", "internal_link_count", "external_link_count")


def answers(fetches: DataFrame) -> DataFrame:
    """One row per fetch: exact repeats are dropped by (url, fetched_at)."""
    h = lambda n: F.col("headers").getItem(n)
    return fetches.groupBy("url", "fetched_at").agg(
        F.max("final_url").alias("final_url"), F.max("response_time_ms").alias("response_time_ms"), F.max("bytes").alias("html_size"),
        F.max(F.size("redirect_chain")).cast("long").alias("hops"), F.max(F.size(F.filter("redirect_chain", lambda x: x["status"].isin(302, 303, 307)))).cast("long").alias("temporary_hops"),
        F.max(F.size("headers") > 0).alias("has_headers"), F.max(h("cache-control")).alias("cache_control"), F.max(h("strict-transport-security")).alias("hsts"),
        F.max(F.coalesce(h("content-encoding").rlike("gzip|br|deflate"), F.lit(False))).alias("compressed"), F.max(F.coalesce(F.lower(h("x-robots-tag")).contains("noindex"), F.lit(False))).alias("noindex"),
    )


def heading_counts(headings: DataFrame) -> DataFrame:
    """Per URL: h1 headings, section headings, the first level that skips one, question headings."""
    h = headings.filter(F.trim("text") != "")
    level = lambda i: F.count_if(F.col("level") == i)
    g = h.groupBy("url").agg(*[level(i).alias(f"h{i}") for i in range(1, 7)], F.count_if(F.col("level").between(2, 4) & F.trim("text").endswith("?")).alias("question_headings"))
    skip = F.coalesce(*[F.when((F.col(f"h{i}") > 0) & (F.col(f"h{i - 1}") == 0) & (F.col("h1") > 0), i) for i in range(2, 7)], F.lit(0))
    return g.select("url", F.col("h1").alias("h1_count"), (F.col("h2") + F.col("h3")).alias("section_headings"), skip.cast("long").alias("heading_skip"), "question_headings")


def anchor_counts(links: DataFrame) -> DataFrame:
    """Per source URL: internal and external links, blank and generic internal anchors, authority links."""
    one = links.select("src_url", "pos", "href", "text", "nofollow", "internal").distinct()
    generic = F.trim("text").rlike("(?i)" + dims.GENERIC_ANCHOR)
    authority = ~F.col("internal") & F.col("href").rlike("(?i)" + dims.AUTHORITY)
    return one.groupBy(F.col("src_url").alias("url")).agg(
        F.count_if("internal").alias("kept_internal"), F.count_if(~F.col("internal")).alias("kept_external"), F.count_if(F.col("internal") & (F.trim(F.coalesce("text", F.lit(""))) == "")).alias("blank_anchors"),
        F.count_if(F.col("internal") & generic).alias("generic_anchors"), F.count_if(authority).alias("authority_links"), F.count_if(authority & ~F.col("nofollow")).alias("authority_follow"),
    )


def table_facts(pages: DataFrame, fetches: DataFrame, headings: DataFrame, links: DataFrame) -> DataFrame:
    """One row per page with all rule columns that the tables can give; pages without headings or links have nulls there."""
    full = F.concat(path_of(F.col("final_url")), F.when(query_of(F.col("final_url")) != "", F.concat(F.lit("?"), query_of(F.col("final_url")))).otherwise(""))
    d = pages.select(*PAGE_COLUMNS, "fetched_at").join(answers(fetches), ["url", "fetched_at"], "left").join(heading_counts(headings), "url", "left").join(anchor_counts(links), "url", "left")
    d = d.withColumn("final_url", F.coalesce("final_url", "url")).withColumn("noindex", F.coalesce("noindex", F.lit(False)))
    return d.withColumns({
        "url_path": path_of(F.col("final_url")), "url_upper": path_of(F.col("final_url")).rlike("[A-Z]"), "url_params": F.size(F.filter(F.split(query_of(F.col("final_url")), "&"), lambda x: x != "")).cast("long"),
        "paginated": full.rlike("(?i)" + dims.PAGINATED) & ~path_of(F.col("final_url")).rlike(dims.NOT_PAGINATED), "title_numbered": F.col("title").rlike("(?i)" + dims.TITLE_NUMBER),
        "words_per_section": F.when(F.col("section_headings") > 0, F.round(F.col("word_count") / (F.col("section_headings") + 1)).cast("long")).otherwise(F.col("word_count").cast("long")),
    }).drop("fetched_at")
