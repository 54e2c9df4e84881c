"""Cross-page operators of a site: duplicates, orphans, broken targets, sitemap, language links, canonicals, trust pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.urls import site_of, url_norm
from ..plans.topk import examples


def indexable(pages: DataFrame) -> DataFrame:
    """Pages with status 2xx."""
    return pages.filter((F.col("status") >= 200) & (F.col("status") < 300))


def duplicate_values(pages: DataFrame, column: str, urls: int = 10) -> DataFrame:
    """``site, value, n, examples``: values of ``column`` (case and outer blanks aside) that several indexable pages of a site share."""
    v = indexable(pages).select(site_of(F.col("url")).alias("site"), F.lower(F.trim(F.col(column))).alias("value"), "page_id", "url").filter("value <> ''")
    groups = v.groupBy("site", "value").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.join(examples(v.select("site", "value", "url").distinct(), ["site", "value"], "url", urls), ["site", "value"])


def in_degrees(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``url, in_degree`` of each indexable page (normalised URL): internal links to it, repeats and self-links included."""
    nodes = indexable(pages).select(url_norm(F.col("url")).alias("url")).distinct()
    inbound = links.filter("internal").join(nodes.select(F.col("url").alias("src")), url_norm(F.col("src_url")) == F.col("src"), "left_semi").groupBy(url_norm(F.col("href")).alias("url")).agg(F.count("*").alias("n"))
    return nodes.join(inbound, "url", "left").select("url", F.coalesce("n", F.lit(0)).alias("in_degree"))


def orphans(pages: DataFrame, links: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Indexable pages without an internal link to them, start pages aside."""
    out = in_degrees(pages, links).filter("in_degree = 0").select("url")
    return out.join(starts.select(url_norm(F.col("start_url")).alias("url")).distinct(), "url", "left_anti") if starts is not None else out


def status_by_url(fetches: DataFrame) -> DataFrame:
    """``url, status, hops``: the last answer under each URL, asked or final."""
    both = fetches.select(url_norm(F.col("url")).alias("url"), "status", F.size("redirect_chain").alias("hops"), "fetched_at").unionByName(
        fetches.select(url_norm(F.col("final_url")).alias("url"), "status", F.size("redirect_chain").alias("hops"), "fetched_at")
    )
    return both.filter("url is not null").groupBy("url").agg(F.max(F.struct("fetched_at", "status", "hops")).alias("x")).select("url", "x.status", "x.hops")


def link_targets(links: DataFrame, fetches: DataFrame) -> DataFrame:
    """``target, status, hops, sources``: internal link targets that were fetched, with the number of different linking pages."""
    edges = links.filter("internal").select(url_norm(F.col("src_url")).alias("src"), url_norm(F.col("href")).alias("url")).distinct()
    per = edges.groupBy("url").agg(F.count("*").alias("sources"))
    return per.join(status_by_url(fetches), "url").select(F.col("url").alias("target"), "status", "hops", "sources")


def broken_targets(links: DataFrame, fetches: DataFrame) -> DataFrame:
    return link_targets(links, fetches).filter((F.col("status") >= 400) | (F.col("status") == 0)).select("target", "status", "sources")


def redirect_targets(links: DataFrame, fetches: DataFrame) -> DataFrame:
    return link_targets(links, fetches).filter((F.col("hops") > 0) & (F.col("status") > 0) & (F.col("status") < 400)).select("target", "hops", "sources")


def with_noindex(pages: DataFrame, fetches: DataFrame) -> DataFrame:
    """``pages`` with ``noindex``: whether an answer to the page's fetch forbade indexing in its headers."""
    said = fetches.groupBy("url", "fetched_at").agg(F.bool_or(F.coalesce(F.lower(F.col("headers").getItem("x-robots-tag")).contains("noindex"), F.lit(False))).alias("noindex"))
    return pages.join(said, ["url", "fetched_at"], "left").withColumn("noindex", F.coalesce("noindex", F.lit(False)))


def sitemap_not_indexable(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Pages (with ``noindex``) that the sitemap lists although they do not answer 2xx or must not be indexed."""
    return pages.join(sitemap.select(url_norm(F.col("url")).alias("__u")).distinct(), url_norm(F.col("url")) == F.col("__u"), "left_semi").filter("status < 200 or status >= 300 or noindex").select("page_id", "url", "status")


def outside_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Indexable pages (with ``noindex``) that the sitemap does not list."""
    return indexable(pages).filter("not noindex").join(sitemap.select(url_norm(F.col("url")).alias("__u")).distinct(), url_norm(F.col("url")) == F.col("__u"), "left_anti").select("page_id", "url")


def missing_return_edges(edges: DataFrame) -> DataFrame:
    """``src, dst``: edges whose target has edges of its own, but none back. Self-edges aside, each once."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    has = e.select(F.col("src").alias("dst")).distinct()
    return e.join(has, "dst", "left_semi").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").select("src", "dst")


def invalid_language_codes(hreflang: DataFrame) -> DataFrame:
    """Different hreflang codes that are neither x-default nor a language with an optional region."""
    return hreflang.filter((F.lower("lang") != "x-default") & ~F.col("lang").rlike("(?i)^[a-z]{2}(-[a-z]{2})?$")).select("lang").distinct()


def two_step_chains(maps: DataFrame) -> DataFrame:
    """``src, middle, last``: src -> middle -> last with all steps real (canonical of a canonical, redirect of a redirect)."""
    m = maps.filter("src <> dst").select("src", "dst").distinct()
    return m.alias("a").join(m.alias("b"), F.col("a.dst") == F.col("b.src")).filter("a.src <> b.dst or b.dst <> a.dst").select(F.col("a.src").alias("src"), F.col("a.dst").alias("middle"), F.col("b.dst").alias("last"))


def trust_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``site`` and, for each kind of trust page, whether a URL or internal anchor of the site points to one."""
    hay = pages.select(site_of(F.col("url")).alias("site"), F.lower("url").alias("t")).unionByName(
        links.filter("internal").select(site_of(F.col("src_url")).alias("site"), F.lower(F.concat_ws(" ", "href", "text")).alias("t"))
    )
    return hay.groupBy("site").agg(*[F.bool_or(F.col("t").rlike(p)).alias(k) for k, p in dims.TRUST.items()])


def depth_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy("depth").agg(F.count("*").alias("pages"), F.count_if(F.col("depth") >= 4).alias("deep"))


def site_stats(pages: DataFrame) -> DataFrame:
    """One row per site: pages, indexable, errors, words, depth."""
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    return pages.groupBy(site_of(F.col("url")).alias("site")).agg(
        F.count("*").alias("pages"), F.count_if(ok).alias("indexable"), F.count_if((F.col("status") >= 400) | (F.col("status") == 0)).alias("failed"),
        F.sum("word_count").alias("words"), F.max("depth").alias("max_depth"), F.count_if(F.col("depth") >= 4).alias("deep_pages"),
        F.round(F.avg(F.when(ok, F.col("word_count"))), 6).alias("avg_words"), F.sum("internal_link_count").alias("internal_links"),
    )


def external_targets(links: DataFrame, sources: int = 5) -> DataFrame:
    """``href, links, examples``: external targets with how many links they get and up to ``sources`` linking pages."""
    out = links.filter("not internal and href is not null")
    return out.groupBy("href").agg(F.count("*").alias("links")).join(examples(out.select("href", "src_url").distinct(), ["href"], "src_url", sources), "href")


def weak_important(ranked: DataFrame, part: float = 0.75, below: int = 40, depth: int = 1) -> DataFrame:
    """Pages near the top of their site that few links strengthen: ``ranked(site, node, scaled, depth)`` at depth ``depth`` or less,
    with a scaled rank below ``below`` and not above the site's cut, which is the value at place floor(part x n) of the descending order (0 for
    sites of up to four pages). The cut comes from a histogram: a site has at most 101 scaled ranks."""
    hist = ranked.groupBy("site", "scaled").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("site").orderBy(F.desc("scaled")))
    n = F.sum("c").over(Window.partitionBy("site"))
    at = hist.select("site", "scaled", upto.alias("upto"), n.alias("n")).filter(F.col("upto") > F.floor(F.col("n") * part))
    cut = at.groupBy("site").agg(F.when(F.max("n") > 4, F.max("scaled")).otherwise(0).alias("cut"))
    return ranked.join(cut, "site").filter((F.col("depth") <= depth) & (F.col("scaled") <= F.col("cut")) & (F.col("scaled") < below)).select("site", "node", "scaled", "depth")


def domain_flags(fetches: DataFrame) -> DataFrame:
    """``site``: whether its http form answers without going to https, and whether www and bare host both answer."""
    f = fetches.withColumn("site", site_of(F.col("url")))
    http_stays = F.bool_or(F.lower("url").startswith("http://") & F.lower("final_url").startswith("http://") & F.col("ok"))
    www = F.bool_or(F.lower("final_url").rlike("^https?://www\\.") & F.col("ok"))
    bare = F.bool_or(~F.lower("final_url").rlike("^https?://www\\.") & F.col("ok"))
    return f.groupBy("site").agg(F.coalesce(http_stays, F.lit(False)).alias("http_stays"), F.coalesce(www & bare, F.lit(False)).alias("both_hosts"))


def latest(pages: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest row of each key (ties: the largest page_id)."""
    w = Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.col("page_id").desc())
    return pages.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def site_issues(pages: DataFrame, links: DataFrame, fetches: DataFrame) -> DataFrame:
    """``site, rule_id, severity, category, subject``: what the cross-page operators find, as issue rows."""
    def row(df: DataFrame, rule: str, severity: str, category: str, site_: Column, subject: Column) -> DataFrame:
        return df.select(site_.alias("site"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), subject.alias("subject"))

    trust = trust_pages(pages, links)
    flags = domain_flags(fetches)
    of = lambda c: site_of(F.col(c))
    parts = [
        row(duplicate_values(pages, "title", 1), "SITE_DUPLICATE_TITLE", "warning", "meta", F.col("site"), F.col("value")),
        row(duplicate_values(pages, "meta_description", 1), "SITE_DUPLICATE_DESCRIPTION", "warning", "meta", F.col("site"), F.col("value")),
        row(orphans(pages, links), "SITE_ORPHAN", "warning", "architecture", of("url"), F.col("url")),
        row(broken_targets(links, fetches), "SITE_BROKEN_LINK", "error", "links", of("target"), F.col("target")),
        row(redirect_targets(links, fetches), "SITE_REDIRECTED_LINK", "notice", "links", of("target"), F.col("target")),
        row(trust.select("site", F.explode(F.filter(F.array(*[F.when(~F.col(k), F.lit(k)) for k in dims.TRUST]), lambda x: x.isNotNull())).alias("kind")), "SITE_NO_TRUST_PAGE", "notice", "usability", F.col("site"), F.col("kind")),
        row(flags.filter("http_stays"), "SITE_HTTP_STAYS", "error", "security", F.col("site"), F.lit("http")),
        row(flags.filter("both_hosts"), "SITE_BOTH_HOSTS", "warning", "indexability", F.col("site"), F.lit("www")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def external_status(links: DataFrame, status: DataFrame, sources: int = 5) -> DataFrame:
    """External targets that answered 400 or more (``status(href, status)``), with up to ``sources`` linking pages."""
    return external_targets(links, sources).join(status.filter("status >= 400").select("href", "status"), "href")


def identity_issues(facts: DataFrame, llms: DataFrame) -> DataFrame:
    """``site, rule_id, severity, category``: sites without llms.txt, without an organisation in any page's structured data, or with one that names no
    profiles. ``facts`` as of ``extract.page_facts``; ``llms(site, has_llms)``."""
    kinds = F.lower(F.array_join(F.flatten(F.transform("entities", lambda e: e["types"])), " "))
    organisation = kinds.rlike("organization|corporation|ngo|localbusiness|" + "|".join(t.lower() for t in dims.LOCAL_SUBTYPES))
    s = facts.groupBy(site_of(F.col("url")).alias("site")).agg(F.bool_or(organisation).alias("org"), F.bool_or(F.size("same_as") > 0).alias("same")).join(llms, "site", "left")
    issue = lambda rule: F.struct(F.lit(rule).alias("rule_id"), F.lit("notice").alias("severity"), F.lit("geo").alias("category"))
    found = F.array(F.when(~F.coalesce("has_llms", F.lit(False)), issue("SITE_NO_LLMS")), F.when(~F.col("org"), issue("SITE_NO_ORGANIZATION")), F.when(F.col("org") & ~F.col("same"), issue("SITE_NO_SAME_AS")))
    return s.select("site", F.inline(F.filter(found, lambda x: x.isNotNull())))
