"""Crawl dataflow on tables: seeds, frontier expansion under robots rules and a page limit, advice for issues."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import same_site, url_canon
from ..plans.lineage import stored
from ..sources import robots

#: What to do about an issue, by category; rules with advice of their own come first (fixed values).
RULE_ADVICE = {
    "IDX_NOINDEX": "Remove the noindex directive if the page should be found.", "IDX_NOFOLLOW": "Remove nofollow from the page unless its links must not count.",
    "IDX_HTTP_ERROR": "Restore the page or redirect it to its successor.", "IDX_REDIRECT_CHAIN": "Redirect straight to the final address.",
    "IDX_REDIRECT": "Link to the final address.", "IDX_TEMP_REDIRECT": "Use a permanent redirect if the move is permanent.",
    "IDX_MULTI_CANONICAL": "Keep one canonical link.", "IDX_NO_CANONICAL": "Name the page's canonical address.", "IDX_CANONICAL_OTHER": "Check that the other address is meant to stand for this page.",
    "IDX_NOINDEX_CANONICAL": "Use either noindex or a canonical address.", "IDX_BAD_CANONICAL": "Write a valid absolute address as canonical.", "IDX_PAGINATION_REL": "Link the pages of a series with prev and next.",
    "META_NO_TITLE": "Write a title that names the page's subject.", "META_MULTI_TITLE": "Keep one title.", "META_TITLE_SHORT": "Extend the title to 30 to 60 characters.", "META_TITLE_LONG": "Cut the title to 60 characters.",
    "META_NO_DESC": "Write a description of 70 to 160 characters.", "META_DESC_SHORT": "Extend the description to 70 characters or more.", "META_DESC_LONG": "Cut the description to 160 characters.",
    "META_NO_CHARSET": "Declare UTF-8 at the start of the head.", "META_PAGINATION_TITLE": "Put the page's number into its title.", "META_TITLE_H1": "Let title and main heading share the words that matter.",
    "CNT_NO_H1": "Give the page one main heading.", "CNT_MULTI_H1": "Keep one main heading and lower the others.", "CNT_HEADING_SKIP": "Use heading levels without gaps.", "CNT_THIN": "Add content or merge the page with a related one.",
    "CNT_LOW_TEXT_RATIO": "Remove markup and inline code, or add text.", "CNT_IMG_NO_ALT": "Describe images in their alt texts.", "CNT_BAD_IMG_NAME": "Name image files after what they show.",
    "MOB_NO_VIEWPORT": "Declare a viewport.", "MOB_BAD_VIEWPORT": "Set the viewport to the width of the device.", "INT_NO_LANG": "Declare the page's language.", "INT_HREFLANG_NO_SELF": "Let the set of language versions name this page, too.",
    "SD_BAD_JSONLD": "Correct the syntax of the JSON-LD block.", "SD_NONE": "Describe the page's subject in structured data.", "SD_MISSING_REQUIRED": "Add the required properties.", "SD_MISSING_RECOMMENDED": "Add the recommended properties.",
    "SOC_NO_OG": "Add sharing tags with title and image.", "SOC_PARTIAL_OG": "Complete title, description, image, address and type of the sharing tags.", "SOC_NO_TWITTER": "Choose a card type for sharing.",
    "LNK_NO_INTERNAL": "Link to related pages of the site.", "ARC_DEEP": "Link the page from a page nearer to the start.", "ARC_EMPTY_ANCHOR": "Give each link a text.", "ARC_GENERIC_ANCHOR": "Say in link texts where they lead.",
    "PERF_SLOW": "Shorten the time to the answer.", "PERF_MEDIUM": "Bring the answer below 600 ms.", "PERF_BIG_HTML": "Bring the document below 150 KB.", "PERF_NO_COMPRESSION": "Compress answers.", "PERF_NO_CACHE": "State how long answers may be kept.",
    "PERF_IMG_NO_DIM": "State width and height of images.", "PERF_LEGACY_IMG": "Offer images in newer formats.", "PERF_NO_LAZY": "Load images lazily below the first screen.", "PERF_PRELOAD": "Preload only what the first screen needs.", "PERF_NO_PRECONNECT": "Connect early to other hosts that the page needs.",
    "SEC_NO_HTTPS": "Serve the page over HTTPS.", "SEC_MIXED": "Load images over HTTPS.", "SEC_NO_HSTS": "Send Strict-Transport-Security.", "SEC_NO_XCTO": "Send X-Content-Type-Options: nosniff.", "SEC_NO_CSP": "Send a content security policy.",
    "SEC_CLICKJACK": "Say who may frame the page.", "SEC_NO_REFERRER": "Send a referrer policy.", "URL_LONG": "Shorten the path.", "URL_UPPER": "Use lower case in paths.", "URL_UNDERSCORE": "Part words in paths by hyphens.", "URL_PARAMS": "Use fewer parameters.",
    "GEO_NO_SEMANTIC": "Mark main content, articles and sections.", "GEO_NO_AUTHOR": "Name the author.", "GEO_NO_DATE": "State when the page was written or changed.", "GEO_NO_QUESTIONS": "Answer questions under headings that ask them.",
    "GEO_NO_LISTS": "Sum up in lists or tables.", "GEO_LONG_PARAS": "Split long paragraphs.", "GEO_NO_RICH_TYPE": "Declare what kind of content this is.", "GEO_NO_SOURCES": "Cite sources with authority.", "GEO_SOURCES_NOFOLLOW": "Let links to sources be followed.",
    "GEO_NO_SUBHEADS": "Part the text by subheadings.", "GEO_LONG_SECTIONS": "Keep sections below 350 words.", "GEO_FLUFF": "Cut empty phrases.", "GEO_LOW_ENTITY": "Name people, places and products.", "GEO_NO_STATS": "Give figures.",
    "LOC_LB_NO_ADDRESS": "Add the address to the structured data.", "LOC_NO_SCHEMA": "Describe the business in structured data.", "LOC_NO_PHONE": "State a telephone number.", "LOC_NO_ADDRESS": "State the address.", "LOC_NO_GEO": "State the position.", "LOC_NO_MAP": "Embed a map.",
    "A11Y_NO_NAME": "Name buttons and links.", "A11Y_NO_LABEL": "Label form fields.", "A11Y_TABINDEX": "Leave the order of focus to the document.", "A11Y_SVG": "Give drawings a title.",
    "UX_LONG_SENT": "Split long sentences.", "UX_LOW_READ": "Use shorter words and sentences.", "UX_BLOCKING": "Defer scripts in the head.", "UX_MANY_CSS": "Join style sheets.", "UX_NO_BREADCRUMB": "Show the path to the page.", "UX_NO_FAVICON": "Add an icon.",
    "RENDER_DEPENDENT": "Put the main text into the document that is served.",
}
CATEGORY_ADVICE = {
    "meta": "Revise title and description.", "content": "Revise text and headings.", "indexability": "Check status, canonical and robots directives.", "links": "Repair or remove the links.",
    "structured": "Complete the structured data.", "performance": "Reduce weight and waiting time.", "security": "Set the missing protection.", "mobile": "Adapt the page to small screens.",
    "international": "Declare languages consistently.", "social": "Complete the sharing tags.", "url": "Simplify the address.", "geo": "Make the text easy to quote: authors, dates, sources.",
    "local": "State address and contact data.", "architecture": "Shorten the path to the page and name its links.", "accessibility": "Name controls and images.", "usability": "Make the page easier to use.",
}


def advice(rule_id: Column, category: Column) -> Column:
    """Advice of the rule, else of its category."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(table(RULE_ADVICE)[rule_id], table(CATEGORY_ADVICE)[category], F.lit("Check the page."))


def seeds(starts: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """``url, depth``: start pages at 0, sitemap pages at 1; the smaller depth wins."""
    s = starts.select(url_canon(F.col("url")).alias("url"), F.lit(0).alias("depth"))
    if sitemap is not None:
        s = s.unionByName(sitemap.select(url_canon(F.col("url")).alias("url"), F.lit(1).alias("depth")))
    return s.groupBy("url").agg(F.min("depth").alias("depth"))


def expand(start: DataFrame, links: DataFrame, rules: DataFrame | None = None, most: int | None = None, subdomains: bool = False, depth: int | None = None) -> DataFrame:
    """``url, depth`` that a crawl over the link table visits, level by level.

    Links leave a page only within its site; ``rules`` (of one agent) admit URLs; at most ``most`` pages are visited:
    the level that crosses the limit is cut in order of URL; with ``depth``, links are not followed beyond that depth. One join and one
    anti join per level, until nothing is left to visit.
    """
    e = links.select(url_canon(F.col("src_url")).alias("src"), url_canon(F.col("href")).alias("dst")).distinct().filter(same_site(F.col("src"), F.col("dst"), subdomains))
    allow = (lambda d: robots.admitted(d, rules).filter("allowed").drop("allowed")) if rules is not None else (lambda d: d)
    e, waiting = stored(e, "crawl-edges"), stored(allow(start.select("url", "depth")), "crawl-seeds")
    seen, done = None, 0
    for level in itertools.count():
        front = waiting.filter(F.col("depth") <= level)
        if seen is not None:
            front = front.join(seen.select("url"), "url", "left_anti")
        front = front.groupBy("url").agg(F.min("depth").alias("depth"))
        if most is not None:
            front = front.orderBy("url").limit(max(0, most - done))
        front = stored(front, "crawl-front")
        n = front.count()
        done += n
        seen = front if seen is None else seen.unionByName(front)
        if level % 10 == 9:
            seen = stored(seen, "crawl-seen")
        if (n == 0 and waiting.filter(F.col("depth") > level).isEmpty()) or level == depth:
            return seen
        new = allow(e.join(front.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()).join(seen.select("url"), "url", "left_anti")
        waiting = stored(waiting.filter(F.col("depth") > level).unionByName(new.withColumn("depth", F.lit(level + 1))), "crawl-waiting")
        if most is not None and done >= most:
            return seen


def soft_404(probes: DataFrame) -> DataFrame:
    """Sites that answer 2xx for an address that cannot exist (``probes(site, status)``)."""
    return probes.filter((F.col("status") >= 200) & (F.col("status") < 300)).select("site").distinct()
