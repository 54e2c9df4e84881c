"""Page rules as a registry of predicates. Rules are SQL expressions over page facts, compiled to one projection without
UDFs: an array of structs per category, filtered and exploded. A rule takes part if the table has the columns it names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims

E, W, N = "error", "warning", "notice"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    when: str
    detail: str = "''"

    @property
    def columns(self) -> set[str]:
        return set(re.findall(r"\b[a-z][a-z0-9_]*\b", re.sub(r"'(?:[^']|'')*'", "", f"{self.when} {self.detail}")))


def _q(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


_GATE = "word_count >= 250 and not noindex and "
_LOCAL = "looks_local and "
PAGE_RULES: tuple[Rule, ...] = (
    Rule("IDX_NOINDEX", W, "indexability", "noindex"),
    Rule("IDX_NOFOLLOW", N, "indexability", "lower(meta_robots) like '%nofollow%'"),
    Rule("IDX_HTTP_ERROR", E, "indexability", "status >= 400 or status = 0", "concat('status ', cast(status as string))"),
    Rule("IDX_REDIRECT_CHAIN", W, "indexability", "status < 400 and hops > 1", "concat(cast(hops as string), ' hops')"),
    Rule("IDX_REDIRECT", N, "indexability", "status < 400 and hops = 1"),
    Rule("IDX_TEMP_REDIRECT", W, "indexability", "temporary_hops > 0"),
    Rule("IDX_MULTI_CANONICAL", E, "indexability", "canonical_count > 1"),
    Rule("IDX_NO_CANONICAL", N, "indexability", "canonical_count <= 1 and canonical is null"),
    Rule("IDX_CANONICAL_OTHER", N, "indexability", "canonical_count = 1 and canonical_norm <> final_norm"),
    Rule("IDX_NOINDEX_CANONICAL", W, "indexability", "canonical_count = 1 and canonical_norm <> final_norm and noindex"),
    Rule("IDX_BAD_CANONICAL", W, "indexability", "canonical_count = 1 and canonical is not null and canonical_norm is null"),
    Rule("META_NO_TITLE", E, "meta", "title is null or trim(both ' ' from title) = ''"),
    Rule("META_MULTI_TITLE", W, "meta", "title_count > 1"),
    Rule("META_TITLE_SHORT", W, "meta", "length(trim(both ' ' from title)) > 0 and length(trim(both ' ' from title)) < 30", "concat(cast(length(trim(both ' ' from title)) as string), ' characters')"),
    Rule("META_TITLE_LONG", W, "meta", "length(trim(both ' ' from title)) > 60", "concat(cast(length(trim(both ' ' from title)) as string), ' characters')"),
    Rule("META_NO_DESC", W, "meta", "meta_description is null or trim(both ' ' from meta_description) = ''"),
    Rule("META_DESC_SHORT", N, "meta", "length(trim(both ' ' from meta_description)) > 0 and length(trim(both ' ' from meta_description)) < 70", "concat(cast(length(trim(both ' ' from meta_description)) as string), ' characters')"),
    Rule("META_DESC_LONG", N, "meta", "length(trim(both ' ' from meta_description)) > 160", "concat(cast(length(trim(both ' ' from meta_description)) as string), ' characters')"),
    Rule("CNT_NO_H1", E, "content", "h1_count = 0"),
    Rule("CNT_MULTI_H1", W, "content", "h1_count > 1", "concat(cast(h1_count as string), ' h1')"),
    Rule("CNT_HEADING_SKIP", N, "content", "heading_skip > 0", "concat('h', cast(heading_skip as string))"),
    Rule("CNT_THIN", W, "content", "word_count < 100 and not noindex", "concat(cast(word_count as string), ' words')"),
    Rule("CNT_LOW_TEXT_RATIO", N, "content", "text_ratio < 0.1 and word_count > 0"),
    Rule("CNT_IMG_NO_ALT", W, "content", "images_no_alt > 0"),
    Rule("PERF_IMG_NO_DIM", N, "performance", "images_no_size > 0"),
    Rule("MOB_NO_VIEWPORT", E, "mobile", "has_markup and viewport is null"),
    Rule("MOB_BAD_VIEWPORT", W, "mobile", "not (lower(viewport) rlike 'width[ ]*=[ ]*device-width')"),
    Rule("INT_NO_LANG", W, "international", "html_lang is null or trim(both ' ' from html_lang) = ''"),
    Rule("META_NO_CHARSET", N, "meta", "has_markup and charset is null"),
    Rule("INT_HREFLANG_NO_SELF", N, "international", "hreflang_count > 0 and not hreflang_self"),
    Rule("SD_BAD_JSONLD", W, "structured", "jsonld_invalid > 0"),
    Rule("SD_NONE", N, "structured", "jsonld_blocks = 0 and microdata = 0 and rdfa = 0"),
    Rule("SOC_NO_OG", N, "social", "has_markup and og_title is null and og_image is null"),
    Rule("SOC_PARTIAL_OG", N, "social", "(og_title is not null or og_image is not null) and og_present < 5"),
    Rule("SOC_NO_TWITTER", N, "social", "has_markup and twitter_card is null and (og_title is not null or og_image is not null)"),
    Rule("LNK_NO_INTERNAL", W, "links", "internal_link_count = 0"),
    Rule("PERF_SLOW", W, "performance", "response_time_ms > 1500", "concat(cast(response_time_ms as string), ' ms')"),
    Rule("PERF_MEDIUM", N, "performance", "response_time_ms > 600 and response_time_ms <= 1500", "concat(cast(response_time_ms as string), ' ms')"),
    Rule("PERF_BIG_HTML", N, "performance", "html_size > 153600"),
    Rule("PERF_NO_COMPRESSION", W, "performance", "html_size > 10240 and not compressed"),
    Rule("PERF_NO_CACHE", N, "performance", "has_headers and cache_control is null"),
    Rule("SEC_NO_HTTPS", E, "security", "lower(final_url) not like 'https://%'"),
    Rule("SEC_MIXED", W, "security", "lower(final_url) like 'https://%' and images_http > 0"),
    Rule("SEC_NO_HSTS", N, "security", "has_headers and lower(final_url) like 'https://%' and hsts is null"),
    Rule("SEC_NO_XCTO", N, "security", "has_headers and xcto is null"),
    Rule("SEC_NO_CSP", N, "security", "has_headers and csp is null"),
    Rule("URL_LONG", N, "url", "length(url_path) > 115"),
    Rule("URL_UPPER", N, "url", "url_upper"),
    Rule("URL_UNDERSCORE", N, "url", "contains(url_path, '_')"),
    Rule("URL_PARAMS", N, "url", "url_params > 3"),
    Rule("ARC_DEEP", N, "architecture", "depth >= 4 and status < 300", "concat('depth ', cast(depth as string))"),
    Rule("ARC_EMPTY_ANCHOR", N, "architecture", "blank_anchors > 0", "concat(cast(blank_anchors as string), ' links')"),
    Rule("ARC_GENERIC_ANCHOR", N, "architecture", "generic_anchors >= 3", "concat(cast(generic_anchors as string), ' links')"),
    Rule("GEO_NO_SEMANTIC", N, "geo", _GATE + "semantic_blocks = 0"),
    Rule("GEO_NO_AUTHOR", W, "geo", _GATE + "not has_author"),
    Rule("GEO_NO_DATE", W, "geo", _GATE + "not has_date"),
    Rule("GEO_NO_QUESTIONS", N, "geo", _GATE + "question_headings = 0 and not faq_type"),
    Rule("GEO_NO_LISTS", N, "geo", _GATE + "list_count = 0 and table_count = 0"),
    Rule("GEO_LONG_PARAS", N, "geo", _GATE + "long_paragraphs >= 3"),
    Rule("GEO_NO_RICH_TYPE", N, "geo", _GATE + "not rich_type"),
    Rule("GEO_NO_SOURCES", N, "geo", _GATE + "authority_links = 0"),
    Rule("GEO_SOURCES_NOFOLLOW", N, "geo", _GATE + "authority_links > 0 and authority_follow = 0"),
    Rule("GEO_NO_SUBHEADS", W, "geo", _GATE + "word_count >= 600 and section_headings <= 1"),
    Rule("GEO_LONG_SECTIONS", N, "geo", _GATE + "not (word_count >= 600 and section_headings <= 1) and words_per_section > 350"),
    Rule("GEO_FLUFF", N, "geo", _GATE + "fluff_count >= 2"),
    Rule("GEO_LOW_ENTITY", N, "geo", _GATE + "word_count >= 400 and entity_density < 0.02"),
    Rule("LOC_LB_NO_ADDRESS", W, "local", "local_business and not schema_address"),
    Rule("LOC_NO_SCHEMA", W, "local", _LOCAL + "not local_business and not organization"),
    Rule("LOC_NO_PHONE", N, "local", _LOCAL + "not has_phone"),
    Rule("LOC_NO_ADDRESS", N, "local", _LOCAL + "not has_address"),
    Rule("LOC_NO_GEO", N, "local", _LOCAL + "not geo_meta and not local_business"),
    Rule("LOC_NO_MAP", N, "local", _LOCAL + "not has_map and (local_business or schema_address)"),
    Rule("PERF_LEGACY_IMG", N, "performance", "images_legacy >= 3"),
    Rule("PERF_NO_LAZY", N, "performance", "image_count >= 8 and images_not_lazy >= 5"),
    Rule("PERF_PRELOAD", W, "performance", "preload > 6"),
    Rule("PERF_NO_PRECONNECT", N, "performance", "preconnect = 0 and external_link_count > 0 and images_elsewhere > 0"),
    Rule("IDX_PAGINATION_REL", N, "indexability", "paginated and rel_next is null and rel_prev is null"),
    Rule("META_PAGINATION_TITLE", N, "meta", "paginated and title is not null and not title_numbered"),
    Rule("A11Y_NO_NAME", W, "accessibility", "interactive_no_name >= 1"),
    Rule("A11Y_NO_LABEL", W, "accessibility", "inputs_no_label >= 1"),
    Rule("A11Y_TABINDEX", N, "accessibility", "positive_tabindex >= 1"),
    Rule("A11Y_SVG", N, "accessibility", "img_role_svg >= 1"),
    Rule("UX_LONG_SENT", W, "usability", "word_count >= 200 and avg_sentence_length > 25", "concat(cast(avg_sentence_length as string), ' words')"),
    Rule("UX_LOW_READ", N, "usability", "word_count >= 200 and avg_sentence_length <= 25 and readability < 40", "concat('readability ', cast(readability as string))"),
    Rule("UX_BLOCKING", W, "usability", "head_sync_scripts >= 3"),
    Rule("UX_MANY_CSS", N, "usability", "stylesheets > 8"),
    Rule("UX_NO_BREADCRUMB", N, "usability", "not has_breadcrumb and depth >= 2"),
    Rule("UX_NO_FAVICON", N, "usability", "has_markup and favicon is null"),
    Rule("META_TITLE_H1", N, "meta", "title_h1_disjoint"),
    Rule("CNT_BAD_IMG_NAME", N, "content", "images_camera_name >= 3"),
    Rule("GEO_NO_STATS", N, "geo", "word_count >= 400 and stat_count = 0 and not noindex"),
    Rule("SEC_CLICKJACK", N, "security", "has_headers and xfo is null and (csp is null or csp not like '%frame-ancestors%')"),
    Rule("SEC_NO_REFERRER", N, "security", "has_headers and referrer_policy is null"),
    Rule("RENDER_DEPENDENT", W, "content", "rendered_words > 1.5 * word_count and word_count < 200"),
)
_SQL_WORDS = frozenset("is null not and or like length trim both from cast as string concat lower contains rlike".split())


def applicable(columns: list[str], rules: tuple[Rule, ...] = PAGE_RULES) -> list[Rule]:
    have = set(columns)
    return [r for r in rules if r.columns - _SQL_WORDS <= have]


def issues(facts: DataFrame, key: list[str], rules: tuple[Rule, ...] = PAGE_RULES) -> DataFrame:
    """``key``, rule_id, severity, category, detail: one row per rule that fires on a row of ``facts``. A null predicate does not fire."""
    use = applicable(facts.columns, rules)
    parts = []
    for category in dict.fromkeys(r.category for r in use):
        fired = [
            F.expr(f"case when {r.when} then named_struct('rule_id', '{r.id}', 'severity', '{r.severity}', 'category', '{r.category}', 'detail', {r.detail}) end")
            for r in use
            if r.category == category
        ]
        parts.append(F.filter(F.array(*fired), lambda x: x.isNotNull()))
    if not parts:
        raise ValueError("no rule applies to these columns")
    return facts.select(*key, F.inline(F.concat(*parts)))


def schema_rule_issues(missing: DataFrame) -> DataFrame:
    """Issue rows of ``extract.schema_issues``."""
    need = F.col("kind") == "required"
    return missing.select(
        "url", F.when(need, "SD_MISSING_REQUIRED").otherwise("SD_MISSING_RECOMMENDED").alias("rule_id"), F.when(need, E).otherwise(N).alias("severity"),
        F.lit("structured").alias("category"), F.concat_ws(" ", F.col("type"), F.array_join("missing", ", ")).alias("detail"),
    )


def derived(facts: DataFrame) -> DataFrame:
    """Rule columns from parsed facts (``extract.page_facts``), with ``final_url, status, depth, response_time_ms, headers, redirect_chain`` joined."""
    from ..functions import text as X
    from ..functions.urls import host_of, origin_of, path_of, query_of, url_norm

    header = lambda n: F.col("headers").getItem(n)
    img = F.col("images")
    types = F.lower(F.array_join(F.flatten(F.transform("entities", lambda e: e["types"])), " "))
    internal = F.filter("links", lambda x: x["internal"])
    authority = F.filter("links", lambda x: (~x["internal"]) & x["href"].rlike("(?i)" + dims.AUTHORITY))
    words = X.word_count(F.col("body_text"))
    tokens = lambda c: F.array_distinct(F.filter(F.split(X.normalized(c), " "), lambda t: F.length(t) > 3))
    n = lambda a: F.size(a).cast("long")
    skip = F.coalesce(*[F.when((F.size(f"h{i}") > 0) & (F.size(f"h{i - 1}") == 0) & (F.size("h1") > 0), i) for i in range(2, 7)], F.lit(0))
    has_prop = lambda p: F.exists("entities", lambda e: F.array_contains(e["props"], p))
    full = F.concat(path_of(F.col("final_url")), F.when(query_of(F.col("final_url")) != "", F.concat(F.lit("?"), query_of(F.col("final_url")))).otherwise(""))
    d = facts.withColumns({
        "headings_text": F.array_join(F.concat("h1", "h2", "h3"), " . "), "body_sample": F.substring("body_text", 1, 1500),
        "noindex": F.coalesce(F.lower("meta_robots").contains("noindex"), F.lit(False)) | F.coalesce(F.lower(header("x-robots-tag")).contains("noindex"), F.lit(False)),
        "hops": n(F.col("redirect_chain")), "temporary_hops": n(F.filter("redirect_chain", lambda h: h["status"].isin(302, 303, 307))),
        "has_markup": F.col("html_size") > 0, "has_headers": F.size("headers") > 0,
        "h1_count": n(F.col("h1")), "heading_skip": skip, "word_count": words,
        "text_ratio": X.clipped_share(F.length("body_text"), F.col("html_size")),
        "image_count": n(img), "images_no_alt": n(F.filter(img, lambda x: x["alt"].isNull())), "images_no_size": n(F.filter(img, lambda x: x["src"].isNotNull() & (x["width"].isNull() | x["height"].isNull()))),
        "images_http": n(F.filter(img, lambda x: x["src"].startswith("http://"))), "images_legacy": n(F.filter(img, lambda x: x["src"].rlike(r"(?i)\.(jpe?g|png)(\?|$)"))),
        "images_not_lazy": n(F.filter(img, lambda x: (x["src"] != "") & ~x["loading"].eqNullSafe("lazy"))), "images_camera_name": n(F.filter(img, lambda x: x["src"].rlike("(?i)" + dims.CAMERA_NAME))),
        "images_elsewhere": n(F.filter(img, lambda x: x["src"].rlike("(?i)^https?://") & ~F.contains(F.lower(x["src"]), host_of(F.col("final_url"))))),
        "hreflang_count": n(F.col("hreflang")), "og_title": F.col("og").getItem("og:title"), "og_image": F.col("og").getItem("og:image"), "twitter_card": F.col("twitter").getItem("twitter:card"),
        "og_present": n(F.array_intersect(F.map_keys("og"), F.array(*[F.lit(f"og:{k}") for k in ("title", "description", "image", "url", "type")]))),
        "internal_link_count": n(internal), "external_link_count": n(F.filter("links", lambda x: ~x["internal"])),
        "blank_anchors": n(F.filter(internal, lambda x: F.trim(x["text"]) == "")), "generic_anchors": n(F.filter(internal, lambda x: F.trim(x["text"]).rlike("(?i)" + dims.GENERIC_ANCHOR))),
        "authority_links": n(authority), "authority_follow": n(F.filter(authority, lambda x: ~x["nofollow"])),
        "compressed": F.coalesce(header("content-encoding").rlike("gzip|br|deflate"), F.lit(False)), "cache_control": header("cache-control"), "hsts": header("strict-transport-security"),
        "xcto": header("x-content-type-options"), "csp": header("content-security-policy"), "xfo": header("x-frame-options"), "referrer_policy": header("referrer-policy"),
        "url_path": path_of(F.col("final_url")), "url_upper": path_of(F.col("final_url")).rlike("[A-Z]"), "url_params": n(F.filter(F.split(query_of(F.col("final_url")), "&"), lambda x: x != "")),
        "semantic_blocks": F.col("article") + F.col("main") + F.col("section"), "has_author": F.col("author").isNotNull() | has_prop("author"),
        "has_date": F.col("published").isNotNull() | F.col("modified").isNotNull() | has_prop("datePublished") | has_prop("dateModified"),
        "faq_type": types.contains("faqpage"), "rich_type": types.rlike("article|faq|howto|product|recipe|event"), "section_headings": n(F.col("h2")) + n(F.col("h3")),
        "fluff_count": X.fluff_count(F.col("body_text")), "stat_count": X.stat_count(F.col("body_text")),
        "entity_density": X.clipped_share(F.size(F.array_distinct(F.transform(X.entities(F.col("body_text")), lambda e: F.lower(e)))), words),
        "local_business": types.rlike("localbusiness|" + "|".join(t.lower() for t in dims.LOCAL_SUBTYPES)), "organization": types.rlike("organization|corporation|ngo"), "schema_address": has_prop("address"),
        "has_phone": (F.col("tel_links") > 0) | F.col("body_text").rlike(r"\+?\d[\d\s().-]{7,}\d"),
        "paginated": full.rlike("(?i)" + dims.PAGINATED) & ~path_of(F.col("final_url")).rlike(dims.NOT_PAGINATED), "title_numbered": F.col("title").rlike("(?i)" + dims.TITLE_NUMBER),
        "avg_sentence_length": X.average_sentence(F.col("body_text")), "readability": X.readability(F.col("body_text")),
        "title_h1_disjoint": (F.size("h1") == 1) & (F.size(tokens(F.col("title"))) > 0) & (F.size(tokens(F.element_at("h1", 1))) > 0) & ~F.arrays_overlap(tokens(F.col("title")), tokens(F.get("h1", F.lit(0)))),
    })
    # as absolute addresses compare: scheme and host in lower case, no fragment, no slash at the end
    plain = lambda u: F.regexp_replace(F.concat(origin_of(u), F.substring(url_norm(u), F.length(origin_of(u)) + 1, F.lit(1_000_000))), "/$", "")
    return d.withColumn("final_norm", plain(F.col("final_url"))).withColumns({
        "canonical_norm": plain(F.col("canonical_target")), "hreflang_self": F.exists("hreflang", lambda x: F.coalesce(plain(x["target"]) == F.col("final_norm"), F.lit(False))),
        "words_per_section": F.when(F.col("section_headings") > 0, F.round(words / (F.col("section_headings") + 1))).otherwise(words).cast("long"),
        "looks_local": F.col("local_business") | F.col("schema_address") | F.col("has_map") | (F.col("tel_links") > 0) | F.col("final_url").rlike("(?i)" + dims.LOOKS_LOCAL),
        "has_address": F.col("schema_address") | F.col("body_text").rlike(r"(?i)(^|\W)(\d{2}-\d{3}|\d{5})(\W|$)|(^|\W)(ul\.|ulica|al\.|aleja|plac|street|st\.|ave\.?|avenue)(\W|$)"),
    })
