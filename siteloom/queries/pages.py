"""Page-level queries: URL features, text measures, rules, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..functions import urls as U
from ..operators import audit, rules, scoring, site
from ..plans.topk import top
from ..sources.tables import spread, table
from . import sql as S


def url_features(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(s, d, "page_facts").select(
        "page_id", U.site_of(u).alias("site"), U.host_of(u).alias("host"), F.length(U.path_of(u)).cast("long").alias("path_length"), U.url_norm(u).alias("normal"),
        F.size(F.filter(F.split(U.query_of(u), "&"), lambda x: x != "")).cast("long").alias("params"), F.lower(u).startswith("https://").alias("https"), U.slug_words(u).alias("slug"),
    )


def url_canonical_groups(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_facts").groupBy(U.url_canon(F.col("url")).alias("canonical")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).filter("pages > 1")


def page_text_stats(s: SparkSession, d: str) -> DataFrame:
    t = F.col("body_text")
    return spread(table(s, d, "page_facts")).filter(t.isNotNull()).select(
        "page_id", X.word_count(t).alias("words"), F.size(X.sentences(t)).cast("long").alias("sentences"), X.average_sentence(t).alias("avg_sentence"),
        F.size(F.filter(X.sentences(t), lambda x: F.size(X.words(x)) > 25)).cast("long").alias("long_sentences"), X.readability(t).alias("readability"),
        F.greatest(F.lit(1), F.round(X.word_count(t) / 200)).cast("long").alias("reading_minutes"),
    )


def text_signals(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spread(table(s, d, "documents")).select("doc_id", X.fluff_count(t).alias("fluff"), X.stat_count(t).alias("stats"), F.size(F.array_distinct(F.transform(X.entities(t), lambda e: F.lower(e)))).cast("long").alias("entities"))


def heading_profile(s: SparkSession, d: str) -> DataFrame:
    return audit.heading_counts(table(s, d, "headings"))


def anchor_profile(s: SparkSession, d: str) -> DataFrame:
    return audit.anchor_counts(table(s, d, "links"))


def facts(s: SparkSession, d: str) -> DataFrame:
    return audit.table_facts(*[table(s, d, n) for n in ("page_facts", "fetches", "headings", "links")])


def _issues(s: SparkSession, d: str) -> DataFrame:
    return rules.issues(facts(s, d), ["page_id", "audit_id", "url"])


def rule_issues(s: SparkSession, d: str) -> DataFrame:
    return _issues(s, d).select("page_id", "rule_id", "severity", "category", "detail")


def severity_pivot(s: SparkSession, d: str) -> DataFrame:
    return scoring.severity_counts(_issues(s, d), ["audit_id"])


def issue_rollup(s: SparkSession, d: str) -> DataFrame:
    return scoring.rollup(_issues(s, d)).select("severity", "category", "rule_id", "n", "first_detail", F.array_join("examples", "|").alias("examples"))


def category_scores(s: SparkSession, d: str) -> DataFrame:
    return scoring.category_scores(_issues(s, d), table(s, d, "page_facts")).select("category", "penalty", "score")


def overall_score(s: SparkSession, d: str) -> DataFrame:
    return scoring.overall_score(scoring.category_scores(_issues(s, d), table(s, d, "page_facts")))


def page_issue_weights(s: SparkSession, d: str) -> DataFrame:
    return scoring.page_rank_by_issues(_issues(s, d), ["page_id"])


def worst_pages(s: SparkSession, d: str) -> DataFrame:
    """Top-k report: the ten pages of each audit with the weightiest issues."""
    w = scoring.page_rank_by_issues(_issues(s, d).filter("audit_id is not null"), ["audit_id", "page_id"])
    return top(w, ["audit_id"], [F.desc("weight"), F.col("page_id")], 10).select("audit_id", "page_id", "weight", "rank")


def latest_pages(s: SparkSession, d: str) -> DataFrame:
    return site.latest(table(s, d, "page_facts").withColumn("canonical", U.url_canon(F.col("url"))), ["canonical"], "fetched_at").select("canonical", "page_id", "status")


QUERIES = {f.__name__: f for f in (url_features, url_canonical_groups, page_text_stats, text_signals, heading_profile, anchor_profile, rule_issues, severity_pivot, issue_rollup, category_scores, overall_score, page_issue_weights, worst_pages, latest_pages)}

_CANON_1 = "regexp_replace(trim(url), '#.*$', '')"
_STRIP = r"regexp_replace({}, '([?&])(utm_[^=&]*|fbclid[^=&]*|gclid[^=&]*|mc_[^=&]*)(=[^&]*)?(&|$)', '\1\4', 'g')"
_CANON_2 = _STRIP.format(_STRIP.format(_CANON_1))
_CANON_3 = rf"regexp_replace(regexp_replace(regexp_replace({_CANON_2}, '&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '')"
_CANON = rf"""(select case when regexp_matches(x, '^[a-z][a-z0-9+.-]*://[^/?#]+/$') then x else regexp_replace(x, '/$', '') end
  from (select lower(regexp_extract(y, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) || substr(y, length(regexp_extract(y, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) + 1) as x from (select {_CANON_3} as y)))"""
_n = lambda a: f"len({a})"
_b = S.words("body_text")
_avg = f"cast(round({_n(_b)} / greatest({_n(S.sentences('body_text'))}, 1)) as bigint)"
_CAP = f"[{dims.CAPITAL}][{dims.SMALL}]+"
_fl = " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '(?i){p.replace(chr(39), chr(39) * 2)}'))" for p in dims.FLUFF)
_HEADINGS = """
select url, count(*) filter (level = 1) as h1_count, count(*) filter (level in (2, 3)) as section_headings,
  cast(case when h2 > 0 and h1 = 0 and h1 > 0 then 2 when h3 > 0 and h2 = 0 and h1 > 0 then 3 when h4 > 0 and h3 = 0 and h1 > 0 then 4 when h5 > 0 and h4 = 0 and h1 > 0 then 5 when h6 > 0 and h5 = 0 and h1 > 0 then 6 else 0 end as bigint) as heading_skip,
  count(*) filter (level between 2 and 4 and ends_with(trim(text), '?')) as question_headings
from headings join (select url, count(*) filter (level = 1) as h1, count(*) filter (level = 2) as h2, count(*) filter (level = 3) as h3, count(*) filter (level = 4) as h4, count(*) filter (level = 5) as h5, count(*) filter (level = 6) as h6
  from headings where trim(text) <> '' group by url) using (url) where trim(text) <> '' group by url, h1, h2, h3, h4, h5, h6"""
_ANCHORS = f"""
select src_url as url, count(*) filter (internal) as kept_internal, count(*) filter (not internal) as kept_external, count(*) filter (internal and trim(coalesce(text, '')) = '') as blank_anchors,
  count(*) filter (internal and regexp_matches(trim(text), '(?i){dims.GENERIC_ANCHOR}')) as generic_anchors,
  count(*) filter (not internal and regexp_matches(href, '(?i){dims.AUTHORITY}')) as authority_links, count(*) filter (not internal and not nofollow and regexp_matches(href, '(?i){dims.AUTHORITY}')) as authority_follow
from (select distinct src_url, pos, href, text, nofollow, internal from links) group by src_url"""
_FACTS = f"""
with f as (
  select url, fetched_at, max(final_url) as fu, max(response_time_ms) as response_time_ms, max(bytes) as html_size, max(len(redirect_chain)) as hops,
    max(len(list_filter(redirect_chain, lambda x: x.status in (302, 303, 307)))) as temporary_hops, max(cardinality(headers)) > 0 as has_headers, max(headers['cache-control']) as cache_control,
    max(headers['strict-transport-security']) as hsts, coalesce(max(regexp_matches(headers['content-encoding'], 'gzip|br|deflate')), false) as compressed,
    coalesce(max(contains(lower(headers['x-robots-tag']), 'noindex')), false) as ni
  from fetches group by url, fetched_at
), h as ({_HEADINGS}), a as ({_ANCHORS}), j as (
  select page_facts.*, coalesce(fu, page_facts.url) as final_url, coalesce(ni, false) as noindex, response_time_ms, html_size, hops, temporary_hops, has_headers, cache_control, hsts, compressed,
    h1_count, section_headings, heading_skip, question_headings, blank_anchors, generic_anchors, authority_links, authority_follow
  from page_facts left join f using (url, fetched_at) left join h using (url) left join a using (url)
), b as (
  select *, {S.path("final_url")} as url_path, regexp_matches({S.path("final_url")}, '[A-Z]') as url_upper, len(list_filter(string_split({S.query("final_url")}, '&'), lambda x: x <> '')) as url_params,
    regexp_matches({S.path("final_url")} || case when {S.query("final_url")} <> '' then '?' || {S.query("final_url")} else '' end, '(?i){dims.PAGINATED}') and not regexp_matches({S.path("final_url")}, '{dims.NOT_PAGINATED}') as paginated,
    regexp_matches(title, '(?i){dims.TITLE_NUMBER}') as title_numbered, case when section_headings > 0 then cast(round(word_count / (section_headings + 1)) as bigint) else word_count end as words_per_section
  from j
)"""
_USED = "page_id audit_id url depth status title meta_description html_lang word_count avg_sentence_length readability internal_link_count external_link_count final_url noindex response_time_ms html_size hops temporary_hops has_headers cache_control hsts compressed h1_count section_headings heading_skip question_headings kept_internal kept_external blank_anchors generic_anchors authority_links authority_follow url_path url_upper url_params paginated title_numbered words_per_section".split()
_RULES = " union all ".join(
    f"select page_id, audit_id, url, '{r.id}' as rule_id, '{r.severity}' as severity, '{r.category}' as category, {r.detail} as detail from b where {r.when}" for r in rules.applicable(_USED)
)
_ISSUES = f"{_FACTS}, i as ({_RULES})"
_WEIGHTS = " ".join(f"when '{k}' then {v}" for k, v in dims.SEVERITY_WEIGHT.items())
_DIM = ", ".join(f"('{c}', cast({w} as double))" for c, w in dims.CATEGORY_WEIGHT.items())
_SCORES = f"""{_ISSUES}, c as (
  select category, weight, cast(coalesce(penalty, 0) as bigint) as penalty,
    cast(least(100, greatest(0, round(10000 / (100 + {dims.SCORE_CURVE} * coalesce(penalty, 0) / cast(greatest((select count(*) from page_facts), 1) as double))))) as bigint) as score
  from (values {_DIM}) d(category, weight) left join (select category, sum(case severity {_WEIGHTS} end) as penalty from i group by category) using (category)
)"""
_SEV = "count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'notice') as notices"
ORACLES = {
    "url_features": rf"select page_id, {S.site('url')} as site, regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) as host, length({S.path('url')}) as path_length, {S.norm('url')} as normal, len(list_filter(string_split({S.query('url')}, '&'), lambda x: x <> '')) as params, starts_with(lower(url), 'https://') as https, regexp_replace({S.path('url')}, '[-_/]', ' ', 'g') as slug from page_facts",
    "url_canonical_groups": f"select {_CANON} as canonical, count(*) as pages, min(page_id) as first_page from page_facts group by 1 having count(*) > 1",
    "page_text_stats": f"select page_id, {_n(_b)} as words, {_n(S.sentences('body_text'))} as sentences, {_avg} as avg_sentence, len(list_filter({S.sentences('body_text')}, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) > 25)) as long_sentences, cast(greatest(0, least(100, round(120 - {_avg} * 2.2 - (case when {_n(_b)} > 0 then length(regexp_replace(body_text, '\\s', '', 'g')) / {_n(_b)} else 5 end) * 5))) as bigint) as readability, cast(greatest(1, round({_n(_b)} / 200)) as bigint) as reading_minutes from page_facts where body_text is not null",
    "text_signals": rf"select doc_id, {_fl} as fluff, len(regexp_extract_all(coalesce(text, ''), '(?i){dims.UNIT}')) + len(regexp_extract_all(coalesce(text, ''), '{dims.PERCENT}')) as stats, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{_CAP}(?:\s+{_CAP}){{0,3}}'), lambda e: lower(e)))) as entities from documents",
    "heading_profile": _HEADINGS,
    "anchor_profile": _ANCHORS,
    "rule_issues": f"{_ISSUES} select page_id, rule_id, severity, category, detail from i",
    "severity_pivot": f"{_ISSUES} select audit_id, {_SEV} from i group by audit_id",
    "issue_rollup": f"{_ISSUES} select severity, category, rule_id, count(*) as n, min(struct_pack(u := url, d := detail)).d as first_detail, array_to_string(list_sort(list_distinct(list(url)))[1:5], '|') as examples from i group by severity, category, rule_id",
    "category_scores": f"{_SCORES} select category, penalty, score from c",
    "overall_score": f"{_SCORES}, o as (select cast(round(sum(score * weight) / sum(weight)) as bigint) as score from c) select score, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 45 then 'D' else 'F' end as grade from o",
    "page_issue_weights": f"{_ISSUES} select page_id, {_SEV}, errors * 100 + warnings * 10 + notices as weight from i group by page_id",
    "worst_pages": f"{_ISSUES}, w as (select audit_id, page_id, count(*) filter (severity = 'error') * 100 + count(*) filter (severity = 'warning') * 10 + count(*) filter (severity = 'notice') as weight from i where audit_id is not null group by audit_id, page_id) select audit_id, page_id, weight, row_number() over (partition by audit_id order by weight desc, page_id) as rank from w qualify rank <= 10",
    "latest_pages": f"with k as (select *, {_CANON} as canonical from page_facts) select canonical, page_id, status from k qualify row_number() over (partition by canonical order by fetched_at desc nulls last, page_id desc) = 1",
}
