"""Cross-page queries: duplicates, link targets, sitemap sets, similarity, graph, history, robots, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import urls as U
from ..operators import graph, history, similarity, site
from ..plans.lineage import stored
from ..plans.topk import top
from ..sources import robots
from ..sources.tables import spread, table
from ..streaming import progress
from . import sql as S


def duplicate_titles(s: SparkSession, d: str) -> DataFrame:
    return site.duplicate_values(table(s, d, "page_facts"), "title").select("site", "value", "n", F.array_join("examples", "|").alias("examples"))


def duplicate_descriptions(s: SparkSession, d: str) -> DataFrame:
    return site.duplicate_values(table(s, d, "page_facts"), "meta_description").select("site", "value", "n", F.array_join("examples", "|").alias("examples"))


def link_in_degrees(s: SparkSession, d: str) -> DataFrame:
    return site.in_degrees(table(s, d, "page_facts"), table(s, d, "links"))


def orphan_pages(s: SparkSession, d: str) -> DataFrame:
    return site.orphans(table(s, d, "page_facts"), table(s, d, "links"), table(s, d, "audit_runs"))


def broken_targets(s: SparkSession, d: str) -> DataFrame:
    return site.broken_targets(table(s, d, "links"), table(s, d, "fetches"))


def redirect_targets(s: SparkSession, d: str) -> DataFrame:
    return site.redirect_targets(table(s, d, "links"), table(s, d, "fetches"))


def _sitemap(s: SparkSession, d: str) -> DataFrame:
    """Stands in for a sitemap: what was fetched at depth 0 to 2."""
    return table(s, d, "fetches").filter("depth <= 2").select("url")


def sitemap_not_indexable(s: SparkSession, d: str) -> DataFrame:
    return site.sitemap_not_indexable(site.with_noindex(table(s, d, "page_facts"), table(s, d, "fetches")), _sitemap(s, d))


def pages_outside_sitemap(s: SparkSession, d: str) -> DataFrame:
    return site.outside_sitemap(site.with_noindex(table(s, d, "page_facts"), table(s, d, "fetches")), _sitemap(s, d))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "links").filter("internal").select(U.site_of(F.col("src_url")).alias("site"), U.url_norm(F.col("src_url")).alias("src"), U.url_norm(F.col("href")).alias("dst"))


def missing_return_links(s: SparkSession, d: str) -> DataFrame:
    return site.missing_return_edges(_edges(s, d))


def redirect_chains(s: SparkSession, d: str) -> DataFrame:
    """Two-step chains over the hops of all redirect chains."""
    hops = table(s, d, "fetches").select(F.explode("redirect_chain").alias("h")).select(F.col("h.from_url").alias("src"), F.col("h.to_url").alias("dst"))
    return site.two_step_chains(hops)


def trust_pages(s: SparkSession, d: str) -> DataFrame:
    return site.trust_pages(table(s, d, "page_facts"), table(s, d, "links"))


def depth_histogram(s: SparkSession, d: str) -> DataFrame:
    return site.depth_histogram(table(s, d, "page_facts"))


def site_stats(s: SparkSession, d: str) -> DataFrame:
    return site.site_stats(table(s, d, "page_facts"))


def external_targets(s: SparkSession, d: str) -> DataFrame:
    return site.external_targets(table(s, d, "links")).select("href", "links", F.array_join("examples", "|").alias("examples"))


def domain_flags(s: SparkSession, d: str) -> DataFrame:
    return site.domain_flags(table(s, d, "fetches"))


def site_issues(s: SparkSession, d: str) -> DataFrame:
    i = site.site_issues(table(s, d, "page_facts"), table(s, d, "links"), table(s, d, "fetches"))
    return i.groupBy("site", "rule_id", "severity", "category").agg(F.count("*").alias("n"))


def advised_issues(s: SparkSession, d: str) -> DataFrame:
    from ..operators import crawl, rules
    from .pages import facts

    i = rules.issues(facts(s, d), ["page_id"])
    return i.groupBy("rule_id", crawl.advice(F.col("rule_id"), F.col("category")).alias("advice")).agg(F.count("*").alias("n"))


def crawl_frontier(s: SparkSession, d: str) -> DataFrame:
    """What a crawl from the start pages visits, under the robots rules of ``robots_admission``."""
    from ..operators import crawl

    links = table(s, d, "links").filter("internal")
    files = links.select(U.origin_of(F.col("href")).alias("origin")).distinct().withColumn("raw", F.lit(ROBOTS))
    roots = table(s, d, "page_facts").filter("depth = 0").select("url")
    start = crawl.seeds(table(s, d, "audit_runs").select(F.col("start_url").alias("url")).unionByName(roots))
    return crawl.expand(start, links, robots.for_agent(robots.rules(files), "another/1.0"))


def kept_html_facts(s: SparkSession, d: str) -> DataFrame:
    """Facts parsed from the bodies that were kept."""
    from ..operators import extract

    bodies = table(s, d, "fetches").filter("body is not null").groupBy("final_url").agg(F.min("body").alias("html"))
    f = extract.page_facts(bodies, "final_url", "html")
    return f.select("url", "title", "title_count", "html_lang", "html_size", F.size(F.split("body_text", "\n")).cast("long").alias("lines"))


def near_duplicate_pages(s: SparkSession, d: str) -> DataFrame:
    return similarity.near_duplicates(spread(table(s, d, "page_facts")), "page_id", F.concat_ws(" ", "title", "body_sample")).select(F.col("doc").alias("page_id"), "class_id", "links")


def near_duplicate_documents(s: SparkSession, d: str) -> DataFrame:
    return similarity.near_duplicates(spread(table(s, d, "documents")), "doc_id", F.col("text")).select(F.col("doc").alias("doc_id"), "class_id", "links")


def _headed(s: SparkSession, d: str) -> DataFrame:
    h1 = table(s, d, "headings").filter("level = 1").groupBy("url").agg(F.min_by("text", F.struct("pos", "text")).alias("h1"))
    return site.indexable(table(s, d, "page_facts")).join(h1, "url", "left")


def cannibal_pages(s: SparkSession, d: str) -> DataFrame:
    p = similarity.cannibal_pairs(_headed(s, d), "page_id", F.col("title"), F.col("h1"))
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


def cannibal_members(s: SparkSession, d: str) -> DataFrame:
    """The pages behind the representatives of ``cannibal_pages``: pages of one class_id have equal title and h1 tokens."""
    return similarity.cannibal_members(_headed(s, d), "page_id", F.col("title"), F.col("h1")).select(F.col("doc").alias("page_id"), "class_id", "links")


def page_rank(s: SparkSession, d: str) -> DataFrame:
    nodes = site.indexable(table(s, d, "page_facts")).select(U.site_of(F.col("url")).alias("site"), U.url_norm(F.col("url")).alias("node"))
    r = graph.page_rank(nodes, _edges(s, d))
    return r.select("site", "node", F.round("rank", 9).alias("rank"))


def _scaled(s: SparkSession, d: str) -> DataFrame:
    """PageRank of each site's pages, scaled to 100 for its strongest."""
    r = stored(page_rank(s, d), "page-rank")
    most = r.groupBy("site").agg(F.max("rank").alias("m"))
    return r.join(most, "site").select("site", "node", "rank", F.round(F.col("rank") * 100 / F.col("m") - 1e-7).cast("long").alias("scaled"))


def strong_pages(s: SparkSession, d: str) -> DataFrame:
    """Top-k report: the eight strongest pages of each site."""
    return top(_scaled(s, d), ["site"], [F.desc("rank"), F.col("node")], 8).select("site", "node", "scaled")


def weak_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages at depth 0 or 1 that the links of their site leave weak."""
    depth = site.indexable(table(s, d, "page_facts")).groupBy(U.site_of(F.col("url")).alias("site"), U.url_norm(F.col("url")).alias("node")).agg(F.min("depth").alias("depth"))
    return site.weak_important(_scaled(s, d).join(depth, ["site", "node"]))


def bfs_depth(s: SparkSession, d: str) -> DataFrame:
    starts = table(s, d, "audit_runs").select(U.url_norm(F.col("start_url")).alias("node")).distinct()
    roots = table(s, d, "page_facts").filter("depth = 0").select(U.url_norm(F.col("url")).alias("node"))
    return graph.bfs_depth(starts.unionByName(roots), _edges(s, d)).select("node", F.col("depth").cast("long").alias("depth"))


def undirected_links(s: SparkSession, d: str) -> DataFrame:
    return graph.undirected_weights(table(s, d, "links").select(U.site_of(F.col("src_url")).alias("src"), U.site_of(F.col("href")).alias("dst")))


def embedding_neighbours(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return similarity.dense_neighbours(e, e.filter("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "cosine")


def history_projects(s: SparkSession, d: str) -> DataFrame:
    return history.projects(table(s, d, "audit_runs")).select("domain", "audit_id", F.col("score").cast("double").alias("score"), "grade", "audits")


def history_deltas(s: SparkSession, d: str) -> DataFrame:
    return history.deltas(table(s, d, "audit_runs"))


def history_retained(s: SparkSession, d: str) -> DataFrame:
    return history.retained(table(s, d, "audit_runs")).select("audit_id", "domain", "pages")


def history_issue_changes(s: SparkSession, d: str) -> DataFrame:
    """Rules that fire on a site in its first or second half of fetches only: two runs compared by rule."""
    from ..operators import rules
    from .pages import facts

    f = rules.issues(facts(s, d).join(table(s, d, "page_facts").select("page_id", "fetched_at"), "page_id"), ["url", "fetched_at"]).select(U.site_of(F.col("url")).alias("site"), "rule_id", "fetched_at")
    at = F.lit("2025-06-01").cast("timestamp")
    return history.compare_issues(f.filter(F.col("fetched_at") < at), f.filter(F.col("fetched_at") >= at), ["site", "rule_id"])


ROBOTS = "User-agent: *\nDisallow: /shop/\nAllow: /shop/lamp\nDisallow: /*utm_source=\nDisallow: /blog/*-1$\n\nUser-agent: other\nUser-agent: siteloom\nDisallow: /p/\nAllow: /p/t\nDisallow: /*/*-10*9$\nAllow: /\n"


def robots_admission(s: SparkSession, d: str) -> DataFrame:
    """The same robots.txt for every origin, under an agent that has a group of its own."""
    pages = table(s, d, "page_facts").select("page_id", "url")
    files = pages.select(U.origin_of(F.col("url")).alias("origin")).distinct().withColumn("raw", F.lit(ROBOTS))
    return robots.admitted(pages, robots.for_agent(robots.rules(files), "Siteloom/1.0")).select("page_id", "allowed")


def progress_windows(s: SparkSession, d: str) -> DataFrame:
    return progress.window_counts(table(s, d, "events"))


def progress_sessions(s: SparkSession, d: str) -> DataFrame:
    return progress.session_counts(table(s, d, "events"))


def progress_log(s: SparkSession, d: str) -> DataFrame:
    return progress.latest_log(table(s, d, "events")).select("event_id", "event_type", "value")


QUERIES = {
    f.__name__: f
    for f in (duplicate_titles, duplicate_descriptions, link_in_degrees, orphan_pages, broken_targets, redirect_targets, sitemap_not_indexable, pages_outside_sitemap, missing_return_links, redirect_chains, trust_pages, depth_histogram, site_stats, external_targets, domain_flags, site_issues, advised_issues, crawl_frontier, kept_html_facts, near_duplicate_pages, near_duplicate_documents, cannibal_pages, cannibal_members, page_rank, strong_pages, weak_pages, bfs_depth, undirected_links, embedding_neighbours, history_projects, history_deltas, history_retained, history_issue_changes, robots_admission, progress_windows, progress_sessions, progress_log)
}

_SITE, _NORM = S.site("url"), S.norm("url")
_OK = "status >= 200 and status < 300"


def _dup(c: str) -> str:
    return f"with v as (select {_SITE} as site, lower(trim(both ' ' from {c})) as value, url from page_facts where {_OK}) select site, value, count(*) as n, array_to_string(list_sort(list_distinct(list(url)))[1:10], '|') as examples from v where value <> '' group by site, value having count(*) > 1"


_DEGREES = f"""n as (select distinct {_NORM} as url from page_facts where {_OK}), e as (
  select {S.norm('href')} as url, count(*) as n from links where internal and {S.norm('src_url')} in (select url from n) group by 1
), g as (select n.url, coalesce(e.n, 0) as in_degree from n left join e using (url))"""
_STATUS = f"""u as (select {_NORM} as url, status, len(redirect_chain) as hops, fetched_at from fetches union all select {S.norm('final_url')}, status, len(redirect_chain), fetched_at from fetches),
 st as (select url, max(row(fetched_at, status, hops)) as x from u where url is not null group by url),
 ed as (select distinct {S.norm('src_url')} as src, {S.norm('href')} as url from links where internal),
 tg as (select url as target, x[2] as status, x[3] as hops, count(*) as sources from ed join st using (url) group by 1, 2, 3)"""
_MAP = f"select distinct {_NORM} from fetches where depth <= 2"
_E = f"e as (select distinct {S.site('src_url')} as site, {S.norm('src_url')} as src, {S.norm('href')} as dst from links where internal and {S.norm('src_url')} <> {S.norm('href')})"
_N = f"nd as (select distinct {_SITE} as site, {_NORM} as node from page_facts where {_OK})"
_RANK = f"""{_E}, {_N}, ee as (select e.* from e where (site, src) in (select (site, node) from nd) and (site, dst) in (select (site, node) from nd)),
 oc as (select site, src, count(*) as o from ee group by 1, 2), bs as (select nd.site, node, cast(count(*) over (partition by nd.site) as double) as n, o is null as dangling from nd left join oc on oc.site = nd.site and oc.src = node),
 w as (select ee.site, ee.src, dst, 1.0::double / o as w from ee join oc on oc.site = ee.site and oc.src = ee.src), r0 as materialized (select site, node, 1.0::double / n as rank from bs)""" + "".join(
    f""", r{i} as materialized (select bs.site, bs.node, {1 - dims.DAMPING} / n + {dims.DAMPING} * (coalesce(f.flow, 0) + coalesce(l.lost, 0) / n) as rank from bs
   left join (select w.site, dst as node, sum(rank * w) as flow from w join r{i - 1} r on r.site = w.site and r.node = w.src group by 1, 2) f on f.site = bs.site and f.node = bs.node
   left join (select r.site, sum(rank) as lost from r{i - 1} r join bs b on b.site = r.site and b.node = r.node where b.dangling group by 1) l on l.site = bs.site)"""
    for i in range(1, dims.PAGERANK_ROUNDS + 1)
)
_SHINGLE = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _near(key: str, text: str, source: str, k: int = dims.SHINGLE, least: float = dims.NEAR_DUPLICATE) -> str:
    return f"""with w as (select {key} as doc, {_SHINGLE.format(text)} as w from {source}),
 s as (select doc, list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))) as items from w where len(w) >= {k}),
 m as (select doc, min(doc) over (partition by items) as class_id from s), c as (select doc, items, len(items) as n from s where doc in (select class_id from m)),
 x as (select doc, n, unnest(items) as item from c), p as (select a.doc as a, b.doc as b, a.n as na, b.n as nb, count(*) as both from x a join x b on a.item = b.item and a.doc < b.doc group by 1, 2, 3, 4 having count(*) >= {least} * (a.n + b.n - count(*))),
 l as (select doc, count(*) as links from (select a as doc from p union all select b from p) group by doc)
 select m.doc as {key}, class_id, coalesce(links, 0) as links from m left join l on l.doc = class_id"""


_RUNS = r"r as (select * replace (regexp_replace(lower(trim(domain)), '^www\.', '') as domain) from audit_runs qualify row_number() over (partition by audit_id) = 1), o as (select *, row_number() over (partition by domain order by generated_at desc nulls last, audit_id desc) as k, count(*) over (partition by domain) as audits from r)"
_P = S.path("url")
_NOINDEX = "ni as (select url, fetched_at, bool_or(coalesce(contains(lower(headers['x-robots-tag']), 'noindex'), false)) as noindex from fetches group by 1, 2), pn as (select page_facts.*, coalesce(noindex, false) as noindex from page_facts left join ni using (url, fetched_at))"
_SCALED = f"sc as (select site, node, round(rank, 9) as rank, cast(round(round(rank, 9) * 100 / max(round(rank, 9)) over (partition by site) - 1e-7) as bigint) as scaled from r{dims.PAGERANK_ROUNDS})"
ORACLES = {
    "duplicate_titles": _dup("title"),
    "duplicate_descriptions": _dup("meta_description"),
    "link_in_degrees": f"with {_DEGREES} select url, in_degree from g",
    "orphan_pages": f"with {_DEGREES} select url from g where in_degree = 0 and url not in (select {S.norm('start_url')} from audit_runs)",
    "broken_targets": f"with {_STATUS} select target, status, sources from tg where status >= 400 or status = 0",
    "redirect_targets": f"with {_STATUS} select target, hops, sources from tg where hops > 0 and status > 0 and status < 400",
    "sitemap_not_indexable": f"with {_NOINDEX} select page_id, url, status from pn where (not ({_OK}) or noindex) and {_NORM} in ({_MAP})",
    "pages_outside_sitemap": f"with {_NOINDEX} select page_id, url from pn where {_OK} and not noindex and {_NORM} not in ({_MAP})",
    "strong_pages": f"with {_RANK}, {_SCALED} select site, node, scaled from sc qualify row_number() over (partition by site order by rank desc, node) <= 8",
    "weak_pages": f"""with {_RANK}, {_SCALED}, dp as (select {S.site('url')} as site, {_NORM} as node, min(depth) as depth from page_facts where {_OK} group by 1, 2),
 cu as (select site, list(scaled order by scaled desc) as l from sc group by site), ct as (select site, case when len(l) > 4 then l[cast(floor(len(l) * 0.75) as int) + 1] else 0 end as cut from cu)
 select site, node, scaled, cast(depth as int) as depth from sc join dp using (site, node) join ct using (site) where depth <= 1 and scaled <= cut and scaled < 40""",
    "missing_return_links": f"with {_E} select a.src, a.dst from e a where a.dst in (select src from e) and not exists (select 1 from e b where b.src = a.dst and b.dst = a.src)",
    "redirect_chains": "with h as (select unnest(redirect_chain) as h from fetches), m as (select distinct h.from_url as src, h.to_url as dst from h where h.from_url <> h.to_url) select a.src, a.dst as middle, b.dst as last from m a join m b on a.dst = b.src where a.src <> b.dst or b.dst <> a.dst",
    "trust_pages": f"with t as (select {_SITE} as site, lower(url) as t from page_facts union all select {S.site('src_url')}, lower(concat_ws(' ', href, text)) from links where internal) select site, " + ", ".join(f"bool_or(regexp_matches(t, '{p}')) as {k}" for k, p in dims.TRUST.items()) + " from t group by site",
    "depth_histogram": "select depth, count(*) as pages, count(*) filter (depth >= 4) as deep from page_facts group by depth",
    "site_stats": f"select {_SITE} as site, count(*) as pages, count(*) filter ({_OK}) as indexable, count(*) filter (status >= 400 or status = 0) as failed, cast(sum(word_count) as bigint) as words, max(depth) as max_depth, count(*) filter (depth >= 4) as deep_pages, round(avg(word_count) filter ({_OK}), 6) as avg_words, cast(sum(internal_link_count) as bigint) as internal_links from page_facts group by 1",
    "external_targets": "select href, count(*) as links, array_to_string(list_sort(list_distinct(list(src_url)))[1:5], '|') as examples from links where not internal and href is not null group by href",
    "domain_flags": f"select {_SITE} as site, coalesce(bool_or(starts_with(lower(url), 'http://') and starts_with(lower(final_url), 'http://') and ok), false) as http_stays, coalesce(bool_or(regexp_matches(lower(final_url), '^https?://www\\.') and ok) and bool_or(not regexp_matches(lower(final_url), '^https?://www\\.') and ok), false) as both_hosts from fetches group by 1",
    "kept_html_facts": r"with b as (select final_url as url, min(body) as h from fetches where body is not null group by 1) select url, trim(regexp_replace(regexp_extract(h, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) as title, len(regexp_extract_all(h, '<title>')) as title_count, nullif(regexp_extract(h, '<html lang=\"([^\"]*)\"', 1), '') as html_lang, length(h) as html_size, len(list_filter(regexp_extract_all(h, '<div>([^<]*)</div>', 1), lambda x: regexp_matches(x, '[^\s\x{00a0}\x{2009}]'))) as lines from b",
    "near_duplicate_pages": _near("page_id", "concat_ws(' ', title, body_sample)", "page_facts"),
    "near_duplicate_documents": _near("doc_id", "text", "documents"),
    "cannibal_pages": f"""with h as (select url, min(row(pos, text))[2] as h1 from headings where level = 1 group by url), t as (select page_id, list_sort(list_distinct(list_filter(string_split({S.clean("concat_ws(' ', title, h1)")}, ' '), lambda t: length(t) > 2 and not list_contains({S.quoted(dims.TITLE_STOP)}, t)))) as items from page_facts left join h using (url) where {_OK}),
 c as (select min(page_id) as doc, items, len(items) as n from t where len(items) >= 2 group by items), x as (select doc, n, unnest(items) as item from c)
 select a.doc as a, b.doc as b, round(count(*) / (a.n + b.n - count(*)), 6) as similarity from x a join x b on a.item = b.item and a.doc < b.doc group by a.doc, b.doc, a.n, b.n having count(*) >= {dims.CANNIBAL} * (a.n + b.n - count(*))""",
    "cannibal_members": f"""with h as (select url, min(row(pos, text))[2] as h1 from headings where level = 1 group by url), t as (select page_id, list_sort(list_distinct(list_filter(string_split({S.clean("concat_ws(' ', title, h1)")}, ' '), lambda t: length(t) > 2 and not list_contains({S.quoted(dims.TITLE_STOP)}, t)))) as items from page_facts left join h using (url) where {_OK}),
 m as (select page_id, items, min(page_id) over (partition by items) as class_id from t where len(items) >= 2), c as (select page_id as doc, items, len(items) as n from m where page_id = class_id), x as (select doc, n, unnest(items) as item from c),
 p as (select a.doc as a, b.doc as b from x a join x b on a.item = b.item and a.doc < b.doc group by a.doc, b.doc, a.n, b.n having count(*) >= {dims.CANNIBAL} * (a.n + b.n - count(*))), l as (select doc, count(*) as links from (select a as doc from p union all select b from p) group by doc)
 select page_id, class_id, coalesce(links, 0) as links from m left join l on l.doc = class_id""",
    "page_rank": f"with {_RANK} select site, node, round(rank, 9) as rank from r{dims.PAGERANK_ROUNDS}",
    "bfs_depth": f"with recursive {_E}, s as (select {S.norm('start_url')} as node from audit_runs union select {_NORM} from page_facts where depth = 0), b(node, depth) as (select distinct node, 0 from s union select e.dst, b.depth + 1 from b join e on e.src = b.node where b.depth < 12) select node, cast(min(depth) as bigint) as depth from b group by node",
    "undirected_links": f"with l as (select {S.site('src_url')} as src, {S.site('href')} as dst from links) select least(src, dst) as a, greatest(src, dst) as b, count(*) as weight from l where src <> dst group by 1, 2",
    "embedding_neighbours": "with q as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id) select query_id, vec_id, row_number() over (partition by query_id order by round(c, 6) desc, vec_id) as rank, round(c, 6) as cosine from q qualify rank <= 10",
    "history_projects": f"with {_RUNS} select domain, audit_id, cast(score as double) as score, grade, audits from o where k = 1",
    "history_deltas": f"with {_RUNS} select a.domain, b.audit_id as before, a.audit_id as after, " + ", ".join(f"cast(coalesce(a.{c}, 0) - coalesce(b.{c}, 0) as bigint) as {c}_delta" for c in ("score", "errors", "warnings", "pages")) + " from o a join o b on a.domain = b.domain and a.k = 1 and b.k = 2",
    "history_retained": f"with {_RUNS} select audit_id, domain, pages from r order by generated_at desc nulls last, audit_id desc limit 200",
    "robots_admission": rf"select page_id, not regexp_matches({_P}, '^/p/') or regexp_matches({_P}, '^/p/t') as allowed from (select page_id, url from page_facts where not regexp_matches({_P}, '^/.*/.*-10.*9$')) union all select page_id, case when regexp_matches({_P}, '^/p/t') and 4 > 10 then true else false end from page_facts where regexp_matches({_P}, '^/.*/.*-10.*9$')",
    "progress_windows": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as events, round(sum(value), 4) as value_sum from events group by 1, 2",
    "progress_sessions": "with p as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events), g as (select user_id, ts, sum(case when before is null or ts >= before + interval '30 minutes' then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as g from p) select user_id, min(ts) as start, count(*) as events from g group by user_id, g",
    "progress_log": "select event_id, event_type, value from events order by ts desc, event_id desc limit 200",
}


def _site_issues() -> str:
    o = ORACLES
    host = S.site
    parts = [
        ("SITE_DUPLICATE_TITLE", "warning", "meta", f"select site from ({o['duplicate_titles']})"),
        ("SITE_DUPLICATE_DESCRIPTION", "warning", "meta", f"select site from ({o['duplicate_descriptions']})"),
        ("SITE_ORPHAN", "warning", "architecture", f"select {host('url')} as site from ({o['link_in_degrees']}) where in_degree = 0"),
        ("SITE_BROKEN_LINK", "error", "links", f"select {host('target')} as site from ({o['broken_targets']})"),
        ("SITE_REDIRECTED_LINK", "notice", "links", f"select {host('target')} as site from ({o['redirect_targets']})"),
        ("SITE_NO_TRUST_PAGE", "notice", "usability", " union all ".join(f"select site from ({o['trust_pages']}) where not {k}" for k in dims.TRUST)),
        ("SITE_HTTP_STAYS", "error", "security", f"select site from ({o['domain_flags']}) where http_stays"),
        ("SITE_BOTH_HOSTS", "warning", "indexability", f"select site from ({o['domain_flags']}) where both_hosts"),
    ]
    rows = " union all ".join(f"select site, '{rule}' as rule_id, '{severity}' as severity, '{category}' as category from ({sql})" for rule, severity, category, sql in parts)
    return f"select site, rule_id, severity, category, count(*) as n from ({rows}) group by 1, 2, 3, 4"


def _from_rules() -> dict[str, str]:
    from ..operators import crawl
    from .pages import _ISSUES

    case = lambda column, table: f"case {column} " + " ".join("when '{}' then '{}'".format(k, v.replace("'", "''")) for k, v in table.items()) + " end"
    return {
        "advised_issues": f"{_ISSUES} select rule_id, coalesce({case('rule_id', crawl.RULE_ADVICE)}, {case('category', crawl.CATEGORY_ADVICE)}, 'Check the page.') as advice, count(*) as n from i group by 1, 2",
        "history_issue_changes": f"""{_ISSUES}, w as (select {S.site('i.url')} as site, rule_id, bool_or(fetched_at < timestamp '2025-06-01') as early, bool_or(fetched_at >= timestamp '2025-06-01') as late from i join page_facts using (page_id) group by 1, 2)
 select site, rule_id, case when late then 'created' else 'resolved' end as change from w where coalesce(early, false) <> coalesce(late, false)""",
    }


ORACLES |= {"site_issues": _site_issues()} | _from_rules()
