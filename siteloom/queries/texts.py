"""Text, topic, keyword and content queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..functions.urls import site_of
from ..operators import content, ir, keywords, site, sparse, topics
from ..plans.lineage import stored
from ..plans.topk import top
from ..sources.tables import spread, table
from . import sql as S


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents"))


def term_weights(s: SparkSession, d: str) -> DataFrame:
    w = ir.tfidf(_docs(s, d), "doc_id", F.col("text"))
    return w.select(F.col("doc").alias("doc_id"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


def top_terms(s: SparkSession, d: str) -> DataFrame:
    w = ir.tfidf(_docs(s, d), "doc_id", F.col("text"))
    return ir.top_terms(w).select(F.col("doc").alias("doc_id"), "term", F.col("rank").cast("long").alias("rank"))


def surface_forms(s: SparkSession, d: str) -> DataFrame:
    return ir.surface_forms(_docs(s, d), "doc_id", F.col("text"))


def keyphrases(s: SparkSession, d: str) -> DataFrame:
    return ir.keyphrases(_docs(s, d), F.col("text"), 3)


def entity_counts(s: SparkSession, d: str) -> DataFrame:
    return ir.entity_counts(_docs(s, d), F.col("text"), 2, 4).filter("n >= 2")


def similar_documents(s: SparkSession, d: str) -> DataFrame:
    """For every document whose id is divisible by 25 (all ids here are odd, so none is by 50), its fifteen most similar ones by cosine of 0.08 or more."""
    found = sparse.similar(_docs(s, d), "doc_id", F.col("text"), F.col("doc") % 25 == 0, 15, 0.08)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), "cosine")


def question_headings(s: SparkSession, d: str) -> DataFrame:
    return topics.question_headings(table(s, d, "headings"))


def _typed(s: SparkSession, d: str) -> DataFrame:
    t = topics.page_type(F.col("url"), F.col("title"), F.lit(None).cast("string"), F.col("word_count"), F.col("internal_link_count"), F.lit(False))
    return table(s, d, "page_facts").withColumn("t", t).withColumn("type", F.col("t.type"))


def page_types(s: SparkSession, d: str) -> DataFrame:
    return _typed(s, d).select("page_id", "type", F.col("t.confidence").alias("confidence"))


def page_type_histogram(s: SparkSession, d: str) -> DataFrame:
    return topics.type_histogram(_typed(s, d))


def _topic_parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    h = table(s, d, "headings").groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "pos", "text"))), lambda x: x["text"]), " ").alias("headings"))
    pages = site.indexable(_typed(s, d)).filter(F.col("type").isin("blog", "service", "product", "category", "location", "page")).join(h, "url", "left")
    docs = spread(stored(topics.topic_documents(pages), "topic-texts"))
    w = ir.tfidf(docs, "doc", F.col("text")).join(docs.select("doc", "site"), "doc")
    w = stored(w, "topic-weights")
    return pages, w, stored(topics.cluster(w), "topics")


def topic_clusters(s: SparkSession, d: str) -> DataFrame:
    return _topic_parts(s, d)[2]


def topic_metrics(s: SparkSession, d: str) -> DataFrame:
    pages, w, members = _topic_parts(s, d)
    ids = pages.select(F.col("page_id").cast("string").alias("doc"), "url")
    links = table(s, d, "links").filter("internal").select("src_url", "href").distinct()
    e = links.join(ids.select(F.col("doc").alias("src"), F.col("url").alias("src_url")), "src_url").join(ids.select(F.col("doc").alias("dst"), F.col("url").alias("href")), "href")
    m = topics.metrics(members, pages.select(F.col("page_id").cast("string").alias("doc"), "type", "word_count"), topics.topic_edges(members, e.select("src", "dst")))
    forms = ir.surface_forms(pages, "page_id", F.concat_ws(" ", "title", "headings", "body_sample"))
    return m.join(topics.labels(w, members, forms.select("term", "form")), ["site", "topic"])


def topic_gaps(s: SparkSession, d: str) -> DataFrame:
    return topics.gaps(topic_metrics(s, d))


def completeness(s: SparkSession, d: str) -> DataFrame:
    t = topics.group_terms(_docs(s, d).filter("source is not null"), F.col("source"), "doc_id", F.col("text"))
    return topics.completeness(stored(t, "group-terms")).select(F.col("grp").alias("source"), F.col("doc").alias("doc_id"), "expected", "covered", "completeness", F.array_join("missing", " ").alias("missing"))


def content_gap(s: SparkSession, d: str) -> DataFrame:
    """Words of the titles of the largest site's pages against those of all other sites: which pages' subjects it lacks."""
    p = stored(table(s, d, "page_facts").select(site_of(F.col("url")).alias("site"), F.col("page_id").alias("topic"), F.array_distinct(X.tokens(F.col("title"))).alias("words")), "title-words")
    first = p.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").limit(1).select("site")
    side = lambda how: p.join(F.broadcast(first), "site", how).filter(F.size("words") > 0).select("topic", "words")
    return topics.content_gap(side("left_anti"), side("left_semi")).withColumn("best", F.col("best").cast("string"))


def _keywords(s: SparkSession, d: str) -> DataFrame:
    """Phrases to match: first and second headings, and the texts of internal links."""
    h = table(s, d, "headings").filter("level <= 2").select(F.col("text").alias("keyword"))
    a = table(s, d, "links").filter("internal and length(trim(text)) > 3").select(F.col("text").alias("keyword"))
    return h.unionByName(a).distinct()


def _keyword_pages(s: SparkSession, d: str) -> DataFrame:
    hs = table(s, d, "headings").groupBy("url").agg(F.min_by("text", F.struct("level", "pos", "text")).alias("h1"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "pos", "text"))), lambda x: x["text"]), " ").alias("headings"))
    return site.indexable(spread(table(s, d, "page_facts"))).join(hs, "url", "left")


def keyword_intents(s: SparkSession, d: str) -> DataFrame:
    return keywords.intents(_keywords(s, d))


def keyword_slugs(s: SparkSession, d: str) -> DataFrame:
    return _keywords(s, d).select("keyword", keywords.slug(F.col("keyword")).alias("slug"), keywords.is_local(F.col("keyword")).alias("local"))


def keyword_profiles(s: SparkSession, d: str) -> DataFrame:
    return keywords.profile(_keyword_pages(s, d)).groupBy("token").agg(F.count("*").alias("pages"), F.sum("weight").cast("long").alias("weight"))


def keyword_best_pages(s: SparkSession, d: str) -> DataFrame:
    return keywords.best_pages(_keywords(s, d).filter("keyword is not null"), _keyword_pages(s, d))


def keyword_assignments(s: SparkSession, d: str) -> DataFrame:
    return keywords.assignments(keyword_best_pages(s, d)).select("page_id", "keywords", "main", F.col("main_score").cast("long").alias("main_score"))


def keyword_clusters(s: SparkSession, d: str) -> DataFrame:
    return keywords.clusters(_keywords(s, d))


def title_templates(s: SparkSession, d: str) -> DataFrame:
    k = keyword_best_pages(s, d).filter("assigned")
    lists = top(k, ["page_id"], [F.desc("score"), F.col("keyword")], 6).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("ks"))
    brand = table(s, d, "page_facts").select("page_id", F.initcap(F.split(site_of(F.col("url")), r"[.-]")[0]).alias("brand"))
    return lists.join(brand, "page_id").select("page_id", keywords.title_template(F.col("ks")[0], F.slice("ks", 2, 10), F.col("brand")).alias("title"))


def reference_terms(s: SparkSession, d: str) -> DataFrame:
    t = content.reference_terms(_docs(s, d), F.col("source"), "doc_id", F.col("text"))
    return t.select(F.col("grp").alias("source"), "term", "df", F.col("rank").cast("long").alias("rank"))


def median_lengths(s: SparkSession, d: str) -> DataFrame:
    w = _docs(s, d).filter("source is not null").select("source", X.word_count(F.col("text")).alias("words"))
    return content.upper_median(w, ["source"], "words")


def content_scores(s: SparkSession, d: str) -> DataFrame:
    terms = stored(content.reference_terms(_docs(s, d), F.col("source"), "doc_id", F.col("text")), "reference-terms")
    median = median_lengths(s, d).select(F.col("source").alias("grp"), "median")
    return content.score_texts(_docs(s, d), F.col("source"), "doc_id", F.col("text"), terms, median).select(F.col("grp").alias("source"), F.col("doc").alias("doc_id"), "coverage", "words", "score", "grade")


def weakest_texts(s: SparkSession, d: str) -> DataFrame:
    """Top-k report: the six weakest texts of each source."""
    c = content_scores(s, d).select(F.col("source").alias("grp"), F.col("doc_id").alias("doc"), "score", "grade")
    return content.batch_ranking(c).select(F.col("grp").alias("source"), F.col("doc").alias("doc_id"), "score", "grade", F.col("rank").cast("long").alias("rank"))


def content_plan(s: SparkSession, d: str) -> DataFrame:
    """New pages for clusters of unmatched keywords, pillars for topics that lack one, expansions of incomplete texts, by month."""
    un = stored(keyword_best_pages(s, d).filter("not assigned").select("keyword"), "unmatched")
    of = keywords.clusters(un).groupBy("cluster").agg(F.count("*").alias("keywords"), F.bool_or(keywords.is_local(F.col("keyword"))).alias("local"))
    new = of.select(F.col("cluster").alias("title"), keywords.intent(F.col("cluster")).alias("intent"), "local", "keywords")
    few = completeness(s, d).select(F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), "completeness")
    pillars = topic_metrics(s, d).select(F.concat_ws(": ", "site", "label").alias("label"), "size", "has_pillar")
    return content.plan(content.plan_items(new, pillars, few)).select("action", "title", F.round("priority", 6).alias("priority"), "place", "month")


def brief_outlines(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "headings").withColumn("site", site_of(F.col("url")))
    return content.outline(h, "site").select("site", F.array_join(F.coalesce("headings", F.array().cast("array<string>")), "|").alias("headings"), F.array_join(F.coalesce("questions", F.array().cast("array<string>")), "|").alias("questions"))


def description_templates(s: SparkSession, d: str) -> DataFrame:
    """A description for each page with assigned keywords: the best one, and the next three."""
    k = keyword_best_pages(s, d).filter("assigned")
    lists = top(k, ["page_id"], [F.desc("score"), F.col("keyword")], 4).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("ks"))
    return lists.select("page_id", keywords.description_template(F.col("ks")[0], F.slice("ks", 2, 3), F.lit("Velmaro")).alias("description"))


def _site_headings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "headings").filter("level <= 3 and text is not null").select(site_of(F.col("url")).alias("grp"), F.col("url").alias("doc"), "text")


def missing_questions(s: SparkSession, d: str) -> DataFrame:
    """For every page with headings, the questions of its site's pages that it does not ask."""
    h = _site_headings(s, d)
    return topics.missing_questions(h, h.select("grp", "doc").distinct()).select(F.col("grp").alias("site"), F.col("doc").alias("url"), F.array_join("questions", "|").alias("questions"))


def brief_targets(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "page_facts").select(site_of(F.col("url")).alias("grp"), "url", "word_count")
    t = content.brief_targets(p, table(s, d, "headings").filter("level <= 3"))
    return t.select(F.col("grp").alias("site"), F.col("words").cast("long").alias("words"), F.size("headings").cast("long").alias("headings"))


def topic_totals(s: SparkSession, d: str) -> DataFrame:
    from ..operators import views

    m = stored(topic_metrics(s, d), "topic-metrics")
    return views.graph_totals(m, topics.gaps(m))


QUERIES = {
    f.__name__: f
    for f in (term_weights, top_terms, surface_forms, keyphrases, entity_counts, similar_documents, question_headings, page_types, page_type_histogram, topic_clusters, topic_metrics, topic_gaps, completeness, content_gap, keyword_intents, keyword_slugs, keyword_profiles, keyword_best_pages, keyword_assignments, keyword_clusters, title_templates, reference_terms, median_lengths, content_scores, weakest_texts, content_plan, brief_outlines, description_templates, missing_questions, brief_targets, topic_totals)
}

_T = S.tokens("text")
_TF = f"t as (select doc_id, unnest({_T}) as term from documents), tf as (select doc_id, term, count(*) as tf from t group by 1, 2), df as (select term, count(*) as df from tf group by 1), raw as (select doc_id, term, tf, df, tf * (ln(((select count(*) from documents) + 1.0::double) / (df + 1)) + 1) as w from tf join df using (term)), wt as (select doc_id, term, tf, df, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw)"
_CAP = f"[{dims.CAPITAL}][{dims.SMALL}]+"
_PATH = f"(case when regexp_replace(lower({S.path('url')}), '/+$', '') = '' then '/' else regexp_replace(lower({S.path('url')}), '/+$', '') end)"


def _type_cases(value) -> str:
    out = [f"when p = '/' then {value('homepage', 1.0)}"]
    for name, where, kind, sure in dims.PAGE_TYPE:
        if where:
            more = " or (internal_link_count > 25 and word_count < 300)" if name == "category" else ""
            out.append(f"when regexp_matches(p, '{where}') or regexp_matches(t, '{where}'){more} then {value(name, sure)}")
    return "case " + " ".join(out) + f" else {value('page', 0.4)} end"


_TYPES = f"with x as (select page_id, {_PATH} as p, lower(coalesce(title, '')) as t, word_count, internal_link_count from page_facts), y as (select page_id, {_type_cases(lambda n, c: repr(n))} as type, {_type_cases(lambda n, c: f'cast({c} as double)')} as confidence from x)"
_KW = "k as (select text as keyword from headings where level <= 2 union select text from links where internal and length(trim(both ' ' from text)) > 3)"
_KN = S.clean("keyword")
_LOCAL = f"(regexp_matches({_KN}, '(^| )({dims.CITIES}|{dims.LOCAL_CUES})( |$)') or regexp_matches(keyword, '\\s[{dims.CAPITAL}][{dims.SMALL}]+'))"
_KTOK = lambda c: S.tokens(c, dims.KEYWORD_STOP, 2, dims.KEYWORD_SUFFIXES)
_HS = "hs as (select url, arg_min(text, row(level, pos, text)) as h1, array_to_string(list(text order by level, pos, text), ' ') as headings from headings group by url)"
_SLUG = f"regexp_replace({S.path('url')}, '[-_/]', ' ', 'g')"
_FIELDS = f"""{_HS}, pg as (select page_facts.*, h1, headings from page_facts left join hs using (url) where status >= 200 and status < 300), fl as (
  select page_id, 'url' as field, 4 as w, {_SLUG} as text from pg union all select page_id, 'title', 5, title from pg union all select page_id, 'h1', 4, h1 from pg
  union all select page_id, 'headings', 2, headings from pg union all select page_id, 'description', 3, meta_description from pg union all select page_id, 'body', 1, body_sample from pg),
 ft as (select page_id, field, w, {_KTOK("text")} as toks from fl), pf as (select page_id, token, max(w) as weight from (select page_id, w, unnest(list_distinct(toks)) as token from ft) group by 1, 2)"""
_BONUS = "case " + " ".join(f"when f_{k} then {v}" for k, v in dims.PHRASE_BONUS.items()) + " else 0 end"
_BEST = f"""{_FIELDS}, {_KW}, ph as (select distinct keyword from k where keyword is not null), kt as (select keyword, {_KTOK("keyword")} as toks from ph), ku as (select keyword, len(toks) as n, array_to_string(toks, ' ') as phrase, unnest(toks) as token from kt),
 hit as (select keyword, phrase, n, page_id, count(*) as covered, sum(weight) as weight from ku join pf using (token) group by 1, 2, 3, 4),
 pn as (select page_id, field, array_to_string(toks, ' ') as s from ft), pw as (select page_id, {", ".join(f"max(case when field = '{k}' then s end) as s_{k}" for k in dims.PHRASE_BONUS)} from pn group by 1),
 sc as (select keyword, page_id, covered, n, weight, {", ".join(f"contains(' ' || s_{k} || ' ', ' ' || phrase || ' ') as f_{k}" for k in dims.PHRASE_BONUS)} from hit join pw using (page_id)),
 sd as (select keyword, page_id, cast(least(100, round({_BONUS} + covered / n * (weight / (n * 5)) * 45)) as bigint) as score from sc),
 be as (select keyword, page_id, score from sd qualify row_number() over (partition by keyword order by score desc, page_id) = 1),
 bp as (select ph.keyword, page_id, score, case when score >= 60 then 'strong' when score >= 40 then 'medium' when score >= 25 then 'weak' else 'none' end as confidence, coalesce(score, 0) >= {dims.ASSIGN_AT} as assigned from ph left join be using (keyword))"""
_REF = f"""so as (select doc_id, source, text from documents where source is not null and len({S.words("text")}) >= 80), rt as (select doc_id, unnest({_T}) as term from so), rf as (select doc_id, term, count(*) as tf from rt group by 1, 2),
 rd as (select term, count(*) as df from rf group by 1), rr as (select doc_id, term, tf * (ln(((select count(*) from so) + 1.0::double) / (df + 1)) + 1) as w from rf join rd using (term)), rw as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from rr),
 rn as (select source, count(*) as n from so group by 1 having count(*) >= 2), rg as (select source, term, count(*) as df, round(sum(weight), 6) as weight from rw join so using (doc_id) group by 1, 2),
 ref as (select source, term, df, row_number() over (partition by source order by weight desc, term) as rank from rg join rn using (source) where df >= greatest(2, ceil(n * 0.3 - 1e-9)) qualify rank <= 40)"""
_MED = f"md as (select source, words as median from (select source, len({S.words('text')}) as words, row_number() over (partition by source order by len({S.words('text')})) as i, count(*) over (partition by source) as n from documents where source is not null) where i = n // 2 + 1)"
_CS = f"""{_REF}, {_MED}, ct as (select doc_id, source, len({S.words("text")}) as words, list_distinct({_T}) as toks from documents where source is not null), wn as (select source, count(*) as wanted from ref group by 1),
 ch as (select doc_id, count(*) as has from (select doc_id, source, unnest(toks) as term from ct) join ref using (source, term) group by 1),
 cs as (select source, doc_id, cast(round(coalesce(has, 0) * 100 / wanted) as bigint) as coverage, words, cast(round(coalesce(has, 0) * 100 / wanted * 0.7 + least(1.0, words / greatest(median, 1)) * 30) as bigint) as score from ct join wn using (source) join md using (source) left join ch using (doc_id)),
 cg as (select *, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 65 then 'C' when score >= 50 then 'D' else 'F' end as grade from cs)"""
ORACLES = {
    "term_weights": f"with {_TF} select doc_id, term, tf, df, round(weight, 6) as weight from wt",
    "top_terms": f"with {_TF} select doc_id, term, row_number() over (partition by doc_id order by round(weight, 9) desc, term) as rank from wt qualify rank <= 5",
    "surface_forms": f"with f as (select unnest({S.raw_tokens('text')}) as form from documents), c as (select form, count(*) as n from f group by 1), s as (select {S.stem('form')} as term, form, n from c) select term, form, n from s qualify row_number() over (partition by term order by n desc, form) = 1",
    "keyphrases": f"with w as (select {S.raw_tokens('text')} as w from documents), g as (select unnest(list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) as phrase from w) select phrase, count(*) as n from g group by 1 having count(*) >= 3",
    "entity_counts": rf"with e as (select unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{_CAP}(?:\s+{_CAP}){{1,3}}'), lambda e: lower(regexp_replace(e, '\s+', ' ', 'g')))) as entity from documents) select entity, count(*) as n from e group by 1 having count(*) >= 2",
    "similar_documents": f"with {_TF} select a.doc_id as query_id, b.doc_id, round(sum(a.weight * b.weight), 6) as cosine from wt a join wt b on a.term = b.term and a.doc_id % 25 = 0 and a.doc_id <> b.doc_id group by 1, 2 having sum(a.weight * b.weight) >= 0.08 qualify row_number() over (partition by a.doc_id order by round(sum(a.weight * b.weight), 6) desc, b.doc_id) <= 15",
    "question_headings": "select lower(text) as text, count(*) as n from headings where contains(text, '?') and length(text) > 8 group by 1",
    "page_types": _TYPES + " select page_id, type, confidence from y",
    "page_type_histogram": _TYPES + " select type, count(*) as pages from y group by type",
    "completeness": f"""with t as (select distinct source, doc_id, unnest({_T}) as term from documents where source is not null), n as (select source, count(distinct doc_id) as n from t group by 1), f as (select source, term, count(*) as df from t group by 1, 2),
 w as (select source, term, row_number() over (partition by source order by df desc, term) as rank from f join n using (source) where n >= 2 and df >= greatest(2, ceil(n * 0.4 - 1e-9)) qualify rank <= 30), d as (select distinct source, doc_id from t),
 j as (select d.source, d.doc_id, w.term, w.rank, t.term is not null as has from d join w using (source) left join t on t.source = d.source and t.doc_id = d.doc_id and t.term = w.term)
 select source, doc_id, count(*) as expected, count(*) filter (has) as covered, cast(round(count(*) filter (has) * 100 / count(*)) as bigint) as completeness, coalesce(array_to_string((list(term order by rank) filter (not has))[1:15], ' '), '') as missing from j group by 1, 2""",
    "content_gap": f"""with s as (select page_id, {S.site('url')} as site, list_distinct({S.tokens('title')}) as w from page_facts), o as (select site, row_number() over (order by count(*) desc, site) as k from s group by site),
 t as (select page_id as topic, w from s join o using (site) where k >= 2 and len(w) > 0), u as (select page_id as ours, w as ow from s join o using (site) where k = 1 and len(w) > 0),
 p as (select topic, ours, round(len(list_intersect(w, ow)) / (len(w) + len(ow) - len(list_intersect(w, ow))), 6) as similarity from t join u on list_has_any(w, ow)),
 b as (select * from p qualify row_number() over (partition by topic order by similarity desc, ours) = 1)
 select t.topic, case when coalesce(similarity, 0) >= {dims.GAP_JACCARD} then cast(ours as varchar) end as best, coalesce(similarity, 0) as similarity, case when coalesce(similarity, 0) < {dims.GAP_JACCARD} then 'missing' else 'covered' end as kind from t left join b using (topic)""",
    "keyword_intents": f"with {_KW}, c as (select case when regexp_matches({_KN}, '(^| )({dims.INFORMATIONAL})( |$)') then 'informational' when regexp_matches({_KN}, '(^| )({dims.TRANSACTIONAL})( |$)') then 'transactional' else 'general' end as intent, {_LOCAL} as local from k where keyword is not null) select intent, count(*) as keywords, count(*) filter (local) as local from c group by intent",
    "keyword_slugs": f"with {_KW} select keyword, '/' || replace({_KN}, ' ', '-') as slug, {_LOCAL} as local from k",
    "keyword_profiles": f"with {_FIELDS} select token, count(*) as pages, cast(sum(weight) as bigint) as weight from pf group by token",
    "keyword_best_pages": f"with {_BEST} select keyword, page_id, score, confidence, assigned from bp",
    "keyword_assignments": f"with {_BEST} select page_id, count(*) as keywords, arg_min(keyword, row(-score, keyword)) as main, max(score) as main_score from bp where assigned group by page_id",
    "description_templates": f"""with {_BEST}, rk as (select page_id, keyword, row_number() over (partition by page_id order by score desc, keyword) as r from bp where assigned),
 ks as (select page_id, list(keyword order by r) as ks from rk where r <= 4 group by page_id), ws as (select page_id, upper(left(ks[1], 1)) || ks[1][2:] as head, array_to_string(ks[2:4], ', ') as extras from ks),
 ds as (select page_id, head || '. Sprawdź ofertę Velmaro.' as short, case when extras <> '' then head || ' — ' || extras || '. Sprawdź ofertę Velmaro.' else head || '. Sprawdź ofertę Velmaro.' end as whole from ws), fs as (select page_id, case when length(whole) <= 158 then whole else short end as t from ds)
 select page_id, case when length(t) <= 158 then t else left(t, 157) || '…' end as description from fs""",
    "title_templates": f"""with {_BEST}, rk as (select page_id, keyword, row_number() over (partition by page_id order by score desc, keyword) as r from bp where assigned),
 ks as (select page_id, list(keyword order by r) as ks from rk where r <= 6 group by page_id), br as (select page_id, regexp_extract({S.site('url')}, '^[^.-]*') as b from page_facts),
 hd as (select page_id, ks, upper(left(ks[1], 1)) || ks[1][2:] as head, case when b <> '' then ' | ' || upper(left(b, 1)) || lower(b[2:]) else '' end as tail from ks join br using (page_id)),
 ch as (select page_id, n, head || case when n > 0 then ' - ' || array_to_string(ks[2:n + 1], ', ') else '' end || tail as title from (select *, unnest(generate_series(0, len(ks) - 1)) as n from hd))
 select page_id, title from ch where n = 0 or length(title) <= 60 qualify row_number() over (partition by page_id order by n desc) = 1""",
    "missing_questions": f"""with h as (select {S.site('url')} as site, url, text from headings where level <= 3 and text is not null), q as (select distinct site, lower(trim(both ' ' from text)) as q from h where contains(text, '?') and length(trim(both ' ' from text)) > 8),
 e as (select site, q from q qualify row_number() over (partition by site order by q) <= 10), o as (select site, url, lower(array_to_string(list_sort(list(distinct text)), ' . ')) as own from h group by 1, 2),
 m as (select site, url, q from o join e using (site) where not contains(own, left(q, 20)) qualify row_number() over (partition by site, url order by q) <= 6) select site, url, string_agg(q, '|' order by q) as questions from m group by 1, 2""",
    "brief_targets": f"""with p as (select {S.site('url')} as site, url, word_count from page_facts), w as (select site, greatest(800, max(coalesce(word_count, 0))) as words from p group by 1),
 h as (select site, count(distinct {S.clean('text')}) as n from headings join (select distinct site, url from p) using (url) where level <= 3 and length(trim(both ' ' from text)) > 6 group by 1) select site, cast(words as bigint) as words, coalesce(n, 0) as headings from w left join h using (site)""",
    "reference_terms": f"with {_REF} select source, term, df, rank from ref",
    "median_lengths": f"with {_MED} select source, median from md",
    "content_scores": f"with {_CS} select source, doc_id, coverage, words, score, grade from cg",
    "weakest_texts": f"with {_CS} select source, doc_id, score, grade, row_number() over (partition by source order by score, doc_id) as rank from cg qualify rank <= 6",
    "brief_outlines": f"with h as (select distinct {S.site('url')} as site, lower(trim(both ' ' from text)) as text from headings where length(text) > 8) select site, coalesce(array_to_string((list(text order by text) filter (not contains(text, '?')))[1:6], '|'), '') as headings, coalesce(array_to_string((list(text order by text) filter (contains(text, '?')))[1:6], '|'), '') as questions from h group by site",
}
