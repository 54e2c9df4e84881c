"""Page types, topic clusters, their labels, coverage, completeness, gaps, and comparison with other sites."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..functions.urls import path_of, site_of
from ..plans.lineage import stored
from ..plans.topk import top

#: Documents that a cluster task unpacks at a time; the result does not depend on it.
CLUSTER_BLOCK = 5000


def page_type(url: Column, title: Column, types: Column, word_count: Column, internal_links: Column, dated_author: Column) -> Column:
    """struct(type, confidence) by the first rule that holds, from path, title, structured types and counts."""
    path = F.regexp_replace(F.lower(path_of(url)), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    t, kinds = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(types, F.lit("")))
    mk = lambda name, c: F.struct(F.lit(name).alias("type"), F.lit(float(c)).alias("confidence"))
    out = F.when(path == "/", mk("homepage", 1.0))
    for name, where, kind, sure in dims.PAGE_TYPE:
        if name == "service" and where is None:
            out = out.when(F.coalesce(dated_author, F.lit(False)) & (word_count > 300), mk("blog", 0.7))
        hit = F.lit(False)
        if where:
            hit = hit | path.rlike(where) | t.rlike(where)
        if kind:
            hit = hit | kinds.rlike(kind)
        if name == "category":
            hit = hit | ((internal_links > 25) & (word_count < 300))
        out = out.when(F.coalesce(hit, F.lit(False)), mk(name, sure))
    return out.otherwise(mk("page", 0.4))


def type_histogram(typed: DataFrame) -> DataFrame:
    return typed.groupBy("type").agg(F.count("*").alias("pages"))


def cluster(weights: DataFrame, least: float = dims.TOPIC_COSINE, block: int = CLUSTER_BLOCK) -> DataFrame:
    """``site, doc, topic``: greedy clusters of documents within each site.

    ``weights(site, doc, term, weight)``. Documents come in descending order of their number of terms (ties: doc);
    each joins the cluster whose summed vector has the largest dot product with it, if at least ``least``, else opens
    one. Each document is held against the sums of all before it, so a site of any size is one task, in this order;
    ``block`` documents are unpacked at a time. A topic is named by its first document.
    """
    docs = weights.groupBy("site", "doc").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("v"))
    rows = docs.select("site", "doc", F.transform("v", lambda x: x["term"]).alias("terms"), F.transform("v", lambda x: x["weight"]).alias("weights"), F.size("v").alias("order"))

    def run(frame):
        import pandas as pd

        frame = frame.assign(m=-frame["order"]).sort_values(["m", "doc"], kind="stable")
        sums: list[dict] = []
        index: dict[str, set[int]] = {}
        names, put = [], []
        for start in range(0, len(frame), block):
            part = frame.iloc[start : start + block]
            for name, terms, ws in zip(part["doc"], part["terms"].map(list), part["weights"].map(list)):
                dots: dict[int, float] = {}
                for term, w in zip(terms, ws):
                    for c in index.get(term, ()):
                        dots[c] = dots.get(c, 0.0) + w * sums[c][term]
                best = max(dots, key=lambda c: (dots[c], -c), default=-1)
                if best < 0 or dots[best] < least:
                    best = len(sums)
                    sums.append({})
                    names.append(name)
                for term, w in zip(terms, ws):
                    if term not in sums[best]:
                        index.setdefault(term, set()).add(best)
                    sums[best][term] = sums[best].get(term, 0.0) + w
                put.append(best)
        return pd.DataFrame({"site": frame["site"].iloc[0], "doc": frame["doc"].to_numpy(), "topic": [names[c] for c in put]})

    return rows.groupBy("site").applyInPandas(run, "site string, doc string, topic string")


def labels(weights: DataFrame, members: DataFrame, forms: DataFrame) -> DataFrame:
    """``site, topic, label``: the surface forms of the three heaviest terms."""
    sums = weights.join(members, ["site", "doc"]).groupBy("site", "topic", "term").agg(F.round(F.sum("weight"), 9).alias("w"))
    three = top(sums, ["site", "topic"], [F.desc("w"), F.col("term")], 3).join(forms, "term", "left")
    return three.groupBy("site", "topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("form", "term").alias("f")))), lambda x: x["f"]), " ").alias("label"))


def topic_edges(members: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b, weight``: links between topics (a <= b; a = b counts links within a topic). ``links(src, dst)`` over docs."""
    t = members.select("doc", "topic")
    both = links.join(t.select(F.col("doc").alias("src"), F.col("topic").alias("ta")), "src").join(t.select(F.col("doc").alias("dst"), F.col("topic").alias("tb")), "dst")
    return both.groupBy(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.count("*").alias("weight"))


def coverage(size: Column, has_pillar: Column, avg_words: Column, interlink: Column) -> Column:
    """0 to 100 from the number of pages, a pillar page, average length and links within the topic."""
    s = F.least(F.lit(40), size * 12) + F.when(has_pillar, 20).otherwise(0) + F.least(F.lit(20.0), avg_words / 800 * 20) + interlink * 20
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(s))).cast("long")


def metrics(members: DataFrame, pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Per topic: size, average words, dominant type, pillar, interlinking, coverage. ``pages(doc, type, word_count)``."""
    p = members.join(pages, "doc")
    base = p.groupBy("site", "topic").agg(
        F.count("*").alias("size"), F.round(F.avg("word_count")).cast("long").alias("avg_words"), F.max("word_count").alias("max_words"), F.bool_or((F.col("word_count") >= 800) | F.col("type").isin("service", "category")).alias("has_pillar")
    )
    kinds = top(p.groupBy("site", "topic", "type").agg(F.count("*").alias("n")), ["site", "topic"], [F.desc("n"), F.col("type")], 1).select("site", "topic", F.col("type").alias("dominant_type"))
    inner = edges.filter("a = b").select(F.col("a").alias("topic"), F.col("weight").alias("intra"))
    link = F.when(F.col("size") > 1, F.least(F.lit(1.0), F.coalesce("intra", F.lit(0)) / (F.col("size") - 1))).otherwise(0.0)
    return base.join(kinds, ["site", "topic"]).join(inner, "topic", "left").withColumn("interlink", F.round(link, 6)).withColumn("coverage", coverage(F.col("size"), F.col("has_pillar"), F.col("avg_words"), F.col("interlink"))).drop("intra")


def gaps(topics: DataFrame) -> DataFrame:
    """``site, topic, kind, severity``: single-page or short topics, large ones without a pillar or with few links within."""
    g = F.filter(
        F.array(
            F.when(F.col("size") == 1, F.struct(F.lit("thin").alias("kind"), F.lit("warning").alias("severity"))),
            F.when((F.col("size") > 1) & (F.col("avg_words") < 300), F.struct(F.lit("thin").alias("kind"), F.lit("notice").alias("severity"))),
            F.when((F.col("size") >= 3) & ~F.col("has_pillar"), F.struct(F.lit("pillar").alias("kind"), F.lit("warning").alias("severity"))),
            F.when((F.col("size") >= 3) & (F.col("interlink") < 0.5), F.struct(F.lit("interlink").alias("kind"), F.lit("notice").alias("severity"))),
        ),
        lambda x: x.isNotNull(),
    )
    return topics.select("site", "topic", F.inline(g))


def expected_terms(terms: DataFrame, share: float = 0.4, most: int = 30) -> DataFrame:
    """``grp, term, df``: terms that a group's documents are expected to have: in at least max(2, ceil(share x n)) of them.
    ``terms(grp, doc, term)`` distinct; groups of one document expect nothing."""
    n = terms.select("grp", "doc").distinct().groupBy("grp").agg(F.count("*").alias("n"))
    df = terms.groupBy("grp", "term").agg(F.count("*").alias("df")).join(n, "grp").filter((F.col("n") >= 2) & (F.col("df") >= F.greatest(F.lit(2), F.ceil(F.col("n") * share - 1e-9))))
    return top(df.select("grp", "term", "df"), ["grp"], [F.desc("df"), F.col("term")], most)


def completeness(terms: DataFrame, share: float = 0.4, most: int = 30, missing: int = 15) -> DataFrame:
    """``grp, doc, expected, covered, completeness, missing``: how much of what its group expects each document has."""
    want = expected_terms(terms, share, most)
    lists = want.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("want"))
    has = terms.join(want.select("grp", "term"), ["grp", "term"]).groupBy("grp", "doc").agg(F.collect_set("term").alias("has"))
    docs = terms.select("grp", "doc").distinct().join(lists, "grp").join(has, ["grp", "doc"], "left")
    none = F.array().cast("array<string>")
    covered = F.size(F.coalesce("has", none))
    return docs.select(
        "grp", "doc", F.size("want").cast("long").alias("expected"), covered.cast("long").alias("covered"), F.round(covered * 100 / F.size("want")).cast("long").alias("completeness"),
        F.slice(F.array_except("want", F.coalesce("has", none)), 1, missing).alias("missing"),
    )


def _overlaps(sets: DataFrame, others: DataFrame, block: int = 2048) -> DataFrame:
    """``id, ours, both, either`` of ``sets(id, v, n)`` and ``others(id, v, n)``, v arrays of different longs: for each set and block of others the one with the
    largest share both / either (to six places; ties: least id), if they have anything in common; either is n + n - both."""
    def blocks(d, p):
        parts = max(1, -(-d.count() // block))
        return parts, stored(d.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("b")).agg(*[F.collect_list(c).alias(p + c) for c in ("id", "v", "n")]).drop("b"), "gap-blocks")

    a_kind, b_kind = (dict(d.dtypes)["id"] for d in (sets, others))
    (parts, left), (_, right) = blocks(sets, "a_"), blocks(others, "b_")

    def run(frames):
        for f in frames:
            for i in range(f.num_rows):
                a_id, a_v, a_n, b_id, b_v, b_n = (f.column(c)[i].as_py() for c in ("a_id", "a_v", "a_n", "b_id", "b_v", "b_n"))
                order = sorted(range(len(b_id)), key=b_id.__getitem__)
                size = np.array([b_n[j] for j in order])
                at = np.repeat(np.arange(len(order)), [len(b_v[j]) for j in order])
                words = np.array([x for j in order for x in b_v[j]], np.int64)
                by = np.argsort(words, kind="stable")
                keys, first = np.unique(words[by], return_index=True)
                lists = dict(zip(keys.tolist(), np.split(at[by], first[1:]), strict=True))
                out = []
                for name, v, n in zip(a_id, a_v, a_n, strict=True):
                    if found := [lists[x] for x in v if x in lists]:
                        both = np.bincount(np.concatenate(found), minlength=len(order))
                        k = int(np.argmax(np.floor(both / (size + n - both) * 1e6 + 0.5)))
                        out.append((name, b_id[order[k]], int(both[k]), int(size[k] + n - both[k])))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], f.schema.field("a_id").type.value_type), pa.array(cols[1], f.schema.field("b_id").type.value_type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["id", "ours", "both", "either"])

    met = left.repartition(min(parts, 1000)).crossJoin(right)
    return met.mapInArrow(run, f"id {a_kind}, ours {b_kind}, both long, either long")


def content_gap(theirs: DataFrame, ours: DataFrame, least: float = dims.GAP_JACCARD) -> DataFrame:
    """``topic, best, similarity, kind``: each of their topics with our most similar one; below ``least`` it is missing.

    Both sides ``topic, words`` (arrays). Topics of the same words are compared once, and so are those that have as many words and the same
    ones of those that both sides know. The overlaps are counted block by block, so only the best of a block is a row.
    """
    sets = lambda d, name: stored(d.groupBy(F.array_sort(F.array_distinct("words")).alias("w")).agg(F.min("topic").alias(name)), "gap-sets")
    t, o = sets(theirs, "topic"), sets(ours, "ours")
    each = lambda d, name: d.select(name, F.size("w").alias("n"), F.explode("w").alias("x"))
    known = lambda d, name, other: d.join(other.select("x").distinct(), "x", "left_semi").groupBy(name, "n").agg(F.array_sort(F.collect_list(F.xxhash64("x"))).alias("v"))
    tx, ox = each(t, "topic"), each(o, "ours")
    kt = stored(known(tx, "topic", ox), "gap-topics")
    reps = stored(kt.groupBy("v", "n").agg(F.min("topic").alias("id")), "gap-classes")
    mine = stored(known(ox, "ours", tx).groupBy("v", "n").agg(F.min("ours").alias("id")), "gap-classes")
    best = top(_overlaps(reps, mine).withColumn("similarity", F.round(F.col("both") / F.col("either"), 6)), ["id"], [F.desc("similarity"), F.col("ours")], 1)
    best = kt.join(reps, ["v", "n"]).join(best, "id").select("topic", "ours", "similarity")
    s = F.coalesce("similarity", F.lit(0.0))
    named = theirs.select("topic", F.array_sort(F.array_distinct("words")).alias("w")).join(t.withColumnRenamed("topic", "same"), "w")
    return named.join(best.select(F.col("topic").alias("same"), "ours", "similarity"), "same", "left").select("topic", F.when(s >= least, F.col("ours")).alias("best"), s.alias("similarity"), F.when(s < least, "missing").otherwise("covered").alias("kind"))


def topic_documents(pages: DataFrame) -> DataFrame:
    """``site, doc, text`` for clustering: title three times, headings twice, sample once. ``pages(url, page_id, title, headings, body_sample)``."""
    return pages.select(site_of(F.col("url")).alias("site"), F.col("page_id").cast("string").alias("doc"), F.concat_ws(" ", "title", "title", "title", "headings", "headings", "body_sample").alias("text"))


def question_headings(headings: DataFrame) -> DataFrame:
    """``text, n``: headings that are questions of more than eight characters, without regard to case."""
    q = headings.filter(F.col("text").contains("?") & (F.length("text") > 8))
    return q.groupBy(F.lower("text").alias("text")).agg(F.count("*").alias("n"))


def group_terms(docs: DataFrame, grp: Column, doc: str, text: Column) -> DataFrame:
    return X.token_rows(docs, [grp.alias("grp"), F.col(doc).alias("doc")], text).distinct()


def page_analysis(terms: DataFrame, docs: DataFrame, share: float = 0.4) -> DataFrame:
    """``grp, doc, coverage, missing, extra``: stated pages (``docs(doc)``) against what the group expects, and what only they say."""
    want = expected_terms(terms, share)
    lists = want.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("want"))
    mine = terms.join(docs.select("doc"), "doc", "left_semi").groupBy("grp", "doc").agg(F.sort_array(F.collect_set("term")).alias("has"))
    j = mine.join(lists, "grp", "left").withColumn("want", F.coalesce("want", F.array().cast("array<string>")))
    cover = F.when(F.size("want") > 0, F.round(F.size(F.array_intersect("want", "has")) * 100 / F.size("want")).cast("long"))
    return j.select("grp", "doc", cover.alias("coverage"), F.array_except("want", "has").alias("missing"), F.size(F.array_except("has", "want")).alias("extra"))


def resolve(keyword: str, topics_: DataFrame, least: float = 0.12) -> DataFrame:
    """The topic (``topic, words``) whose words are most similar to a keyword's tokens, if similar enough: at most one row."""
    s = X.jaccard(F.array_distinct(X.tokens(F.lit(keyword))), F.array_distinct("words"))
    return topics_.select("topic", F.round(s, 6).alias("similarity")).filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "topic").limit(1)


def expected_questions(headings: DataFrame, most: int = 10) -> DataFrame:
    """``grp, question``: a group's different question headings of more than eight characters (``headings(grp, doc, text)``), the first ``most`` by text."""
    q = headings.filter(F.col("text").contains("?") & (F.length(F.trim("text")) > 8)).select("grp", F.lower(F.trim("text")).alias("question")).distinct()
    return top(q, ["grp"], [F.col("question")], most).drop("rank")


def missing_questions(headings: DataFrame, docs: DataFrame, most: int = 6) -> DataFrame:
    """``grp, doc, questions``: for each of ``docs(grp, doc)`` up to ``most`` expected questions whose first 20 characters stand in none of its headings."""
    own = headings.groupBy("grp", "doc").agg(F.lower(F.array_join(F.sort_array(F.collect_set("text")), " . ")).alias("own"))
    asked = expected_questions(headings).groupBy("grp").agg(F.sort_array(F.collect_list("question")).alias("all"))  # ten at most
    j = docs.join(asked, "grp").join(own, ["grp", "doc"], "left")
    lacking = F.filter("all", lambda q: ~F.contains(F.coalesce("own", F.lit("")), F.substring(q, 1, 20)))
    return j.select("grp", "doc", F.slice(lacking, 1, most).alias("questions")).filter(F.size("questions") > 0)
