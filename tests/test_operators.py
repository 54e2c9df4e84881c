import itertools
import random
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom import dims
from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators import content, crawl, extract, graph, history, ir, keywords, scoring, similarity, site, sparse, topics, views
from siteloom.plans.skew import lookup
from siteloom.plans.topk import examples
from siteloom.sources import exports, external, robots, sitemaps
from siteloom.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_urls(spark):
    u = lambda f, s: one(spark, f(F.lit(s)))
    assert u(U.site_of, "HTTPS://www.A.example:81/x") == "a.example" and u(U.site_of, "none") == "" and one(spark, U.site_of(F.lit(None).cast("string"))) == ""
    assert u(U.url_norm, "https://a.example/b/#c") == "https://a.example/b" and u(U.url_norm, "https://a.example/") == "https://a.example/"
    assert u(U.url_canon, "HTTPS://A.example/B/?utm_source=x&q=1&gclid=2#f") == "https://a.example/B/?q=1"
    assert one(spark, U.same_site(F.lit("https://x.a.example"), F.lit("https://y.a.example"), True))


def test_stem(spark):
    assert [one(spark, X.stemmed(F.lit(w))) for w in ("plecaki", "plecakami", "turystyczne", "kot", "a1b2c3")] == ["plecak", "plecak", "turystyczn", "kot", "a1b2c3"]
    assert one(spark, X.tokens(F.lit("Żółte plecaki i NAMIOTY"))) == ["zolt", "plecak", "namiot"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_sentences(spark):
    text = "One two three. Four five six seven! No."
    assert one(spark, F.size(X.sentences(F.lit(text)))) == 2 and one(spark, X.word_count(F.lit(text))) == 8
    assert one(spark, X.readability(F.lit(text))) == round(120 - 4 * 2.2 - len(text.replace(" ", "")) / 8 * 5)


def test_scores(spark):
    issues = spark.createDataFrame([("u", "r", "error", "meta", ""), ("u", "q", "notice", "meta", "")], "url string, rule_id string, severity string, category string, detail string")
    s = {r.category: r.score for r in scoring.category_scores(issues, 1).collect()}
    assert len(s) == 16 and s["meta"] == round(10000 / (100 + 9 * 11)) and s["url"] == 100
    more = scoring.category_scores(issues.unionByName(issues), 1).filter("category = 'meta'").first().score
    assert more < s["meta"]
    assert [one(spark, X.grade(F.lit(v))) for v in (90, 89, 75, 60, 45, 44)] == ["A", "B", "B", "C", "D", "F"]


def test_site(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", 200, "T "), (2, "https://a.example/b", 200, "t"), (3, "https://a.example/c", 404, "t"), (4, "https://b.example/", 200, "t"), (5, None, 200, None)], "page_id long, url string, status int, title string")
    links = spark.createDataFrame([("https://a.example/", "https://a.example/b/#x", "b", True), ("https://a.example/", "https://a.example/c", "", True), ("https://a.example/", "https://z.example/", "z", False)], "src_url string, href string, text string, internal boolean")
    assert [(r.site, r.value, r.n) for r in site.duplicate_values(pages, "title").collect()] == [("a.example", "t", 2)]
    assert {r.url for r in site.orphans(pages, links).filter("url is not null").collect()} == {"https://a.example/", "https://b.example/"}
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("a", "a")], "src string, dst string")
    assert [(r.src, r.dst) for r in site.missing_return_edges(e).collect()] == [("a", "c")]
    assert {(r.src, r.middle, r["last"]) for r in site.two_step_chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "src string, dst string")).collect()} == {("a", "b", "c")}
    assert [r.lang for r in site.invalid_language_codes(spark.createDataFrame([("en",), ("en-GB",), ("x-default",), ("english",)], "lang string")).collect()] == ["english"]


def test_page_rank(spark):
    rng = random.Random(1)
    edges = [("s", f"n{rng.randrange(30)}", f"n{rng.randrange(40)}") for _ in range(120)] + [("t", "a", "b"), ("t", "a", "a")]
    nodes = [("s", f"n{i}") for i in range(40)] + [("t", x) for x in "abc"]
    n, e = spark.createDataFrame(nodes, "site string, node string"), spark.createDataFrame(edges, "site string, src string, dst string")
    small = {(r.site, r.node): r["rank"] for r in graph.page_rank(n, e).collect()}
    large = {(r.site, r.node): r["rank"] for r in graph.page_rank(n, e, local_edges=0).collect()}
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-12 for k in small)
    assert abs(sum(v for (s, _), v in small.items() if s == "s") - 1) < 1e-9
    assert small["t", "b"] > small["t", "a"] == small["t", "c"]


def test_bfs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {(r.node, r.depth) for r in graph.bfs_depth(spark.createDataFrame([("a",)], "node string"), e).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_deep_chains(spark):
    n = 51  # deeper than any former limit
    e = spark.createDataFrame([(f"https://s.example/{i}", f"https://s.example/{i + 1}") for i in range(n)], "src string, dst string")
    start = spark.createDataFrame([("https://s.example/0",)], "node string")
    assert {r.node: r.depth for r in graph.bfs_depth(start, e).collect()} == {f"https://s.example/{i}": i for i in range(n + 1)}
    with pytest.raises(ValueError):
        graph.bfs_depth(start, e, most=3)
    links, seeds = e.select(F.col("src").alias("src_url"), F.col("dst").alias("href")), crawl.seeds(start.select(F.col("node").alias("url")))
    assert crawl.expand(seeds, links).agg(F.max("depth")).first()[0] == n
    assert crawl.expand(seeds, links, depth=2).count() == 3


def test_weak_important(spark):
    r = spark.createDataFrame([("s", f"n{i}", v, i % 2) for i, v in enumerate((100, 60, 39, 30, 20, 10, 10, 5))] + [("t", "x", 100, 0), ("t", "y", 0, 1), ("t", "z", 3, 1)], "site string, node string, scaled long, depth int")
    # eight pages: place 6 of the descending order holds 10
    assert {(x.site, x.node) for x in site.weak_important(r).collect()} == {("s", "n5"), ("s", "n6"), ("s", "n7"), ("t", "y")}


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_jaccard_join(spark, least):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    docs = [(i, [x if rng.random() > 0.12 else f"z{rng.randrange(60)}" for x in base[(i % 6) * 5 : (i % 6) * 5 + 12]]) for i in range(90)] + [(900, []), (901, base[:12]), (902, base[:12])]
    df = spark.createDataFrame(docs, "id long, items array<string>")
    members, sets = similarity.classes(df, "id", F.col("items"))
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(sets, least).collect()}
    s = {}
    for i, x in docs:
        if x:
            s.setdefault(frozenset(x), i)
    want = {(min(i, j), max(i, j)) for (x, i), (y, j) in itertools.combinations(s.items(), 2) if len(x & y) / len(x | y) >= least}
    assert got == want and members.count() == 92


def test_dense(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, [0.0] * 8), (501, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in similarity.dense_neighbours(df, df.filter("vec_id % 50 = 0"), 5, block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, ids in got.items():
        s = u @ u[q]
        s[q] = -2
        assert [i for _, i in sorted(ids)] == list(np.argsort(-s)[:5])
    assert set(got) == {0, 50, 100}


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "namiot plecak plecak"), (2, "plecak rower"), (3, ""), (4, None)], "id long, text string")
    w = {(r.doc, r.term): r.weight for r in ir.tfidf(df, "id", F.col("text")).collect()}
    a, b = 2 * (np.log(5 / 3) + 1), np.log(5 / 2) + 1
    assert abs(w[1, "plecak"] - a / np.hypot(a, b)) < 1e-12 and not any(k[0] in (3, 4) for k in w)


def test_cluster(spark):
    rows = [("s", str(i), t, 1.0) for i in range(30) for t in (f"t{i % 3}", f"u{i % 3}")] + [("r", "x", "only", 1.0)]
    w = spark.createDataFrame(rows, "site string, doc string, term string, weight double")
    whole = {r.doc: r.topic for r in topics.cluster(w).collect()}
    parts = {r.doc: r.topic for r in topics.cluster(w, block=8).collect()}
    for m in (whole, parts):
        assert len(m) == 31 and all((m[str(i)] == m[str(j)]) == (i % 3 == j % 3) for i in range(30) for j in range(30))


def test_cluster_does_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = [("s", str(i), t, rng.random()) for i in range(60) for t in rng.sample("abcdefghijklmnopqrst", rng.randint(1, 4))]
    docs, want, sums = {}, {}, {}
    for _, d, t, w in rows:
        docs.setdefault(d, {})[t] = w
    for d in sorted(docs, key=lambda d: (-len(docs[d]), d)):
        dots = {c: sum(w * v.get(t, 0.0) for t, w in sorted(docs[d].items())) for c, v in sums.items()}
        best = max(dots, key=lambda c: dots[c], default=None)
        want[d] = best if best is not None and dots[best] >= 0.2 else d
        for t, w in docs[d].items():
            sums.setdefault(want[d], {})[t] = sums.get(want[d], {}).get(t, 0.0) + w
    w = spark.createDataFrame(rows, "site string, doc string, term string, weight double")
    for block in (7, 5000):
        assert {r.doc: r.topic for r in topics.cluster(w, 0.2, block).collect()} == want


def test_cannibal_members(spark):
    pages = spark.createDataFrame([(1, "Winter tent guide", None), (2, "Guide: winter tent", None), (3, "Winter tent guide books", None), (4, "Lamp", None), (5, "Oak table", "Oak table")], "page_id long, title string, h1 string")
    got = {tuple(r) for r in similarity.cannibal_members(pages, "page_id", F.col("title"), F.col("h1")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (5, 5, 0)}


def test_frequent_items_meet_together(spark, monkeypatch):
    rng = random.Random(3)
    sets = [(i, [1000 + i, 2000 + i, *rng.sample(range(12), rng.randint(1, 6))]) for i in range(150)] + [(200 + i, rng.sample(range(8), rng.randint(1, 7))) for i in range(150)]
    sets = list({tuple(sorted(x)): (i, x) for i, x in sets}.values())
    d = spark.createDataFrame(sets, "class_id long, items array<long>")
    for least, at in ((0.3, 2), (0.6, 2), (0.6, 64)):
        want = {(i, j) for (i, x), (j, y) in itertools.permutations(sets, 2) if i < j and len({*x} & {*y}) >= least * len({*x} | {*y})}
        monkeypatch.setattr(similarity, "HOT_KEY", at)
        assert {(r.a, r.b) for r in similarity.jaccard_pairs(d, least).collect()} == want
    # pages of one product: its word and four of its line's words are not enough, so they don't meet in the product's word alone
    many = spark.createDataFrame([(i, [2000 + i, 6000 + i, 0, *range(1 + 4 * (i % 50), 5 + 4 * (i % 50))]) for i in range(1000)], "class_id long, items array<long>")
    counted = many.select("class_id", F.size("items").alias("n"), F.array_sort("items").alias("items"), F.lit(0).cast("long").alias("marks"))
    freq = F.transform("items", lambda x: F.when(x > 999, 0).when(x == 0, 1).otherwise(2) * 10_000 + x)  # the product's word right behind the rare ones
    keys = similarity._prefix_keys(counted.withColumn("items", F.array_sort(freq)), 0.6)
    assert keys.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 100_000


@pytest.mark.parametrize("parts, block, k", [(20_000, 2048, 4), (40, 50, 3), (1, 7, 400)])
def test_similar_in_blocks(spark, monkeypatch, parts, block, k):
    monkeypatch.setattr(sparse, "COMMON_PARTS", parts)  # most terms are common, some are, none is
    monkeypatch.setattr(sparse, "DOC_BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(10, 50)]
    rows = [(i, " ".join([*rng.choices(words, k=rng.randint(0, 30)), f"rare{i % 70}"])) for i in range(300)]
    rows += [(5, "w10 w11 apart"), (10, "w12"), (301, rows[20][1]), (302, rows[20][1]), (303, ""), (304, None), (None, "w10 w13"), (None, "w10 rare5")]
    docs = spark.createDataFrame(rows, "id long, t string").repartition(3)
    vectors = {}
    for r in ir.tfidf(docs, "id", F.col("t")).collect():
        vectors.setdefault(r.doc, {})[r.term] = r.weight
    want = set()
    for q in vectors:
        if q is not None and q % 5 == 0:
            cos = [(-round(sum(w * vectors[d].get(t, 0) for t, w in vectors[q].items()), 6), d) for d in vectors if d not in (None, q)]
            want |= {(q, d, -c) for c, d in sorted(x for x in cos if -x[0] >= 0.1)[:k]}
    got = {(r.query, r.doc, round(r.cosine, 6)) for r in sparse.similar(docs, "id", F.col("t"), F.col("doc") % 5 == 0, k, 0.1).collect()}
    assert len(want) > 150 and got == want


def test_stems_in_python(spark):
    odd = ["Żółte ŁÓDKI, buty-zimowe i oraz do lampami 3dowego x1 ab", "İstanbul Größe \u212belvin \u212ailo ſtill naïve ÓW", "", None, "  \t\n", "jak1owie że\u00a0co ＡＢＣ owego \U0001f600kotami", "the andowi dla-dla kotach mapa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id long, t string")
    for lists in ((), (dims.KEYWORD_STOP, 2, dims.KEYWORD_SUFFIXES)):
        known = X.Stems(*lists)
        for r in df.select("t", X.tokens(F.col("t"), *lists).alias("want")).collect():
            assert known.of(r.t) == r.want


def test_only_words_of_keywords_leave_their_pages(spark):
    pages = spark.createDataFrame([(i, "https://a.example/lampa", f"Lampa rare{i}", "buty", None, None, f"namiot other{i} plecak zażółć") for i in range(300)], "page_id long, url string, title string, h1 string, headings string, meta_description string, body_sample string")
    asked = spark.createDataFrame([("lamp",), ("rare7",), ("zazolc",), ("nowhere",)], "token string")
    got = keywords._page_words(pages, asked).select("page_id", F.explode("token").alias("token")).groupBy("token").count().collect()
    assert {tuple(r) for r in got} == {("lamp", 300), ("rare7", 1), ("zazolc", 300)}


def test_texts_of_pages_keep_only_words_of_keywords(spark):
    pages = spark.createDataFrame([(1, "https://a.example/lampa", "Lampa other - Lampa", None, None, None, "one two lampa three - four namiot")], "page_id long, url string, title string, h1 string, headings string, meta_description string, body_sample string")
    k = spark.createDataFrame([("lamp",), ("namiot",)], "token string")
    got = keywords._page_words(pages, k).first()
    assert (got.f_url, got.f_title, got.f_h1, got.f_body) == (" lamp ", " lamp - lamp ", "  ", " - lamp - namiot ") and dict(zip(got.token, got.weight, strict=True)) == {"lamp": 5, "namiot": 1}
    # words with another between them are no phrase; those of one field are
    best = {r.keyword: (r.page_id, r.score) for r in keywords.best_pages(spark.createDataFrame([("lampa lampa",), ("lampa namiot",), ("lampa",)], "keyword string"), pages).collect()}
    assert best == {"lampa lampa": (1, 45), "lampa namiot": (1, 27), "lampa": (1, 95)}


def test_common_words_are_scored_once(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda k: " ".join(rng.sample(WORDS, k))
    WORDS = "buty rower namiot lampa krzeslo plecak".split()
    rows = [(i, f"https://a.example/{some(1)}", f"{some(2)} rare{i % 9}", some(2), some(1), None, some(3)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, title string, h1 string, headings string, meta_description string, body_sample string")
    k = spark.createDataFrame([(x,) for x in {*[some(rng.randint(1, 3)) for _ in range(20)], *[f"{some(rng.randint(1, 4))} rare{i}" for i in range(12)], "buty buty nowhere", "nothing"}], "keyword string")
    got = []
    for at in (1_000, 3):  # words of a page or two only are scored page by page; else most words are common
        monkeypatch.setattr(keywords, "COMMON", at)
        got.append({tuple(r) for r in keywords.best_pages(k, pages).collect()})
    assert got[0] == got[1] and sum(r[1] is not None for r in got[0]) > 25
    tokens = keywords._page_words(pages).select("page_id", F.explode(F.arrays_zip("token", "weight")).alias("x")).select("page_id", "x.token", "x.weight")
    assert {tuple(r) for r in tokens.collect()} == {tuple(r) for r in keywords.profile(pages).select("page_id", "token", "weight").collect()}


def test_content_gap_by_blocks(spark):
    rng = random.Random(4)
    some = lambda at: [(at + i, [*rng.sample("abcdefgh", rng.randint(0, 4)), *[f"w{rng.randint(0, 60)}" for _ in range(2)], f"{at}"]) for i in range(60)]
    theirs, ours = some(1000), some(2000)
    want = {}
    for t, w in theirs:
        of = [(-round(len({*w} & {*v}) / len({*w} | {*v}), 6), o) for o, v in ours]
        want[t] = (-min(of)[0], min(of)[1] if -min(of)[0] >= 0.3 else None)
    t, o = (spark.createDataFrame(x, "topic long, words array<string>") for x in (theirs, ours))
    assert {r.topic: (r.similarity, r.best) for r in topics.content_gap(t, o, 0.3).collect()} == want
    sets = lambda x: spark.createDataFrame([(i, len(w), [hash(v) for v in {*w}]) for i, w in x], "id long, n int, v array<long>")
    found = topics._overlaps(sets(theirs), sets(ours), 16)
    assert found.groupBy("id").count().agg(F.max("count")).first()[0] <= 4  # a row a block, not one for each pair


def test_topics(spark):
    t = spark.createDataFrame([("s", "a", 1, 100, False, 0.0), ("s", "b", 3, 900, False, 0.2), ("s", "c", 4, 900, True, 0.9)], "site string, topic string, size long, avg_words long, has_pillar boolean, interlink double")
    assert {(r.topic, r.kind) for r in topics.gaps(t).collect()} == {("a", "thin"), ("b", "pillar"), ("b", "interlink")}
    terms = spark.createDataFrame([("g", d, t) for d, ts in ((1, "ab"), (2, "abc"), (3, "a"), (4, "d")) for t in ts] + [("h", 9, "q")], "grp string, doc long, term string")
    c = {r.doc: (r.expected, r.covered, r.missing) for r in topics.completeness(terms).collect()}
    assert c[3] == (2, 1, ["b"]) and c[4] == (2, 0, ["a", "b"]) and 9 not in c


def test_pages_of_common_words_are_no_rows(spark, monkeypatch):
    # every page holds some of six words, and every keyword has nothing but these: rows of keywords by pages must not be stored or shuffled
    rng = random.Random(4)
    WORDS = "buty rower namiot lampa krzeslo plecak".split()
    some = lambda k: " ".join(rng.sample(WORDS, k))
    rows = [(i, f"https://a.example/{some(1)}", rng.choice([None, some(2)]), None, some(3), None, some(4)) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, title string, h1 string, headings string, meta_description string, body_sample string").repartition(3)
    k = spark.createDataFrame([(x,) for x in {*[some(n) for n in (1, 2, 3) for _ in range(30)], "buty buty", "nowhere rower", "nothing"}], "keyword string")
    kept, whole = [], keywords.stored
    monkeypatch.setattr(keywords, "stored", lambda df, name, *a: kept.append(whole(df, name, *a)) or kept[-1])
    got = []
    for at, asked in ((1_000, 20_000), (3, 20_000), (3, 7)):  # all words are rare; all are common; the common ones in several blocks
        monkeypatch.setattr(keywords, "COMMON", at)
        monkeypatch.setattr(keywords, "ASKED", asked, raising=False)
        kept.clear()
        got.append({tuple(r) for r in keywords.best_pages(k, pages).collect()})
        most = max(df.count() for df in kept)
    assert got[0] == got[1] == got[2] and sum(r[1] is not None for r in got[0]) > 30
    assert most <= 3 * k.count()  # each of three partitions keeps its best page for a keyword


def test_keywords(spark):
    pages = spark.createDataFrame([(1, "https://a.example/buty-trekkingowe", "Buty trekkingowe", "Buty", None, None, "buty w gory"), (2, "https://a.example/x", None, None, None, None, None)], "page_id long, url string, title string, h1 string, headings string, meta_description string, body_sample string")
    k = spark.createDataFrame([("buty trekkingowe",), ("rower",), ("jak wybrac buty",)], "keyword string")
    best = {r.keyword: (r.page_id, r.score, r.confidence, r.assigned) for r in keywords.best_pages(k, pages).collect()}
    assert best["buty trekkingowe"] == (1, 95, "strong", True) and best["rower"] == (None, None, "none", False)
    assert {r.intent: r.keywords for r in keywords.intents(k).collect()} == {"general": 2, "informational": 1}
    c = {r.keyword: r.cluster for r in keywords.clusters(k).collect()}
    assert c["buty trekkingowe"] == c["jak wybrac buty"] != c["rower"]
    t = one(spark, keywords.title_template(F.lit("buty"), F.array(F.lit("lekkie buty"), F.lit("x" * 60), F.lit("y")), F.lit("Brand")))
    assert t == "Buty - lekkie buty | Brand"
    assert one(spark, keywords.slug(F.lit("Żółte Buty!"))) == "/zolte-buty"


def test_keyword_clusters_of_a_long_list(spark):
    # pairs that share half their tokens but not the rarest one, in a list of more than 5000, with keywords of up to twelve tokens
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aou" for c in "xzvq"]
    made = {" ".join(rng.sample(words, n)) for n in (1, 2, 3, 4, 6, 9, 11, 12) for _ in range(8)} | {f"zz{i}qx" for i in range(5000)}
    k = spark.createDataFrame([(w,) for w in made], "keyword string")
    seeds, want = [], {}
    tokens = {r.keyword: set(r.t) for r in k.select("keyword", X.keyword_tokens(F.col("keyword")).alias("t")).collect()}
    for w in sorted(made):
        want[w] = next((s for s in seeds if tokens[w] & tokens[s] and len(tokens[w] & tokens[s]) * 2 >= min(len(tokens[w]), len(tokens[s]))), w)
        if want[w] == w:
            seeds.append(w)
    assert {r.keyword: r.cluster for r in keywords.clusters(k).collect()} == want


def test_content(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("h", 7)], "k string, v int")
    assert {r.k: r.median for r in content.upper_median(df, ["k"], "v").collect()} == {"g": 3, "h": 7}
    items = spark.createDataFrame([("new page", f"t{i}", float(i)) for i in range(10)] + [("new page", "t1", 50.0)], "action string, title string, priority double")
    p = {r.title: (r.priority, r.place, r.month) for r in content.plan(items, 2, 3).collect()}
    assert len(p) == 10 and p["t1"] == (50.0, 1, 1) and p["t9"] == (9.0, 2, 1) and p["t5"] == (5.0, 6, 2) and p["t4"] == (4.0, None, 2)


def test_history(spark):
    runs = [("a1", "www.x.example", "2025-01-01", 50, "D", 10, 3, 4), ("a2", "x.example", "2025-02-01", None, "F", 12, 1, 4), ("a2", "x.example", "2025-02-01", None, "F", 12, 1, 4), ("b1", "y.example", "2025-01-05", 80, "B", 1, 0, 0)]
    df = spark.createDataFrame(runs, "audit_id string, domain string, at string, score int, grade string, pages long, errors long, warnings long").withColumn("generated_at", F.col("at").cast("timestamp"))
    assert {(r.domain, r.audit_id, r.audits) for r in history.projects(df).collect()} == {("x.example", "a2", 2), ("y.example", "b1", 1)}
    d = history.deltas(df).first()
    assert (d.domain, d.score_delta, d.errors_delta, d.pages_delta) == ("x.example", -50, -2, 2)
    a, b = spark.createDataFrame([("r1",), ("r2",)], "rule_id string"), spark.createDataFrame([("r2",), ("r3",)], "rule_id string")
    forth, back = ({(r.rule_id, r.change) for r in history.compare_issues(*x, ["rule_id"]).collect()} for x in ((a, b), (b, a)))
    swap = {"resolved": "created", "created": "resolved"}
    assert forth == {("r1", "resolved"), ("r3", "created")} == {(r, swap[c]) for r, c in back}


def test_history_store(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "audit_id string, domain string")
    history.save(df, path)
    history.delete(spark, path, "a")
    assert {r.audit_id for r in spark.read.parquet(path).collect()} == {"b", "c"}


def test_robots(spark):
    raw = "User-agent: *\nDisallow: /\n# c\nUser-agent: a\nUser-agent: loom\nDisallow: /p\nAllow: /p/x$\nAllow: /q\nDisallow: /q\nDisallow: /*.pdf\nSitemap: https://s.example/m.xml\n"
    files = spark.createDataFrame([("https://s.example", raw), ("https://t.example", None)], "origin string, raw string")
    u = ["https://s.example/p/1", "https://s.example/p/x", "https://s.example/p/xy", "https://s.example/q", "https://s.example/d/a.pdf", "https://s.example/", "https://t.example/p", "https://u.example/p"]
    got = {r.url: r.allowed for r in robots.admitted(spark.createDataFrame([(x,) for x in u], "url string"), robots.for_agent(robots.rules(files), "Siteloom")).collect()}
    assert [got[x] for x in u] == [False, True, False, True, False, True, True, True]
    assert robots.parse(raw)[1] == ["https://s.example/m.xml"]


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    files = [("https://s.example/i.xml", f"<sitemapindex {ns}><sitemap><loc>https://s.example/a.xml</loc></sitemap><sitemap><loc>https://s.example/i.xml</loc></sitemap></sitemapindex>"),
             ("https://s.example/a.xml", f"<urlset {ns}><url><loc> https://s.example/1 </loc></url></urlset>"), ("https://s.example/b.xml", "<urlset"), ("https://s.example/n.xml", None)]
    roots = spark.createDataFrame([("https://s.example/i.xml",), ("https://s.example/b.xml",)], "url string")
    assert [r.url for r in sitemaps.expand(roots, spark.createDataFrame(files, "url string, body string")).collect()] == ["https://s.example/1"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', None), (2, "<b>&", 1.5)], "n int, t string, f double")
    with zipfile.ZipFile(BytesIO(exports.xlsx({"A": exports.rows(df)}, {"A": {1: ["x", "y"]}}))) as z:
        assert z.testzip() is None and "&lt;b&gt;&amp;" in z.read("xl/worksheets/sheet1.xml").decode()
    assert "&lt;b&gt;&amp;" in exports.html_report("r", {"t": df})
    exports.write_csv(df.coalesce(1), f"file://{tmp_path}/c")
    assert '"a ""q"""' in next(tmp_path.glob("c/*.csv")).read_text()
    with pytest.raises(ValueError):
        exports.rows(df, 1)


def test_lookup_and_examples(spark):
    rows = spark.createDataFrame([("h", i) for i in range(5000)] + [("c", -1), ("n", -2)], "k string, i long")
    table = spark.createDataFrame([("h", 7, 5000), ("c", 8, 1), ("u", 9, 1)], "k string, v int, n long")
    got = {r.k: (r.c, r.v) for r in lookup(rows, table, ["k"], ["v"], "n", 5002, F.col("i")).groupBy("k").agg(F.count("*").alias("c"), F.max("v").alias("v")).collect()}
    assert got == {"h": (5000, 7), "c": (1, 8), "n": (1, None)}
    assert [r.examples for r in examples(rows.filter("k = 'h'"), ["k"], "i", 3).collect()] == [[0, 1, 2]]


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    import os

    if not os.path.exists(src):
        pytest.skip("test tables are not here")
    events = spark.read.parquet(src)
    events.repartitionByRange(3, "ts").write.parquet(f"file://{tmp_path}/in")
    q = progress.stream_window_counts(progress.read(spark, f"file://{tmp_path}/in", events.schema, 1), late="10000 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r.start, r.event_type, r.events) for r in df.collect())
    assert rows(spark.table("counts")) == rows(progress.window_counts(events))
    assert progress.sse({"a": 1}) == 'data: {"a": 1}\n\n'


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, status int, title string, body_sample string")
    assert similarity.near_duplicates(none, "page_id", F.col("body_sample")).count() == 0
    assert site.duplicate_values(none, "title").count() == 0
    assert ir.tfidf(none, "page_id", F.col("title")).count() == 0


def test_crawl(spark):
    links = spark.createDataFrame([("https://a.example/", "https://a.example/b?utm_source=q"), ("https://a.example/b", "https://a.example/p/1"), ("https://a.example/b", "https://a.example/c#x"), ("https://a.example/c", "https://z.example/"), ("https://a.example/c", "https://a.example/")], "src_url string, href string")
    start = crawl.seeds(spark.createDataFrame([("https://a.example/",)], "url string"), spark.createDataFrame([("https://a.example/s",), ("https://a.example/",)], "url string"))
    rules = robots.for_agent(robots.rules(spark.createDataFrame([("https://a.example", "User-agent: *\nDisallow: /p/")], "origin string, raw string")), "x")
    got = {(r.url, r.depth) for r in crawl.expand(start, links, rules).collect()}
    assert got == {("https://a.example/", 0), ("https://a.example/s", 1), ("https://a.example/b", 1), ("https://a.example/c", 2)}
    assert crawl.expand(start, links, most=2).count() == 2
    a = spark.createDataFrame([("META_NO_TITLE", "meta"), ("X", "url"), ("Y", "none")], "r string, c string").select(crawl.advice(F.col("r"), F.col("c")).alias("a"))
    assert [r.a for r in a.collect()] == [crawl.RULE_ADVICE["META_NO_TITLE"], crawl.CATEGORY_ADVICE["url"], "Check the page."]


def test_content_region(spark):
    html = "<body><nav>menu</nav><main><h2>Long title</h2><p>text<form>f</form> more</p><h3>no</h3></main><footer>foot</footer></body>"
    text, heads = extract.content(html)
    assert text == "Long title\ntext\nmore\nno" and heads == ["Long title"]
    assert extract.content(None) == ("", []) and extract.content("<p>only body")[0] == "only body"
    assert extract.page_content(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).count() == 2


def test_analysis(spark):
    terms = spark.createDataFrame([("g", d, t) for d, ts in ((1, "ab"), (2, "abc"), (3, "ax")) for t in ts], "grp string, doc long, term string")
    r = topics.page_analysis(terms, spark.createDataFrame([(3,)], "doc long")).first()
    assert (r.coverage, r.missing, r.extra) == (50, ["b"], 1)
    t = spark.createDataFrame([("t1", ["namiot", "plecak"]), ("t2", ["rower"])], "topic string, words array<string>")
    assert topics.resolve("namiot i plecaki", t).first().topic == "t1" and topics.resolve("zegar", t).count() == 0


def test_external(spark):
    serp = spark.createDataFrame([("k", 3, "u1", "a"), ("k", 1, "u2", "b"), ("k", 2, "u1", "c"), ("k", 4, None, "d"), ("q", 9, "u1", None)], "keyword string, rank int, url string, title string")
    assert {tuple(r) for r in external.search_results(serp).collect()} == {("k", 1, "u2", "b"), ("k", 2, "u1", "c"), ("q", 1, "u1", None)}
    s = spark.createDataFrame([("buty", "buty a", "Buty cena"), ("buty", "buty", "buty CENA"), ("buty", "jak buty", "jak prać buty"), ("buty", "buty", " Buty "), ("buty", "b", "buty?"), ("buty", "b", None), ("buty", "b", "buty kraków")], "seed string, query string, suggestion string")
    got = {r.suggestion.lower(): (r.kind, r.modifier) for r in external.suggestions(s).collect()}
    assert got == {"buty cena": ("suggestion", "commercial"), "jak prać buty": ("question", None), "buty?": ("question", None), "buty kraków": ("suggestion", "local")}
    t = spark.createDataFrame([("k", "Boot"), ("k", "Talk:Boot"), ("k", "one two three four five"), ("k", "")], "keyword string, title string")
    c = spark.createDataFrame([("k", "/c/en/hiking_boot"), ("k", "/c/en/boot"), ("k", "/c/en/")], "keyword string, id string")
    assert {tuple(r) for r in external.entities(t, c).collect()} == {("k", "Boot", "titles"), ("k", "hiking boot", "terms")}
    assert external.entities(t.limit(0), c.limit(0)).count() == 0
    assert [r.token for r in external.related(spark.createDataFrame([("mountain boots cheap",)], "keyword string")).collect()] == [one(spark, X.tokens(F.lit("mountain boots cheap"))[i]) for i in (0, 1)]


def test_views(spark):
    issues = spark.createDataFrame([(1, "u/A", "error", "R1"), (1, "u/A", "notice", "R2"), (2, "u/b", "notice", "R2")], "page_id int, url string, severity string, rule_id string")
    pages = spark.createDataFrame([(1, "u/A", 200, 10), (2, "u/b", 404, 30), (3, "u/c", 200, None)], "page_id int, url string, status int, response_time_ms int")
    assert views.with_severity(issues, "notice").count() == 2 and views.with_severity(issues).count() == 3
    assert {(r.rule_id, r.pages) for r in views.repeated_issues(issues).collect()} == {("R1", 1), ("R2", 2)}
    order = lambda **k: [r.page_id for r in views.search_pages(pages, issues, **k).collect()]
    assert order() == [1, 2, 3] and order(order="status") == [2, 1, 3] and order(order="time") == [2, 1, 3] and order(words="U/a") == [1]
    with pytest.raises(ValueError):
        order(order="name")
    t = spark.createDataFrame([("page", "p", "u3", 5), ("blog", "b", "u2", None), ("blog", None, "u1", 70), ("x", "x", "u0", 1)], "type string, title string, url string, completeness int")
    assert [r.url for r in views.topic_pages(t).collect()] == ["u1", "u2", "u3", "u0"] and [r.url for r in views.topic_pages(t, "B").collect()] == ["u2"]
    assert {r.type: r.pages for r in views.type_counts(t).collect()} == {"page": 1, "blog": 2, "x": 1}
    m = spark.createDataFrame([("s", "a", 4, 75, False), ("s", "b", 1, 20, True)], "site string, topic string, size long, coverage long, has_pillar boolean")
    g = spark.createDataFrame([("s", "a", "pillar")], "site string, topic string, kind string")
    assert tuple(views.graph_totals(m, g).select("topics", "pages", "well_covered", "pillars_missing", "coverage", "gaps").first()) == (2, 5, 1, 1, 48, 1)
    scores = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], "category string, score int")
    assert [r.category for r in views.categories_by_score(scores).collect()] == ["c", "a", "b"]


def test_discovery_and_identity(spark):
    origins = spark.createDataFrame([("https://a.example",), ("https://b.example",)], "origin string")
    listed = spark.createDataFrame([("https://a.example", "https://a.example/m.xml")], "origin string, url string")
    f = spark.createDataFrame([("https://a.example/m.xml", True, "<urlset/>"), ("https://b.example/sitemap.xml", True, "<html>"), ("https://b.example/sitemap_index.xml", False, "<sitemapindex/>"), ("https://a.example/llms.txt", True, "# A long text"), ("https://b.example/llms.txt", True, "short")], "url string, ok boolean, body string")
    assert [r.url for r in sitemaps.discovered(sitemaps.candidates(origins, listed), f).collect()] == ["https://a.example/m.xml"]
    llms = sitemaps.llms_files(origins, f)
    assert {r.origin: r.has_llms for r in llms.collect()} == {"https://a.example": True, "https://b.example": False}
    org = '<script type="application/ld+json">{"@type": "Organization", "name": "n"%s}</script>'
    facts = extract.page_facts(spark.createDataFrame([("https://a.example/1", org % ', "sameAs": ["x"]'), ("https://b.example/1", org % ""), ("https://c.example/1", "<p>x")], "url string, html string"))
    got = {(r.site, r.rule_id) for r in site.identity_issues(facts, llms.select(U.site_of(F.col("origin")).alias("site"), "has_llms")).collect()}
    assert got == {("b.example", "SITE_NO_LLMS"), ("b.example", "SITE_NO_SAME_AS"), ("c.example", "SITE_NO_LLMS"), ("c.example", "SITE_NO_ORGANIZATION")}


def test_description_template(spark):
    d = lambda main, extras, brand=None: one(spark, keywords.description_template(F.lit(main), F.array(*[F.lit(x) for x in extras]).cast("array<string>"), F.lit(brand).cast("string")))
    assert d("buty", ["a", "b", "c", "d"], "X") == "Buty — a, b, c. Sprawdź ofertę X." and d("buty", []) == "Buty. Sprawdź szczegóły."
    assert d("buty", ["x" * 150]) == "Buty. Sprawdź szczegóły." and len(d("b" * 200, [])) == 158


def test_workbooks(spark):
    t = spark.createDataFrame([("page", "p", "u3", "a", 5), ("blog", "b", "u2", "a", None)], "type string, title string, url string, topic string, completeness int")
    items = spark.createDataFrame([("new page", f"t{i}", float(i)) for i in range(5)], "action string, title string, priority double")
    for book, first, last in ((exports.content_checklist(t), "u2", "u3"), (exports.plan_workbook(content.plan(items, 2, 2)), "t4", "t0")):
        sheet = zipfile.ZipFile(BytesIO(book)).read("xl/worksheets/sheet1.xml").decode()
        assert 0 < sheet.index(first) < sheet.index(last)
    page = exports.html_report("r", {"all": items, "none": items.limit(0)})
    assert page.count("<tr>") == 7 and exports.html_report("r", {"all": items}, 2).count("<tr>") == 3


def test_release(spark):
    from siteloom.plans import lineage

    lineage.release(spark)
    df = lineage.stored(spark.range(3), "kept")
    assert df.count() == 3 and lineage.release(spark) == 1 and lineage.release(spark) == 0


def test_every_rule_has_advice():
    from siteloom.operators import rules

    assert {r.id for r in rules.PAGE_RULES} <= set(crawl.RULE_ADVICE) and {r.category for r in rules.PAGE_RULES} <= set(crawl.CATEGORY_ADVICE)
