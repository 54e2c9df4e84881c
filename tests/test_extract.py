from pyspark.sql import functions as F

from siteloom.operators import extract, rules

PAGE = """<!doctype html><html lang="en"><head><title> A  page </title><title>Second</title><meta charset="utf-8">
<meta name="Description" content=" about "><meta name="robots" content="noindex, follow"><meta property="og:title" content="T">
<link rel="canonical" href="/canon"><link rel="alternate" hreflang="pl" href="/pl"><link rel="icon" href="/f.ico"><link rel="preload" as="image" href="/x.png">
<script src="a.js"></script><script async src="b.js"></script><style>b{}</style>
<script type="application/ld+json">{"@graph":[{"@type":["Article","Recipe"],"headline":"h","author":{"@type":"Person","name":"n"}}]}</script>
<script type="application/ld+json">{bad</script></head><body><nav><a href="/a">Home</a><a href="#x">skip</a><a href="https://who.int/q" rel="nofollow">src</a></nav>
<h1>One</h1><h3>Why?</h3><p>First<p>Second <b>bold</p><script>var s = "</p>";</script><img src="p.jpg"><img data-src="q.png" alt="" width=1 height=1>
<a href="/empty"></a><button><img src=i.png alt="go"></button><input id=a><label for="b">B</label><input id="b"><input type=hidden><a href="tel:+48123">call</a>
<ul><li>x</li></ul><table><tr><td>y</td></tr></table><div class="Breadcrumbs">b</div><noscript>hidden</noscript></body></html>"""


def test_facts():
    f = extract.parse(PAGE, "https://s.example/p")
    assert (f["title"], f["title_count"], f["meta_description"], f["meta_robots"]) == ("A page", 2, "about", "noindex, follow")
    assert (f["canonical"], f["canonical_count"], f["html_lang"], f["charset"]) == ("/canon", 1, "en", "utf-8")
    assert f["h1"] == ["One"] and f["h3"] == ["Why?"] and f["question_headings"] == 1
    assert f["hreflang"] == [{"lang": "pl", "href": "/pl", "target": "https://s.example/pl"}] and f["favicon"] == "/f.ico" and f["preload"] == 1 and f["preload_image"]
    assert f["jsonld_blocks"] == 2 and f["jsonld_invalid"] == 1
    assert [e["types"] for e in f["entities"]] == [["Article", "Recipe"], ["Person"]]
    assert [i["alt"] for i in f["images"]] == [None, "", "go"] and f["images"][1]["src"] == "q.png"
    assert [(x["href"], x["internal"]) for x in f["links"]] == [("https://s.example/a", True), ("https://who.int/q", False), ("https://s.example/empty", True)]
    assert f["links"][1]["nofollow"] and f["tel_links"] == 1 and f["head_sync_scripts"] == 1
    assert f["interactive_no_name"] == 1 and f["inputs_no_label"] == 1
    assert (f["paragraphs"], f["list_count"], f["table_count"], f["nav"], f["has_breadcrumb"]) == (2, 1, 1, 1, True)
    lines = f["body_text"].split("\n")
    assert "First" in lines and "Second bold" in lines and "hidden" not in f["body_text"] and "var" not in f["body_text"]


def test_pass_and_rules(spark):
    pages = spark.createDataFrame([("https://s.example/p", PAGE), ("https://s.example/none", None), (None, "<p>x"), ("https://s.example/<bad", "<a href='http://[x'>t</a>")], "url string, html string")
    facts = extract.page_facts(pages).cache()
    assert facts.count() == 4 and facts.filter("parse_error is not null").count() == 0
    assert extract.child(facts, "links").filter(F.col("src_url") == "https://s.example/p").count() == 3
    assert extract.headings(facts).count() == 2
    missing = {(r.type, r.kind): set(r.missing) for r in extract.schema_issues(facts).collect()}
    assert missing["Article", "required"] == {"datePublished"} and "name" in missing["Recipe", "required"] and ("Person", "required") not in missing
    answered = facts.withColumns({"final_url": F.coalesce("url", F.lit("")), "status": F.lit(200), "depth": F.lit(1), "response_time_ms": F.lit(700), "headers": F.create_map(F.lit("content-type"), F.lit("text/html")), "redirect_chain": F.expr("array(named_struct('from_url','a','to_url','b','status',302))")})
    d = rules.derived(answered)
    assert len(rules.applicable(d.columns)) >= len(rules.PAGE_RULES) - 1
    fired = {r.rule_id for r in rules.issues(d, ["url"]).filter("url = 'https://s.example/p'").collect()}
    assert {"IDX_NOINDEX", "IDX_TEMP_REDIRECT", "IDX_CANONICAL_OTHER", "META_MULTI_TITLE", "META_TITLE_SHORT", "META_DESC_SHORT", "CNT_HEADING_SKIP", "CNT_IMG_NO_ALT", "MOB_NO_VIEWPORT", "SD_BAD_JSONLD", "PERF_MEDIUM", "A11Y_NO_NAME", "A11Y_NO_LABEL", "SEC_NO_HSTS", "INT_HREFLANG_NO_SELF"} <= fired
    assert not {"CNT_NO_H1", "CNT_THIN", "INT_NO_LANG", "UX_NO_FAVICON", "PERF_SLOW"} & fired


def test_thresholds(spark):
    rows = [(n, "x" * n, "y" * m, w, s) for n, m, w, s in ((29, 69, 99, 600), (30, 70, 100, 601), (60, 160, 250, 1500), (61, 161, 249, 1501))]
    df = spark.createDataFrame(rows, "id int, title string, meta_description string, word_count int, response_time_ms int").withColumn("noindex", F.lit(False))
    got = {}
    for r in rules.issues(df, ["id"]).collect():
        got.setdefault(r.id, set()).add(r.rule_id)
    assert got[29] == {"META_TITLE_SHORT", "META_DESC_SHORT", "CNT_THIN"}
    assert got[30] == {"PERF_MEDIUM"} and got[60] == {"PERF_MEDIUM"}
    assert got[61] == {"META_TITLE_LONG", "META_DESC_LONG", "PERF_SLOW"}


def test_golden_pages_cover_every_rule():
    from siteloom.queries import golden

    expected = {rule for _, _, fire in golden.CASES for rule in fire.split()}
    assert expected == {r.id for r in rules.PAGE_RULES} and len({name for name, _, _ in golden.CASES}) == len(golden.CASES)


def test_resolved():
    at = "https://s.example/a/b"
    cases = {"c": "https://s.example/a/c", "/c": "https://s.example/c", "//T.example": "https://t.example/", "?q": "https://s.example/a/b?q", "": None, None: None, "https://": None, "https://a b/": None, "https://x:port/": None, "mailto:x": "mailto:x"}
    assert {k: extract.resolved(at, k) for k in cases} == cases
