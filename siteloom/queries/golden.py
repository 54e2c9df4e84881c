"""A table of HTML pages, each made from one sound page by one change, and the issues that the change must bring: every
page rule fires here, and stays silent on the other side of its threshold."""

from __future__ import annotations

import copy
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, rules

URL = "https://golden.example/guide/lamp"
SENTENCE = "The {2} lamp works in {0} rooms and it lasts {1}% longer than the old one."
TOWNS = [a + b for b in ("lin", "mar", "nov", "rad", "tos") for a in ("Ba", "Ce", "Di", "Fo", "Gu")]
IMAGE = '<img src="/pictures/brass-lamp-{0}.webp" alt="a lamp" width="4" height="3" loading="lazy">'
HEADERS = {
    "content-type": "text/html", "content-encoding": "gzip", "cache-control": "max-age=60", "strict-transport-security": "max-age=9", "x-content-type-options": "nosniff",
    "content-security-policy": "default-src 'self'", "x-frame-options": "DENY", "referrer-policy": "same-origin",
}


def text(words: int, sentence: str = SENTENCE) -> str:
    """A paragraph of so many words."""
    many = " ".join(sentence.format(i % 90 + 10, i % 70 + 10, TOWNS[i % 25]) for i in range(words // 5 + 1)).split(" ")[:words]
    return " ".join(many).rstrip(".") + "."


def sound() -> dict:
    """A page on which no rule fires."""
    return {
        "url": URL, "depth": 1, "status": 200, "ms": 600, "headers": dict(HEADERS), "hops": [], "rendered": 0, "lang": ' lang="en"',
        "title": "<title>How a brass lamp is made in Lublin</title>", "description": f'<meta name="description" content="{"d" * 70}">', "robots": "",
        "viewport": '<meta name="viewport" content="width = device-width, initial-scale=1">', "charset": '<meta charset="utf-8">', "canonical": '<link rel="canonical" href="lamp">', "hreflang": "",
        "jsonld": '<script type="application/ld+json">{"@type": "Article", "headline": "h", "author": "a", "datePublished": "2024-01-01", "image": "i", "dateModified": "2024-01-02", "publisher": "p", "mainEntityOfPage": "m", "description": "d"}</script>',
        "og": "".join(f'<meta property="og:{p}" content="x">' for p in ("title", "description", "image", "url", "type")), "twitter": '<meta name="twitter:card" content="summary">',
        "links": '<link rel="icon" href="/f.ico"><link rel="preconnect" href="https://cdn.example">', "scripts": "",
        "crumbs": '<nav class="breadcrumb">Start</nav>', "h1": "<h1>The brass lamp</h1>", "h2": "<h2>What does a lamp need?</h2>", "h2b": "<h2>Brass and glass</h2>", "list": "<ul><li>brass</li></ul>",
        "body": f"<p>{text(140)}</p><p>{text(140)}</p><p>{text(140)}</p>", "images": IMAGE.format("a"), "anchors": '<a href="/other">The other lamp</a><a href="https://en.wikipedia.org/wiki/Lamp">Lamps</a>', "extra": "", "wrap": "main",
    }


def html(p: dict) -> str:
    head = "".join(p[k] for k in ("title", "description", "robots", "viewport", "charset", "canonical", "hreflang", "jsonld", "og", "twitter", "links", "scripts"))
    body = "".join(p[k] for k in ("crumbs", "h1", "h2", "body", "h2b", "list", "images", "anchors", "extra"))
    return f"<!doctype html><html{p['lang']}><head>{head}</head><body><{p['wrap']}>{body}</{p['wrap']}></body></html>"


def put(**values) -> Callable[[dict], None]:
    return lambda p: p.update(values)


def header(name: str, value: str | None = None) -> Callable[[dict], None]:
    return lambda p: p["headers"].pop(name) if value is None else p["headers"].update({name: value})


def add(key: str, value: str) -> Callable[[dict], None]:
    return lambda p: p.update({key: p[key] + value})


def swap(key: str, old: str, new: str) -> Callable[[dict], None]:
    return lambda p: p.update({key: p[key].replace(old, new)})


def both(*edits) -> Callable[[dict], None]:
    return lambda p: [e(p) for e in edits]


def at(url: str, *edits) -> Callable[[dict], None]:
    """Another address, canonical to itself."""
    return both(put(url=url, canonical=f'<link rel="canonical" href="{url}">'), *edits)


def hop(*status: int) -> list[tuple]:
    return [(f"{URL}/{i}", URL, s) for i, s in enumerate(status)]


THIN = put(body=f"<p>{text(240)}</p>")
LOCAL = '<a href="tel:+48123">+48 123 456 789</a><p>ul. Jasna, 20-001</p><iframe src="https://www.google.com/maps/embed"></iframe>'
PLACE = '<script type="application/ld+json">{"@type": "LocalBusiness", "name": "n", "address": "a", "telephone": "t", "openingHours": "o", "geo": "g", "url": "u", "image": "i", "priceRange": "p", "sameAs": "s", "openingHoursSpecification": "o", "aggregateRating": "r"}</script>'
LONG_WORDS = "<p>" + text(250, "Notwithstanding institutional considerations, {2} {0} administrations systematically necessitate supplementary verification procedures, notwithstanding documented organisational responsibilities, {1}% considerations.") + "</p>"
#: (name, change, rules that must fire).
CASES: tuple[tuple[str, Callable[[dict], None], str], ...] = (
    ("sound", put(), ""),
    ("noindex", put(robots='<meta name="robots" content="NoIndex">'), "IDX_NOINDEX"),
    ("noindex by header", header("x-robots-tag", "NOINDEX"), "IDX_NOINDEX"),
    ("nofollow", put(robots='<meta name="robots" content="NOFOLLOW">'), "IDX_NOFOLLOW"),
    ("status 399", put(status=399), ""), ("status 400", put(status=400), "IDX_HTTP_ERROR"), ("no answer", put(status=0), "IDX_HTTP_ERROR"),
    ("one hop", put(hops=hop(301)), "IDX_REDIRECT"), ("two hops", put(hops=hop(301, 308)), "IDX_REDIRECT_CHAIN"), ("hop for now", put(hops=hop(302)), "IDX_REDIRECT IDX_TEMP_REDIRECT"),
    ("two canonicals", add("canonical", '<link rel="canonical" href="/elsewhere">'), "IDX_MULTI_CANONICAL"),
    ("no canonical", put(canonical=""), "IDX_NO_CANONICAL"), ("empty canonical", put(canonical='<link rel="canonical" href=" ">'), "IDX_NO_CANONICAL"),
    ("canonical by path", put(canonical='<link rel="canonical" href="/guide/lamp/">'), ""), ("canonical by host", put(canonical='<link rel="canonical" href="//GOLDEN.example/guide/lamp">'), ""),
    ("canonical elsewhere", put(canonical='<link rel="canonical" href="../other">'), "IDX_CANONICAL_OTHER"),
    ("noindex and canonical", put(canonical='<link rel="canonical" href="/other">', robots='<meta name="robots" content="noindex">'), "IDX_NOINDEX IDX_CANONICAL_OTHER IDX_NOINDEX_CANONICAL"),
    ("broken canonical", put(canonical='<link rel="canonical" href="https://exa mple/x">'), "IDX_BAD_CANONICAL"),
    ("no title", put(title=""), "META_NO_TITLE"), ("blank title", put(title="<title> </title>"), "META_NO_TITLE"), ("two titles", add("title", "<title>Again the brass lamp</title>"), "META_MULTI_TITLE"),
    ("title of 29", put(title=f"<title>brass {'t' * 23}</title>"), "META_TITLE_SHORT"), ("title of 30", put(title=f"<title>brass {'t' * 24}</title>"), ""),
    ("title of 60", put(title=f"<title>brass {'t' * 54}</title>"), ""), ("title of 61", put(title=f"<title>brass {'t' * 55}</title>"), "META_TITLE_LONG"),
    ("no description", put(description=""), "META_NO_DESC"), ("description of 69", put(description=f'<meta name="description" content="{"d" * 69}">'), "META_DESC_SHORT"),
    ("description of 160", put(description=f'<meta name="description" content="{"d" * 160}">'), ""), ("description of 161", put(description=f'<meta name="description" content="{"d" * 161}">'), "META_DESC_LONG"),
    ("no h1", put(h1=""), "CNT_NO_H1"), ("two h1", add("h1", "<h1>Another</h1>"), "CNT_MULTI_H1"), ("h4 without h3", add("h2b", "<h4>Small</h4>"), "CNT_HEADING_SKIP"),
    ("few words", put(h2="", h2b="", list="", anchors='<a href="/other">x</a>', crumbs="", h1="<h1>The brass lamp</h1>", body=f"<p>{text(95)}</p>"), "CNT_THIN"),
    ("enough words", put(h2="", h2b="", list="", anchors='<a href="/other">x</a>', crumbs="", h1="<h1>The brass lamp</h1>", body=f"<p>{text(96)}</p>"), ""),
    ("much markup", add("scripts", f"<style>{'s' * 40_000}</style>"), "CNT_LOW_TEXT_RATIO"),
    ("no alt", add("images", '<img src="/b.webp" width="1" height="1" loading="lazy">'), "CNT_IMG_NO_ALT"), ("empty alt", add("images", '<img src="/b.webp" alt="" width="1" height="1" loading="lazy">'), ""),
    ("no size", add("images", '<img src="/b.webp" alt="b" width="1">'), "PERF_IMG_NO_DIM"),
    ("no viewport", put(viewport=""), "MOB_NO_VIEWPORT"), ("fixed viewport", put(viewport='<meta name="viewport" content="width=600">'), "MOB_BAD_VIEWPORT"),
    ("no lang", put(lang=""), "INT_NO_LANG"), ("no charset", put(charset=""), "META_NO_CHARSET"),
    ("hreflang of others", put(hreflang='<link rel="alternate" hreflang="pl" href="/pl">'), "INT_HREFLANG_NO_SELF"), ("hreflang by path", put(hreflang='<link rel="alternate" hreflang="en" href="/guide/lamp">'), ""),
    ("broken json", add("jsonld", '<script type="application/ld+json">{"a": </script>'), "SD_BAD_JSONLD"),
    ("no structured data", put(jsonld="", extra='<meta name="author" content="a"><meta property="article:published_time" content="2024">'), "SD_NONE GEO_NO_RICH_TYPE"),
    ("no og", put(og="", twitter=""), "SOC_NO_OG"), ("four og", swap("og", '<meta property="og:type" content="x">', ""), "SOC_PARTIAL_OG"), ("no twitter", put(twitter=""), "SOC_NO_TWITTER"),
    ("no internal link", put(anchors='<a href="https://en.wikipedia.org/wiki/Lamp">Lamps</a>'), "LNK_NO_INTERNAL"),
    ("601 ms", put(ms=601), "PERF_MEDIUM"), ("1500 ms", put(ms=1500), "PERF_MEDIUM"), ("1501 ms", put(ms=1501), "PERF_SLOW"),
    ("large", add("body", f"<p>{text(140)}</p><h2>Glass</h2>" * 230), "PERF_BIG_HTML GEO_LOW_ENTITY"),
    ("not compressed", both(header("content-encoding"), add("extra", "<b></b>" * 1200)), "PERF_NO_COMPRESSION"), ("small, not compressed", header("content-encoding"), ""),
    ("no cache", header("cache-control"), "PERF_NO_CACHE"), ("http", at("http://golden.example/guide/lamp"), "SEC_NO_HTTPS"),
    ("mixed", add("images", '<img src="http://golden.example/b.webp" alt="b" width="1" height="1" loading="lazy">'), "SEC_MIXED"),
    ("no hsts", header("strict-transport-security"), "SEC_NO_HSTS"), ("no nosniff", header("x-content-type-options"), "SEC_NO_XCTO"), ("no csp", header("content-security-policy"), "SEC_NO_CSP"),
    ("path of 115", at("https://golden.example/" + "p" * 114), ""), ("path of 116", at("https://golden.example/" + "p" * 115), "URL_LONG"), ("upper", at("https://golden.example/Lamp"), "URL_UPPER"),
    ("underscore", at("https://golden.example/a_lamp"), "URL_UNDERSCORE"), ("three parameters", at("https://golden.example/l?a=1&b=2&c=3"), ""), ("four parameters", at("https://golden.example/l?a=1&b=2&c=3&d=4"), "URL_PARAMS"),
    ("depth 3", put(depth=3), ""), ("depth 4", put(depth=4), "ARC_DEEP"),
    ("blank anchor", add("anchors", '<a href="/x" title="t"> </a>'), "ARC_EMPTY_ANCHOR"), ("two generic anchors", add("anchors", '<a href="/x">more</a><a href="/y">Here</a>'), ""),
    ("three generic anchors", add("anchors", '<a href="/x">more</a><a href="/y">Here</a><a href="/z">click here</a>'), "ARC_GENERIC_ANCHOR"),
    ("plain divs", put(wrap="div"), "GEO_NO_SEMANTIC"),
    ("no author", put(jsonld='<script type="application/ld+json">{"@type": "Article", "headline": "h", "datePublished": "d", "image": "i"}</script>'), "GEO_NO_AUTHOR"),
    ("no date", put(jsonld='<script type="application/ld+json">{"@type": "Article", "headline": "h", "author": "a", "image": "i"}</script>'), "GEO_NO_DATE"),
    ("no question", put(h2="<h2>What a lamp needs</h2>"), "GEO_NO_QUESTIONS"), ("no list", put(list=""), "GEO_NO_LISTS"),
    ("two long paragraphs", put(body=f"<p>{text(200)}</p>" * 2), ""), ("three long paragraphs", put(body=f"<p>{text(200)}</p>" * 3), "GEO_LONG_PARAS"),
    ("no sources", put(anchors='<a href="/other">The other lamp</a>'), "GEO_NO_SOURCES"), ("sources not followed", swap("anchors", 'href="https://en', 'rel="nofollow" href="https://en'), "GEO_SOURCES_NOFOLLOW"),
    ("one subheading", put(h2b="", body=f"<p>{text(120)}</p>" * 5), "GEO_NO_SUBHEADS GEO_LOW_ENTITY"), ("long sections", put(body=f"<p>{text(70)}</p><p>{text(80)}</p>" * 8), "GEO_LONG_SECTIONS GEO_LOW_ENTITY"), ("sections of 350", put(body=f"<p>{text(100)}</p>" * 10), "GEO_LOW_ENTITY"),
    ("fluff", add("extra", "<p>Jak wiadomo, warto wiedzieć.</p>"), "GEO_FLUFF"),
    ("few names", put(body="".join(f"<p>{text(140, 'the old lamp works in {0} rooms and it lasts {1}% longer than that one.')}</p>" for _ in range(3))), "GEO_LOW_ENTITY"),
    ("business without address", add("jsonld", PLACE.replace('"address": "a", ', "")), "LOC_LB_NO_ADDRESS LOC_NO_PHONE LOC_NO_ADDRESS LOC_NO_MAP"),
    ("contact page", at("https://golden.example/kontakt"), "LOC_NO_SCHEMA LOC_NO_PHONE LOC_NO_ADDRESS LOC_NO_GEO"),
    ("contact data", at("https://golden.example/kontakt", add("extra", LOCAL), add("jsonld", PLACE)), ""), ("business without map", both(add("extra", LOCAL.split("<iframe")[0]), add("jsonld", PLACE)), "LOC_NO_MAP"),
    ("two old images", add("images", IMAGE.format("b").replace("webp", "jpg") * 2), ""), ("three old images", add("images", IMAGE.format("b").replace("webp", "PNG") * 3), "PERF_LEGACY_IMG"),
    ("five not lazy", put(images=IMAGE.format("b").replace(' loading="lazy"', "") * 5 + IMAGE.format("c") * 3), "PERF_NO_LAZY"), ("four not lazy", put(images=IMAGE.format("b").replace(' loading="lazy"', "") * 4 + IMAGE.format("c") * 4), ""),
    ("five without src", put(images='<img alt="x" width="1" height="1">' * 5 + IMAGE.format("c") * 3), ""),
    ("six preloads", add("links", '<link rel="preload" href="/x.css" as="style">' * 6), ""), ("seven preloads", add("links", '<link rel="preload" href="/x.css" as="style">' * 7), "PERF_PRELOAD"),
    ("image elsewhere", both(swap("links", "preconnect", "x"), put(images=IMAGE.format("a").replace('src="', 'src="https://cdn.example'))), "PERF_NO_PRECONNECT"),
    ("image at home", both(swap("links", "preconnect", "x"), put(images=IMAGE.format("a").replace('src="', 'src="https://golden.example'))), ""),
    ("page 2", at("https://golden.example/guide?page=2"), "IDX_PAGINATION_REL META_PAGINATION_TITLE"),
    ("page 2, told", at("https://golden.example/guide?page=2", add("links", '<link rel="prev" href="/guide">'), put(title="<title>How a brass lamp is made - page 2</title>")), ""),
    ("button without name", add("extra", "<button></button>"), "A11Y_NO_NAME"), ("field without label", add("extra", '<input id="a">'), "A11Y_NO_LABEL"), ("field with label", add("extra", '<label for="a">L</label><input id="a">'), ""),
    ("tabindex", add("extra", '<div tabindex="2"></div>'), "A11Y_TABINDEX"), ("tabindex 0", add("extra", '<div tabindex="0"></div>'), ""), ("svg", add("extra", '<svg role="img"></svg>'), "A11Y_SVG"),
    ("long sentences", THIN, ""), ("sentences of 30", put(body="<p>" + " ".join(text(30, "the lamp of Lublin has {0} parts and {1}% of all of them are made by hand in one of the old town shops near us") for _ in range(8)) + "</p>"), "UX_LONG_SENT"),
    ("hard words", put(body=LONG_WORDS), "UX_LOW_READ"), ("two scripts", add("scripts", '<script src="/a.js"></script>' * 2), ""), ("three scripts", add("scripts", '<script src="/a.js"></script>' * 3), "UX_BLOCKING"),
    ("eight style sheets", add("links", '<link rel="stylesheet" href="/a.css">' * 8), ""), ("nine style sheets", add("links", '<link rel="stylesheet" href="/a.css">' * 9), "UX_MANY_CSS"),
    ("no breadcrumb", put(crumbs="", depth=2), "UX_NO_BREADCRUMB"), ("no breadcrumb at the top", put(crumbs=""), ""), ("no icon", swap("links", "icon", "x"), "UX_NO_FAVICON"),
    ("title and h1", put(h1="<h1>Something else entirely</h1>"), "META_TITLE_H1"),
    ("camera names", put(images="".join(f'<img src="/i/{n}.webp" alt="x" width="1" height="1" loading="lazy">' for n in ("dscn12", "pic-34", "20231"))), "CNT_BAD_IMG_NAME"),
    ("given names", put(images="".join(f'<img src="/i/{n}.webp" alt="x" width="1" height="1" loading="lazy">' for n in ("dscn12", "pic-3", "202"))), ""),
    ("no figures", put(body="".join(f"<p>{text(140, 'The {2} lamp works in most of all rooms and it lasts longer than the old one.')}</p>" for _ in range(3))), "GEO_NO_STATS"),
    ("frames allowed", header("x-frame-options"), "SEC_CLICKJACK"), ("frames by policy", both(header("x-frame-options"), header("content-security-policy", "frame-ancestors 'none'")), ""),
    ("no referrer policy", header("referrer-policy"), "SEC_NO_REFERRER"),
    ("rendered", both(put(rendered=400), put(h2="", h2b="", list="", crumbs="", body=f"<p>{text(150)}</p>")), "RENDER_DEPENDENT"),
)


def pages() -> list[tuple]:
    out = []
    for name, change, _ in CASES:
        p = copy.deepcopy(sound())
        change(p)
        out.append((name, p["url"], html(p), p["depth"], p["status"], p["ms"], p["headers"], p["hops"], p["rendered"]))
    return out


SCHEMA = "page string, final_url string, html string, depth int, status int, response_time_ms long, headers map<string,string>, redirect_chain array<struct<from_url:string,to_url:string,status:int>>, rendered_words long"


def golden_rules(s: SparkSession, d: str) -> DataFrame:
    """Rules that fire on the golden pages, by parsing, deriving and judging; ``(nothing)`` for pages without an issue."""
    table = s.createDataFrame(pages(), SCHEMA).repartition(4)
    facts = extract.page_facts(table.withColumn("known_as", F.col("page")), "known_as", "html", base="final_url").withColumnRenamed("url", "page")
    found = rules.issues(rules.derived(facts.join(table.drop("html"), "page")), ["page"])
    return table.select("page").join(found.select("page", "rule_id"), "page", "left").select("page", F.coalesce("rule_id", F.lit("(nothing)")).alias("rule_id"))


QUERIES = {"golden_rules": golden_rules}
ORACLES = {"golden_rules": "select * from (values " + ", ".join(f"('{name}', '{rule}')" for name, _, fire in CASES for rule in fire.split() or ["(nothing)"]) + ") as t(page, rule_id)"}
