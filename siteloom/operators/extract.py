"""HTML to page facts: one Arrow-batched pass with the standard library's parser.

Errors are data: a page that cannot be parsed has ``parse_error`` set and empty facts, and no task fails.
Text of adjacent blocks is parted by line feeds (each block a line), so words never run together.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_STRINGS = T.ArrayType(_S)
LINK = _struct(pos=T.IntegerType(), href=_S, text=_S, rel=_S, nofollow=_B, internal=_B)
IMAGE = _struct(src=_S, alt=_S, width=_S, height=_S, loading=_S)
ENTITY = _struct(types=_STRINGS, props=_STRINGS)
FACTS = _struct(
    url=_S, parse_error=_S, title=_S, title_count=_L, meta_description=_S, meta_robots=_S, googlebot=_S, viewport=_S, charset=_S, html_lang=_S,
    canonical=_S, canonical_target=_S, canonical_count=_L, h1=_STRINGS, h2=_STRINGS, h3=_STRINGS, h4=_STRINGS, h5=_STRINGS, h6=_STRINGS,
    og=T.MapType(_S, _S), twitter=T.MapType(_S, _S), hreflang=T.ArrayType(_struct(lang=_S, href=_S, target=_S)),
    jsonld_blocks=_L, jsonld_invalid=_L, entities=T.ArrayType(ENTITY), same_as=_STRINGS, microdata=_L, rdfa=_L,
    images=T.ArrayType(IMAGE), links=T.ArrayType(LINK), rel_next=_S, rel_prev=_S, favicon=_S, manifest=_S, amphtml=_S,
    preload=_L, preconnect=_L, prefetch=_L, dns_prefetch=_L, preload_image=_B,
    interactive_no_name=_L, inputs_no_label=_L, has_lang=_B, positive_tabindex=_L, img_role_svg=_L, head_sync_scripts=_L, stylesheets=_L, inline_style_chars=_L, inline_script_chars=_L,
    has_breadcrumb=_B, has_search=_B, article=_L, section=_L, main=_L, nav=_L, header=_L, footer=_L, aside=_L, list_count=_L, table_count=_L,
    paragraphs=_L, long_paragraphs=_L, question_headings=_L, author=_S, published=_S, modified=_S, geo_meta=_B, tel_links=_L, has_map=_B, body_text=_S, html_size=_L,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul br title".split())
_HIDDEN = frozenset("script style noscript template".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAP = re.compile(r"google\.[a-z.]+/maps|maps\.google|openstreetmap", re.I)


def _one(text: str | None) -> str:
    return " ".join((text or "").split())


def resolved(base: str, href: str | None) -> str | None:
    """The absolute address of a link, scheme and host in lower case; None if it has none or is malformed."""
    if not href or re.fullmatch(r"https?:/*", href, re.I):
        return None
    try:
        at = urlsplit(urljoin(base, href))
        at.port  # noqa: B018 - raises if it is no number
    except ValueError:
        return None
    if not at.scheme or (at.scheme in ("http", "https") and (not at.hostname or re.search(r"[\s<>^|%]", at.netloc))):
        return None
    return at._replace(netloc=at.netloc.lower(), path=at.path or ("/" if at.netloc else "")).geturl()


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.base = url or ""
        origin = urlsplit(self.base)
        self.origin = (origin.scheme, origin.netloc.lower())
        self.f = {x.name: ([] if isinstance(x.dataType, T.ArrayType) else {} if isinstance(x.dataType, T.MapType) else 0 if x.dataType == _L else False if x.dataType == _B else None) for x in FACTS}
        self.f["url"] = url
        self.stack: list[str] = []
        self.text: list[str] = []
        self.open: list[dict] = []  # elements whose text is collected
        self.metas: dict[str, str] = {}
        self.props: dict[str, str] = {}
        self.hide = 0
        self.script: list[str] | None = None
        self.raw: list[str] | None = None
        self.fields: list[dict] = []
        self.labels: set[str] = set()

    # -- elements ----------------------------------------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        a = {k.lower(): (v or "") for k, v in attrs}
        f = self.f
        in_head = "head" in self.stack
        if tag in _BLOCK:
            self.text.append("\n")
        if tag in _HEADINGS or tag in ("title", "a", "button", "p", "label"):
            if tag == "p":
                self._close("p")
            self.open.append({"tag": tag, "a": a, "t": [], "named": False, "head": in_head, "svg": "svg" in self.stack})
        if tag == "html":
            f["html_lang"], f["has_lang"] = a.get("lang") or None, bool(a.get("lang"))
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            self._link(a)
        elif tag == "img":
            f["images"].append({"src": a.get("src") or a.get("data-src") or None, "alt": a.get("alt") if "alt" in a else None, "width": a.get("width") or None, "height": a.get("height") or None, "loading": a.get("loading") or None})
            if a.get("alt", "").strip():
                for o in self.open:
                    o["named"] = True
        elif tag == "script":
            if a.get("type", "").lower() == "application/ld+json":
                self.script = []
            else:
                self.raw = []
                if in_head and a.get("src") and "async" not in a and "defer" not in a and a.get("type", "").lower() != "module":
                    f["head_sync_scripts"] += 1
        elif tag == "style":
            self.raw = []
        elif tag == "iframe" and _MAP.search(a.get("src", "")):
            f["has_map"] = True
        elif tag in ("input", "select", "textarea"):
            if not (tag == "input" and a.get("type", "").lower() in ("hidden", "submit", "button", "image", "reset")):
                self.fields.append(a)
            if a.get("type", "").lower() == "search":
                f["has_search"] = True
        elif tag in ("article", "section", "main", "nav", "header", "footer", "aside"):
            f[tag] += 1
        elif tag in ("ul", "ol"):
            f["list_count"] += 1
        elif tag == "table":
            f["table_count"] += 1
        if tag == "label" and a.get("for"):
            self.labels.add(a["for"])
        if tag == "svg" and a.get("role") == "img" and not (a.get("aria-label") or a.get("aria-labelledby")):
            f["img_role_svg"] += 1
        if a.get("tabindex", "").lstrip("+").isdigit() and int(a["tabindex"]) > 0:
            f["positive_tabindex"] += 1
        if "itemscope" in a:
            f["microdata"] += 1
        if "typeof" in a:
            f["rdfa"] += 1
        about = " ".join((a.get("class", ""), a.get("id", ""), a.get("aria-label", ""), a.get("itemtype", ""))).lower()
        if "breadcrumb" in about:
            f["has_breadcrumb"] = True
        if a.get("role") == "search":
            f["has_search"] = True
        if tag == "a" and a.get("rel") and "author" in a["rel"].lower().split() and not f["author"]:
            self.open[-1]["author"] = True
        if tag in _HIDDEN:
            self.hide += 1
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.text.append("\n")
        if tag == "script" and self.script is not None:
            self._jsonld("".join(self.script))
            self.script = None
        elif tag in ("script", "style") and self.raw is not None:
            self.f["inline_script_chars" if tag == "script" else "inline_style_chars"] += len("".join(self.raw))
            self.raw = None
        if tag in self.stack:
            while self.stack:
                gone = self.stack.pop()
                if gone in _HIDDEN and self.hide:
                    self.hide -= 1
                if gone == tag:
                    break
        self._close(tag)

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.raw is not None:
            self.raw.append(data)
        if self.hide:
            return
        for o in self.open:
            o["t"].append(data)
        if "head" not in self.stack and not (self.open and self.open[-1]["tag"] == "title"):
            self.text.append(data)

    # -- parts --------------------------------------------------------------------------------------------------
    def _close(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                o = self.open.pop(i)
                break
        else:
            return
        f, text = self.f, _one("".join(o["t"]))
        if tag in _HEADINGS:
            if text:
                f[tag].append(text)
                if tag in ("h2", "h3", "h4") and text.endswith("?"):
                    f["question_headings"] += 1
        elif tag == "title":
            if not o["svg"]:
                f["title_count"] += 1
                if f["title"] is None and text:
                    f["title"] = text
        elif tag == "p":
            f["paragraphs"] += 1
            f["long_paragraphs"] += len(text) > 900
        elif tag in ("a", "button"):
            a = o["a"]
            if tag == "button" or "href" in a:
                if not (text or o["named"] or a.get("aria-label", "").strip() or a.get("title", "").strip() or a.get("aria-labelledby")):
                    f["interactive_no_name"] += 1
            if tag == "a":
                self._anchor(a, text)
                if o.get("author") and text:
                    f["author"] = text

    def _anchor(self, a, text):
        href = a.get("href", "").strip()
        low = href.lower()
        if low.startswith("tel:"):
            self.f["tel_links"] += 1
        if not href or low.startswith(("#", "javascript:", "mailto:", "tel:")):
            return
        try:
            full = urljoin(self.base, href)
            at = urlsplit(full)
        except ValueError:
            return
        rel = a.get("rel", "").lower()
        self.f["links"].append({"pos": len(self.f["links"]), "href": full, "text": text, "rel": rel, "nofollow": "nofollow" in rel.split(), "internal": (at.scheme, at.netloc.lower()) == self.origin})

    def _meta(self, a):
        name, prop, content = a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "").strip()
        if "charset" in a and not self.f["charset"]:
            self.f["charset"] = a["charset"] or None
        if a.get("http-equiv", "").lower() == "content-type" and not self.f["charset"]:
            self.f["charset"] = content or None
        if name:
            self.metas.setdefault(name, content)
        if prop:
            self.props.setdefault(prop, content)
        if prop.startswith("og:") and content:
            self.f["og"].setdefault(prop, content)
        if name.startswith("twitter:") and content:
            self.f["twitter"].setdefault(name, content)
        if name in ("geo.region", "geo.placename", "geo.position", "icbm"):
            self.f["geo_meta"] = True

    def _link(self, a):
        f, rel, href = self.f, a.get("rel", "").lower().split(), a.get("href", "").strip() or None
        if "canonical" in rel:
            if not f["canonical_count"]:
                f["canonical"], f["canonical_target"] = href, resolved(self.base, href)
            f["canonical_count"] += 1
        if "alternate" in rel and a.get("hreflang"):
            f["hreflang"].append({"lang": a["hreflang"], "href": href, "target": resolved(self.base, href)})
        for name, key in (("next", "rel_next"), ("prev", "rel_prev"), ("icon", "favicon"), ("manifest", "manifest"), ("amphtml", "amphtml")):
            if name in rel:
                f[key] = f[key] or href
        for name, key in (("preload", "preload"), ("preconnect", "preconnect"), ("prefetch", "prefetch"), ("dns-prefetch", "dns_prefetch")):
            f[key] += name in rel
        if "preload" in rel and a.get("as") == "image":
            f["preload_image"] = True
        f["stylesheets"] += "stylesheet" in rel

    def _jsonld(self, raw):
        f = self.f
        f["jsonld_blocks"] += 1
        try:
            todo = [json.loads(raw)]
        except ValueError:
            f["jsonld_invalid"] += 1
            return
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = [*x, *todo]
            elif isinstance(x, dict):
                types = x.get("@type")
                if types:
                    types = [str(t) for t in (types if isinstance(types, list) else [types])]
                    f["entities"].append({"types": types, "props": [str(k) for k in x]})
                    same = x.get("sameAs")
                    f["same_as"] += [str(s) for s in (same if isinstance(same, list) else [same] if same else [])]
                todo = [v for v in x.values() if isinstance(v, (dict, list))] + todo

    def facts(self, html: str) -> dict:
        while self.open:
            self._close(self.open[-1]["tag"])
        f, m, p = self.f, self.metas, self.props
        get = lambda k: m.get(k) or p.get(k) or None
        f["meta_description"], f["meta_robots"], f["googlebot"], f["viewport"] = get("description"), get("robots"), get("googlebot"), get("viewport")
        f["author"] = get("author") or f["author"] or get("article:author")
        f["published"], f["modified"] = get("article:published_time"), get("article:modified_time")
        f["inputs_no_label"] = sum(not (a.get("id") in self.labels or a.get("aria-label") or a.get("aria-labelledby") or a.get("title") or a.get("placeholder")) for a in self.fields)
        lines = (_one(x) for x in "".join(self.text).split("\n"))
        f["body_text"] = "\n".join(x for x in lines if x)
        f["html_size"] = len(html)
        return f


def parse(html: str | None, url: str | None) -> dict:
    """Facts of one page. Null and empty HTML give empty facts."""
    page = _Page(url or "")
    try:
        page.feed(html or "")
        page.close()
        return page.facts(html or "")
    except Exception as e:  # noqa: BLE001 - an unparsable page is a row, not a failed task
        return {**_Page(url or "").facts(""), "parse_error": f"{type(e).__name__}: {e}"[:200]}


_SKIPPED = frozenset("nav footer header form aside".split())


class _Region(HTMLParser):
    """Text of the content region: of main, else of article, else of the body, without navigation, forms and asides."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.heads = [], {"main": [], "article": [], "body": []}, []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.handle_data("\n")
        if tag in _HEADINGS:
            self.heads.append([])
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass
        if tag in _BLOCK:
            self.handle_data("\n")

    def handle_data(self, data):
        if any(t in _HIDDEN or t in _SKIPPED or t == "head" for t in self.stack):
            return
        for region in self.parts:
            if region == "body" or region in self.stack:
                self.parts[region].append(data)
        if self.heads and any(t in _HEADINGS for t in self.stack):
            self.heads[-1].append(data)


def content(html: str | None) -> tuple[str, list[str]]:
    """(text of the content region, its headings of more than three characters)."""
    p = _Region()
    try:
        p.feed(html or "")
        p.close()
    except Exception:  # noqa: BLE001 - what was read so far is the text
        pass
    for region in ("main", "article", "body"):
        text = "\n".join(x for x in (_one(line) for line in "".join(p.parts[region]).split("\n")) if x)
        if text:
            break
    return text, [h for h in (_one("".join(x)) for x in p.heads) if len(h) > 3]


def page_content(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url, text, headings`` of the content region of each page: the light extraction for reference texts."""

    def run(frames):
        import pandas as pd

        for f in frames:
            got = [content(h) for h in f["html"]]
            yield pd.DataFrame({"url": f["url"], "text": [t for t, _ in got], "headings": [h for _, h in got]})

    return pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInPandas(run, "url string, text string, headings array<string>")


def page_facts(pages: DataFrame, url: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """``FACTS`` of each row of ``pages``, in one pass. Links are resolved against ``base``, else against ``url``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(FACTS)

    def run(frames):
        for b in frames:
            for s in range(0, b.num_rows, 200):
                c = b.slice(s, 200)
                rows = [{**parse(h, at), "url": u} for u, h, at in zip(*(x.to_pylist() for x in c.columns))]
                for r in rows:
                    r["og"], r["twitter"] = list(r["og"].items()), list(r["twitter"].items())
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select(F.col(url).cast("string"), F.col(html).cast("string"), F.col(base or url).cast("string").alias("__base")).mapInArrow(run, FACTS)


def child(facts: DataFrame, name: str) -> DataFrame:
    """A child table of the facts: ``links``, ``images``, ``hreflang`` or ``entities``, one row per element."""
    return facts.select(F.col("url").alias("src_url"), F.posexplode(name).alias("at", "x")).select("src_url", "at", *([F.col("x.*")] if name != "links" else [F.col("x.href"), F.col("x.text"), F.col("x.rel"), F.col("x.nofollow"), F.col("x.internal")]))


def headings(facts: DataFrame) -> DataFrame:
    """``url, level, pos, text`` of all headings."""

    def level(i):
        return F.transform(F.col(f"h{i}"), lambda t, j: F.struct(F.lit(i).alias("level"), j.alias("pos"), t.alias("text")))

    levels = F.flatten(F.array(*[level(i) for i in range(1, 7)]))
    return facts.select("url", F.explode(levels).alias("h")).select("url", "h.level", "h.pos", "h.text")


def schema_issues(facts: DataFrame) -> DataFrame:
    """``url, type, kind, missing`` of each structured-data entity that lacks properties its type requires or recommends."""
    rules = {t: r for t, r in dims.SCHEMA_RULES.items()} | {t: dims.SCHEMA_RULES["LocalBusiness"] for t in dims.LOCAL_SUBTYPES}
    spark = facts.sparkSession
    table = spark.createDataFrame([(t, k, p.split()) for t, (need, want) in rules.items() for k, p in (("required", need), ("recommended", want))], "type string, kind string, props array<string>")
    each = facts.select("url", F.explode("entities").alias("e")).select("url", F.explode("e.types").alias("type"), F.col("e.props").alias("has"))
    missing = each.join(F.broadcast(table), "type").select("url", "type", "kind", F.array_except("props", "has").alias("missing"))
    return missing.filter(F.size("missing") > 0)
