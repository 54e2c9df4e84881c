import collections
import itertools
import os
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteloom.llm import blocks, language, ledger, mixing, packing, queries, reading, repeated_lines, residue, spans, stuffing, tokens, tree

from .. import oracle

PAGE = "page_id long, url string, title string, meta_description string, html_lang string, body_text string, body_sample string, fetched_at timestamp, loaded_at timestamp, site string, key string"


def page(i, url="https://a.example/x", title=None, desc=None, lang=None, text=None, sample=None):
    import datetime

    at = datetime.datetime(2025, 1, 1 + i % 25)
    return (i, url, title, desc, lang, text, sample if sample is not None else (text[:1500] if text else text), at, at, "clash", "clash")


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE)


def no_links(spark, rows=()):
    return spark.createDataFrame(list(rows), "src_url string, href string, text string")


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "clash") for i, t in texts], "doc_id long, text string, source string, anchor string")


# --- problem 1 -----------------------------------------------------------------------------------------------------
def test_canonical():
    c = ledger.canonical
    assert c("  Zażółć, GĘŚLĄ – jaźń! ") == c(unicodedata.normalize("NFD", "zażółćgęśląjaźń"))
    assert c("a​b­﻿c ❤️") == "abc" and c("…—!") == "" and c(None) == "" and c("1 2") == "12"
    assert c("STRASSE") == c("straße") and c("résumé") != c("resume") and c("é​") == c("é")


def test_ledger(spark):
    rows = [page(5, title="One Two", desc="Text, three."), page(2, title="text THREE", desc="one-two"), page(9, title="One Two", desc="Text three"), page(7, title="One", desc="!!"), page(8), page(3, title="Other", desc="x"), page(3, title="other", desc="X")]
    df = pages(spark, rows)
    keyed, repeated = ledger.hidden_duplicates(df)
    assert {(r[0], r[1]) for r in ledger.copies_of_first(keyed, repeated).collect()} == {(2, 5), (2, 9)}
    r = {x.first_id: x.copies for x in repeated.collect()}
    assert r == {2: 3, 3: 2}


def test_ledger_batches(spark):
    rng = random.Random(1)
    rows = [page(i, title=f"T{rng.randrange(30)}", desc="d") for i in range(200)]
    df = pages(spark, rows)
    one, many = ledger.Ledger(spark, buckets=4), ledger.Ledger(spark, buckets=4)
    one.update(ledger.keyed(df, ("title", "meta_description")))
    for part in range(3):
        many.update(ledger.keyed(df.filter(F.col("page_id") % 3 == part), ("title", "meta_description")))
    again = ledger.Ledger(spark, many.path, 4)
    get = lambda x: sorted((bytes(r.key), r.copies, r.first_id, r.least_id) for r in x.rows().collect())
    assert get(one) == get(many) == get(again) and sum(r[1] for r in get(one)) == 200
    many.update(ledger.keyed(df.limit(0), ("title", "meta_description")))
    assert get(many) == get(one)
    # what an update that breaks off leaves behind does not count, and an older manifest is still whole
    names = many._names()
    assert sum(n.startswith("manifest") for n in names) == 2 and many.number == 3
    fs, p = many._at("manifest-000000004.json")
    out = fs.create(p, True)
    out.write(bytearray(b'{"buckets": 4, "ver'))
    out.close()
    assert get(ledger.Ledger(spark, many.path)) == get(one) and ledger.Ledger(spark, many.path).buckets == 4
    fs.delete(p, False)
    fs.delete(many._at("manifest-000000003.json")[1], False)
    assert sum(r[1] for r in get(ledger.Ledger(spark, many.path))) == 134


def test_ledger_splits(spark, monkeypatch):
    monkeypatch.setattr(ledger, "BUCKET_KEYS", 10)
    df = pages(spark, [page(i, title=f"T{i}", desc="d") for i in range(100)] + [page(200, title="T1", desc="d")])
    many = ledger.Ledger(spark, buckets=2)
    many.update(ledger.keyed(df, ("title", "meta_description")))
    assert len(many.rows().inputFiles()) > 4 and [r.first_id for r in many.rows().filter("copies = 2").collect()] == [200] and many.rows().count() == 100


# --- problem 2 -----------------------------------------------------------------------------------------------------
def test_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(int)
    t = tree.Tree(6, 2).fit(x[:300], y[:300])
    assert (t.predict(x[300:]) == y[300:]).mean() > 0.9 and len(t.predict(np.zeros((0, 3)))) == 0


MENU = ["Home", "Shop · Help · About us", "We use small files to remember your basket and to count visits."]
FOOT = ["Send this to a friend", "(c) 2024 Example", "Terms - Privacy"]


def sentences(i):
    name = "Ka" + chr(97 + i % 26) + "o" + "bcdfg"[i // 26] + "e"  # digits would not tell lines apart
    return [f"How the maker {name} builds a chair", f"The workshop {name} tests every chair for {i} days and writes down what breaks first. Readers asked for the notes, so here they are.",
            f"In spring the team {name} changed the wood, which made the seat lighter than before. Nobody expected that it would also last longer."]


def site_pages(n=30):
    return [page(i, f"https://www.a.example:80/{i}", f"Title of page {i} about chairs", "d", "en", "\n".join([*MENU, *sentences(i), *FOOT])) for i in range(n)]


def test_boilerplate(spark):
    links = no_links(spark, [("https://a.example/1", "https://a.example/", t) for t in ("Home", "Shop", "Help", "About us", "Privacy", None, "")])
    df = pages(spark, [*site_pages(), page(100), page(101, text=""), page(102, None, text="Only one line of text that says something here, and says it in full.")])
    got = {(r.page_id, r.line_no) for r in blocks.boilerplate_lines(df, links).collect()}
    want = {(i, n) for i in range(30) for n in (1, 2, 3, 7, 8, 9)}
    assert len(got & want) / len(got | want) > 0.95
    main = {r.page_id: r.main_text for r in blocks.main_text(df, links).collect()}
    assert sum(main[i].split("\n") == sentences(i) for i in range(30)) >= 24 and 100 not in main and 101 not in main and 102 in main
    assert blocks.boilerplate_lines(df.limit(0), links.limit(0)).count() == 0


def test_long_text(spark):
    text = "\n".join(f"Word {i} stands in a long text, and this sentence has an end." for i in range(20000))
    df = pages(spark, [page(1, text=text, sample=text)])
    assert blocks.main_text(df, no_links(spark)).count() == 1
    assert residue.residue_pages(df, no_links(spark)).count() == 0
    assert repeated_lines.repeated_lines(df).count() == 0


def test_held_out_blocks():
    import csv

    with open(blocks.LABELLED, newline="") as f:
        rows = list(csv.DictReader(f))
    x, y = np.array([[float(r[c]) for c in blocks.FEATURES] for r in rows]), np.array([int(r["label"]) for r in rows])
    test = np.arange(len(y)) % 4 == 0
    t = tree.Tree(8, 1).fit(x[~test], y[~test])
    assert (t.predict(x[test]) == y[test]).mean() > 0.8  # the table holds the hard cases
    assert (blocks.train().predict(x) == y).mean() > 0.97


# --- problem 3 -----------------------------------------------------------------------------------------------------
def test_repeated_lines(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        site = f"{'www.' if i % 2 else ''}{'a' if i % 3 else 'b'}.example"
        lines = [rng.choice(["Share  %d times" % i, "SHARE 7 times", "other", f"own {chr(97 + i % 26)}{i // 26}", "", "  "]) for _ in range(6)]
        rows.append(page(i, f"https://{site}/{i}", text="\n".join(lines)))
    long = "\n".join(["other"] * 20 + ["x" * 600, "y" * 778])
    rows.append(page(90, "https://a.example/long", text=long[:1499] + "z", sample=(long + "z" * 1500)[:1500]))
    rows += [page(91), page(92, None, text="other")]
    occ, where = collections.defaultdict(set), []
    for r in rows:
        sample = r[6]
        if not sample:
            continue
        host = re.sub(r"^www\.", "", (r[1] or "").split("/")[2]) if r[1] else ""
        parts = sample.split("\n")
        for n, line in enumerate(parts, 1):
            if line.strip() and not (len(sample) == 1500 and n == len(parts)):
                k = (host, re.sub("[0-9]+", "0", " ".join(line.lower().split())))
                occ[k].add(r[0])
                where.append((r[0], n, k))
    want = {(p, n) for p, n, k in where if len(occ[k]) >= 8}
    df = pages(spark, rows)
    assert {(r.page_id, r.line_no) for r in repeated_lines.repeated_lines(df).collect()} == want and want
    cleaned = {r.page_id: r.text for r in repeated_lines.without_repeated_lines(df).collect()}
    assert len(cleaned) == len(rows) and cleaned[91] is None
    for r in rows[:20]:
        assert cleaned[r[0]] == "\n".join(x for n, x in enumerate(r[6].split("\n"), 1) if (r[0], n) not in want)


def test_sequences(spark):
    rows = [page(i, text="\n".join([f"own {chr(97 + i)}", "one", "two", "three", *(["four"] if i < 7 else [])])) for i in range(9)]
    df = pages(spark, rows)
    for local in (10**6, 0):
        got = [(r.length, r.docs, r.page_id, r.line_no) for r in repeated_lines.repeated_sequences(df, local_items=local).collect()]
        assert sorted(got) == [(1, 9, 0, 2), (1, 9, 0, 3), (1, 9, 0, 4), (2, 9, 0, 2), (2, 9, 0, 3), (3, 9, 0, 2)]
        d = {(r.page_id, r.line_no): r.pattern_length for r in repeated_lines.deletions(df, local_items=local).collect()}
        assert len(d) == 27 and set(d.values()) == {3}
    assert repeated_lines.repeated_sequences(df.limit(0)).count() == 0 and repeated_lines.deletions(df.limit(0), local_items=0).count() == 0


@pytest.mark.parametrize("gap", [0, 2])
def test_sequences_of_any_length(spark, gap):
    rng = random.Random(gap)
    texts = [[rng.choice(["a b", "c d", "e f", "g h", f"own {chr(97 + i)}", ""]) for _ in range(rng.randrange(9))] + list("mnopqrstu") * (i < 9) for i in range(24)]
    df = pages(spark, [page(i, f"https://{'x' if i % 8 else 'y'}.example/", text="\n".join(t)) for i, t in enumerate(texts)])
    kept = {}
    for i, t in enumerate(texts):
        kept[i] = (i % 8 > 0, [(x, n) for n, x in enumerate(t, 1) if x])
    single = collections.defaultdict(set)
    for i, (site, t) in kept.items():
        for x, _ in t:
            single[site, x].add(i)
    want = collections.defaultdict(dict)
    for i, (site, t) in kept.items():
        t = [(x, n) for x, n in t if len(single[site, x]) >= 5]
        todo = [((t[j][0],), j, t[j][1]) for j in range(len(t))]
        while todo:
            pattern, j, n = todo.pop()
            want[site, pattern][i] = min(n, want[site, pattern].get(i, 99))
            todo += [((*pattern, t[k][0]), k, n) for k in range(j + 1, min(len(t), j + gap + 2))] if len(pattern) < (99 if gap == 0 else 5) else []
    want = sorted((len(p), len(v), *min(v.items())) for (_, p), v in want.items() if len(v) >= 5)
    for local in (10**6, 0):
        got = sorted((r.length, r.docs, r.page_id, r.line_no) for r in repeated_lines.repeated_sequences(df, support=5, gap=gap, local_items=local).filter("length <= 5" if gap else "true").collect())
        assert got == want and max(w[0] for w in want) >= (9 if gap == 0 else 5)


# --- problem 4 -----------------------------------------------------------------------------------------------------
TEXTS = {
    "en": "The workshop sends a short note in spring that lists which parts of the lamp wear out first, and it is free of charge.",
    "pl": "Pracownia wysyła wiosną krótką notatkę o tym, które części lampy zużywają się najszybciej, i nie bierze za to pieniędzy.",
    "de": "Die Werkstatt schickt im Frühling eine kurze Notiz, in der steht, welche Teile der Lampe zuerst verschleißen, und das ist umsonst.",
    "fr": "L'atelier envoie au printemps une courte note qui dit quelles pièces de la lampe s'usent en premier, et elle est gratuite.",
    "es": "El taller envía en primavera una nota breve que dice qué piezas de la lámpara se gastan primero, y no cuesta nada.",
    "nl": "De werkplaats stuurt in het voorjaar een korte notitie waarin staat welke delen van de lamp het eerst slijten, en dat is gratis.",
}


def test_languages(spark):
    rows = [page(i, lang=code, text="\n".join([t, "short line", t.upper()])) for i, (code, t) in enumerate(list(TEXTS.items()) * 12)]
    rows += [page(200, lang="EN_gb ", text=TEXTS["en"] + "\n" + TEXTS["nl"]), page(201, lang="english", text=TEXTS["en"]), page(202, lang="de", text=None), page(203, lang=None, text="a, b, c, d, e, f, g, h, i, j, k, l, m, n")]
    df = pages(spark, rows)
    f = language.train_filters(df)
    lines = language.line_languages(df, f)
    got = {(r.page_id, r.line_no): (r.lang, r.confidence) for r in lines.collect()}
    for i, code in enumerate(list(TEXTS) * 12):
        assert got[i, 1][0] == code and got[i, 3][0] == code and got[i, 1][1] > 0.5 and (i, 2) not in got
    assert {(r.page_id, r.lang) for r in language.mislabelled(df, lines).collect()} == {(200, "nl"), (201, "en")}
    assert language.line_languages(df.limit(0), f).count() == 0
    assert f.decide(pa.array(["", "1234", TEXTS["de"]], pa.large_string()))[0].tolist()[:2] == [-1, -1]
    judged = language.judged_line_languages(df, no_links(spark), f)
    assert {(r.page_id, r.lang) for r in language.mislabelled(df, judged).collect()} == {(200, "nl"), (201, "en")}


def test_segments(spark):
    mixed = "Lamp\n\n" + TEXTS["en"] + "\r\n" + TEXTS["pl"] + " " + TEXTS["nl"] + "\n" + TEXTS["nl"] + "\n?"
    rows = [page(i, lang="en" if i in (8, 17) else code, text=t) for i, (code, t) in enumerate(list(TEXTS.items()) * 9)]
    rows += [page(300, text=mixed), page(301, text="1 2 3"), page(302, text=" \n "), page(303, text=None), page(304, text=None, sample="\n".join(TEXTS.values()) * 500)]
    df = pages(spark, rows)
    parts = language.segments(df, language.train_filters(df))
    got = {}
    for r in parts.orderBy("page_id", "segment").collect():
        got.setdefault(r.page_id, []).append(r)
    assert [(r.lang, r.first_line, r.last_line) for r in got[300]] == [("nl", 1, 1), ("en", 3, 3), ("pl", 4, 4), ("nl", 4, 6)]
    cut = [mixed[r.begin_at : r.end_at] for r in got[300]]
    assert TEXTS["en"] in cut[1] and cut[2].strip() == TEXTS["pl"] and cut[3].startswith(TEXTS["nl"]) and cut[3].endswith("?")
    assert [(r.lang, r.confidence) for r in got[301]] == [(None, 0.0)] and not {302, 303} & set(got) and len(got[304]) >= 2000
    whole = {r.page_id: r for r in language.text_languages(parts).collect()}
    assert whole[300].lang == "nl" and whole[300].languages == 3 and whole[301].lang is None and set(whole) == set(got)
    assert all(whole[i].lang == code and whole[i].share == 1 for i, code in enumerate(list(TEXTS) * 9))
    assert language.segments(df.limit(0), language.train_filters(df)).count() == 0


def test_named_language(spark):
    cases = {"en": "en", " EN ": "en", "pt-BR": "pt", "es-419": "es", "fr_CA": "fr", "english": None, "x-default": None, "": None, "en-": None, "zh-Hans": None}
    got = {r.x: r.y for r in spark.createDataFrame([(c,) for c in cases], "x string").select("x", language.named_language(F.col("x")).alias("y")).collect()}
    assert got == cases


# --- problem 5 -----------------------------------------------------------------------------------------------------
EASY = "We like this chair. The chair is small. It is warm and cheap. My friend has one too. Put it next to the box. You can wash it at home. "
HARD = "Notwithstanding the formulated reservations, the consortium attributes disproportionate concentrations of logistical responsibilities to insufficiently documented transformations, whereas comparable assessments necessitate supplementary verification procedures. "


def test_reading(spark):
    rows, labels = [], []
    rng = random.Random(4)
    for i in range(80):
        base = EASY if i % 2 else HARD
        parts = [p for p in re.split(r"(?<=\.) ", base * 4) if p]
        rng.shuffle(parts)
        rows.append(page(i, f"https://s{i % 5}.example/{i}", f"T{i}", lang="en", text=f"Heading number {i} of it\n" + " ".join(parts[:14]) + "\n" + " ".join(parts[14:28])))
        if i < 30:
            labels.append((i, "easy" if i % 2 else "demanding"))
    rows += [page(90, text=None), page(91, text="Too short.")]
    got = {r.page_id: r.reading_level for r in reading.reading_levels(pages(spark, rows), no_links(spark), spark.createDataFrame(labels, "page_id long, reading_level string")).collect()}
    assert got and not set(got) & set(range(30)) and not {90, 91} & set(got)
    assert len(got) >= 45 and all(v == ("easy" if k % 2 else "demanding") for k, v in got.items())
    assert reading.reading_levels(pages(spark, rows), no_links(spark), spark.createDataFrame([], "page_id long, reading_level string")).count() == 0


def test_held_out_reading(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("test tables are not here")
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    labels = read("reading_labels")
    third = F.pmod(F.xxhash64("page_id"), F.lit(3)) == 0
    fit = labels.filter(~third)
    got = {r.page_id: r.reading_level for r in reading.reading_levels(read("page_facts"), read("links"), fit).collect()}
    held = [(r.page_id, r.reading_level) for r in labels.filter(third).collect() if r.page_id in got]
    assert held and sum(got[i] == v for i, v in held) / len(held) >= 0.75


# --- problem 6 -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("line", ["Dear {{ firstName }}, your order", "Price: ${price}", "<%= title %>", "%%city%%", "__name__ and more words stand here today", "[[sku]]", "Buy the {category} lamp in our shop now", "[INSERT NAME] has a new lamp for you"])
def test_unfilled(line):
    assert residue.unfilled(line)


@pytest.mark.parametrize("line", ["In our templates you write {{ firstName }} where the name goes", "Type ${price} in the editor", "Use `{{name}}` here in the text of it", "<p>{{x}}</p> is what it looks like there", "A set {1, 2} of numbers", "no marks at all"])
def test_shown(line):
    assert not residue.unfilled(line)


def test_residue(spark):
    body = "\n".join(sentences(3) + sentences(4))
    rows = [page(i, f"https://r{i}.example/", t, text=x) for i, (t, x) in enumerate([("{{title}} | Shop", body), ("Lamp undefined", body), ("Lamp", "undefined : undefined\nNaN EUR"), ("404", "Sorry, this page could not be found. It may have moved."), ("App", "Please enable JavaScript to run this app."),
        ("X", "Lorem ipsum dolorem vestra quod lorem tellum vix nolum porta."), ("Y", "Your text goes here. Replace this paragraph with your own words."), ("A lost page costs trust", body + "\nA page that was not found costs trust, says the report on error 404 pages."), (None, None), ("Fine", body)])]
    gone = {r.page_id for r in blocks.boilerplate_lines(pages(spark, rows), no_links(spark), head=1500).collect()}
    assert not gone & set(range(7))
    got = {r.page_id: r.why for r in residue.residue_pages(pages(spark, rows), no_links(spark)).collect()}
    assert got == {0: "mark", 1: "empty value", 2: "empty value", 3: "message", 4: "message", 5: "filler", 6: "filler"}


@pytest.mark.parametrize("repeats", [1, 3, 12])
def test_residue_of_any_length(spark, repeats):
    said = "Sorry, this page could not be found. The session has expired, please log in again. Please enable JavaScript to run this app."
    rows = [page(1, "https://r1.example/", "404", text="\n".join([said] * repeats)), page(2, "https://r2.example/", "404", text=" ".join([said] * repeats)), page(3, "https://r3.example/", "T", text=said + "\n" + "\n".join(sentences(3) + sentences(4)))]
    assert {r.page_id for r in residue.residue_pages(pages(spark, rows), no_links(spark)).collect()} == {1, 2}


# --- problem 7 -----------------------------------------------------------------------------------------------------
def test_viterbi():
    rng = np.random.default_rng(5)
    signs = rng.random((23, len(stuffing.SIGNS))) < 0.4
    count = np.array([5, 0, 1, 9, 8])
    got, at = stuffing.viterbi(signs, count), 0
    for n in count:
        s = signs[at : at + n].astype(float)
        e = s @ np.log(stuffing.EMISSION).T + (1 - s) @ np.log(1 - stuffing.EMISSION).T
        if 0 < n <= 5:
            score = lambda p: np.log(stuffing.START)[p[0]] + e[0][p[0]] + sum(np.log(stuffing.MOVE)[a, b] + e[i + 1][b] for i, (a, b) in enumerate(zip(p, p[1:])))
            best = max(itertools.product(range(5), repeat=n), key=score)
            assert abs(score(best) - score(tuple(got[at : at + n]))) < 1e-9
        at += n


def test_stuffed(spark):
    tags = " ".join(random.Random(6).choice(["#tent", "cheap", "buy", "#lamp", "offers", "#best"]) for _ in range(90))
    comb = "\n".join(f"buy lamp in Town{chr(97 + i)}" for i in range(26))
    keys = "; ".join(["lamp cheap", "buy lamp", "best lamp", "lamp offers"] * 12)
    data = "\n".join(f"Model{chr(97 + i)}: {i} x {i * 3} cm, warm" for i in range(20))
    faq = "\n".join(x for i in range(4) for x in (f"How long does the lamp last in year {i}?", sentences(i)[1]))
    bodies = [tags, comb, keys, "\n".join(sentences(1) + sentences(2)), "\n".join([sentences(5)[1], data]), faq, None]
    df = pages(spark, [page(i, f"https://t{i}.example/", "T", text=b) for i, b in enumerate(bodies)])
    assert {r.page_id for r in stuffing.stuffed_pages(df, no_links(spark)).collect()} == {0, 1, 2}
    assert set(r.state for r in stuffing.label_lines(df, no_links(spark)).filter("page_id = 3").collect()) <= {"prose", "link list"}


# --- problem 8 -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("capacity", [1, 7, 50])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    sizes = [(i, rng.choice([0, 1, 3, 3, 3, 7, 12, 40, 51, 120, None])) for i in range(400)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, tokens long"), capacity, ranked_rows=20).collect()
    fill, unused, per = collections.Counter(), {}, collections.Counter()
    for r in got:
        fill[r.container] += r.tokens
        unused.setdefault(r.container, set()).add(r.unused)
        per[r.doc_id] += r.tokens
        assert r.tokens <= capacity
    assert per == collections.Counter({i: n or 0 for i, n in sizes}) and {i for i, _ in sizes} == set(per)
    assert all(v <= capacity and unused[c] == {capacity - v} for c, v in fill.items())
    whole = sum(n or 0 for _, n in sizes)
    assert len([c for c, v in fill.items() if v]) <= 1.15 * whole / capacity + 2
    assert all(r.piece == 0 for r in got if sum(n or 0 for i, n in sizes if i == r.doc_id) <= capacity)


def test_pack_edges(spark):
    none = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(none, 5).count() == 0
    assert [(r.container, r.unused) for r in packing.pack(spark.createDataFrame([(1, 0)], "doc_id long, tokens long"), 5).collect()] == [(0, 5)]
    with pytest.raises(ValueError):
        packing.pack(none, 0)
    p = packing.pack_histogram({3: 10**9, 7: 3}, 10)
    assert sum(n * c for n, items in p for length, c in items if length == 3) == 10**9


def test_token_sizes(spark):
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary here")
    e = tokens.encoder(tokens.VOCABULARY)
    texts = [(1, "Hello world <|endoftext|>"), (2, ""), (3, None), (4, "zażółć " * 3000)]
    got = {r.doc_id: r.tokens for r in tokens.token_sizes(docs(spark, texts)).collect()}
    assert got[2] == got[3] == 0 and all(e.decode(e.encode_ordinary(t)) == t and got[i] == len(e.encode_ordinary(t)) for i, t in texts if t)


# --- problem 9 -----------------------------------------------------------------------------------------------------
def test_flight():
    rng = np.random.default_rng(7)
    p, size = np.full(500, 0.37), rng.integers(0, 900, 500)
    out = mixing.flight(p, size, 1)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    assert len(mixing.flight(np.zeros(0), np.zeros(0), 1)) == 0 and set(mixing.flight(np.full(8, 0.5), np.full(8, 3), 2)) <= {0.0, 1.0}


def test_plan():
    totals = {"a": (1000, 10), "b": (100, 5), "c": (0, 3)}
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("d", 0.1, 1)]
    got = mixing.plan(totals, targets)
    assert got["b"][0] == 3 and abs(got["a"][1] - 0.5) < 1e-9 and set(got) == {"a", "b"}
    free = mixing.plan(totals, targets, 1000)
    assert free["b"] == (3, 0.0) and abs(free["a"][1] - 0.7) < 1e-9
    assert mixing.plan({}, targets) == {}


@pytest.mark.parametrize("block", [20, 2000])
def test_mixture(spark, block):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None, "x"]), rng.choice([0, 5, 90, 400])) for i in range(1500)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 4), ("c", 0.2, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(sizes, targets, block=block).collect()
    assert len({r.doc_id for r in m}) == len(m) and {r.source for r in m} == {"a", "b", "c"}
    cap = {"a": 1, "b": 4, "c": 2}
    assert all(1 <= r.repeats <= cap[r.source] for r in m)
    s = {r.source: r for r in mixing.shares(spark.createDataFrame(m), targets).collect()}
    assert all(abs(s[k].actual_share - v / 0.9) < 0.02 for k, v in (("a", 0.3), ("b", 0.4), ("c", 0.2))) and s["none"].tokens == 0
    assert mixing.mixture(sizes.limit(0), targets).count() == 0


# --- problem 10 ----------------------------------------------------------------------------------------------------
def test_automaton():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ("".join(rng.choice("abł") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        n, at_b, at_a = spans.SuffixAutomaton(a).longest(b)
        best = max((j - i for i in range(len(b)) for j in range(i + 1, len(b) + 1) if b[i:j] in a), default=0)
        assert n == best and b[at_b - n : at_b] == a[at_a - n : at_a]


def brute(texts, length):
    where = collections.defaultdict(set)
    for i, t in texts:
        for x in range(len(t or "") - length + 1):
            where[t[x : x + length]].add(i)
    pairs = {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}
    cover = {}
    for i, t in texts:
        m = bytearray(len(t or ""))
        for x in range(len(t or "") - length + 1):
            if len(where[t[x : x + length]]) > 1:
                m[x : x + length] = b"\1" * length
        cover[i] = sum(m)
    return pairs, cover


@pytest.mark.parametrize("seed", [1, 2])
def test_spans(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh ł\U0001f600\n") for _ in range(n))
    shared = [word(n) for n in (29, 30, 31, 45, 80, 200)]
    texts = [(i, "".join(rng.choice([word(rng.randrange(25)), rng.choice(shared)]) for _ in range(rng.randrange(8)))) for i in range(60)]
    hot = word(90)
    texts += [(100 + i, word(i) + hot + word(3)) for i in range(30)] + [(200, None), (201, ""), (202, "a" * 400), (203, "a" * 300), (204, hot * 3)]
    pairs, cover = brute(texts, 30)
    df = docs(spark, texts)
    assert {(r[0], r[1]) for r in spans.sharing_pairs(df, 30).collect()} == pairs and pairs
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(df, 30).collect()} == cover


def test_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 4)
    monkeypatch.setattr(spans, "PAIR_BLOCK", 3)
    rng = random.Random(11)
    core = "".join(rng.choice("abcdef") for _ in range(40))
    texts = [(i, "".join(rng.choice("abcdef") for _ in range(30)) + core + "".join(rng.choice("abcdef") for _ in range(30))) for i in range(25)]
    assert {(r[0], r[1]) for r in spans.sharing_pairs(docs(spark, texts), 30).collect()} == brute(texts, 30)[0]
    texts += [(100 + i, core * (1 + i % 2)) for i in range(20)] + [(7, core[:35] + "z" * 40), (7, core[:35] + "z" * 40)]
    assert {(r[0], r[1]) for r in spans.sharing_pairs(docs(spark, texts), 30).collect()} == brute(texts, 30)[0]
    assert spans.sharing_pairs(docs(spark, []), 30).count() == 0


# --- queries -------------------------------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    got, want = queries.QUERIES[name](spark, oracle.FOLDER).toPandas(), oracle.connection().execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and oracle.rows(got) == oracle.rows(want)


@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name,columns", [("p2_found", "page_id bigint, line_no bigint"), ("p4_found", "page_id bigint, lang string"), ("p5_found", "page_id bigint, reading_level string"), ("p6_found", "page_id bigint"), ("p7_found", "page_id bigint"), ("p10_found", "doc_id_a bigint, doc_id_b bigint")])
def test_columns(spark, name, columns):
    df = queries.QUERIES[name](spark, oracle.FOLDER)
    assert ", ".join(f"{a} {b}" for a, b in df.dtypes) == columns
    assert df.count() == df.distinct().count()
