"""Main content and boilerplate: flat text blocks with the word count and link density of their neighbours,
classified by a decision tree that is trained on a small labelled table.

A block is a line of the text. Page texts carry no mark-up, so the link density of a block is the share of its words
that stand in segments which are link texts on its site: anchor texts of the ``links`` table and titles of the site's
other pages. How many pages of the site hold the same block is a further feature. Both are looked up by hashed keys
that were counted over all pages.
"""

from __future__ import annotations

import csv
import pathlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import site_of
from ..plans.lineage import stored
from ..plans.skew import lookup
from .lines import WHITE, Lines, count, hash64, line_key_text, numbers, squeezed, words_of
from .tree import Tree

#: What separates the parts of menus, breadcrumbs and titles (fixed values).
SEPARATOR = r" ?[·|›»•] ?| [-–—/>] |\s?[<«]\s?|, "
SEPARATORS = r"[·|›»•«<>/]| - | – "
SITE_MARK = -1
NONE = pa.scalar("", pa.large_string())
FEATURES = (
    "words", "letters_a_word", "ends_sentence", "sentences", "commas_a_word", "separators_a_word", "capitals", "digits",
    "bullet", "site_share", "site_pages", "link_density", "label_share", "title_link", "before_words", "after_words",
    "before_links", "after_links", "before_share", "after_share", "before_sentence", "after_sentence", "from_top", "from_end", "colon",
)
LABELLED = pathlib.Path(__file__).with_name("blocks.csv")


def train(path: pathlib.Path = LABELLED) -> Tree:
    """The tree of the labelled table (a few hundred rows; label 1: not the page's own content)."""
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    x = np.array([[float(r[c]) for c in FEATURES] for r in rows])
    return Tree(max_depth=8, min_leaf=1).fit(x, np.array([int(r["label"]) for r in rows]))


def _segments(key_text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Parts of short lines between separators: index of the line, part."""
    parts = pc.split_pattern_regex(key_text, SEPARATOR)
    return pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64), squeezed(parts.flatten())


def _prefixes(key_text: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Beginnings of a line that end before a separator or a closing price, longest last; for finding titles in teasers."""
    at, texts = [], []
    cut = pc.split_pattern_regex(pc.replace_substring_regex(key_text, r" 0(?:[.,]0)? ?\S{1,4}$", ""), r" [-–—|] ")
    for i, parts in enumerate(cut.to_pylist()):
        whole = ""
        for p in parts[:4]:
            whole = f"{whole} - {p}" if whole else p
            at.append(i)
            texts.append(whole)
    return np.array(at, np.int64), texts


def _label(key_text: pa.Array) -> pa.Array:
    """The label before a colon at the beginning of a line, of at most 20 characters; else ''."""
    return pc.struct_field(pc.extract_regex(pc.if_else(pc.match_substring_regex(key_text, r"^[^:]{1,20}:"), key_text, ":"), r"^(?P<l>[^:]*:)"), "l")


class Keyed:
    """Lines with every key that is looked up for them."""

    def __init__(self, texts: pa.Array, titles: pa.Array):
        self.lines = L = Lines(texts)
        self.key = L.keys()
        self.words = words_of(L.flat)
        self.ends = np.array(pc.match_substring_regex(L.flat, "[.!?…;][\"”»)]?$").to_numpy(zero_copy_only=False))
        own = line_key_text(squeezed(pc.fill_null(titles.cast(pa.large_string()), "")))
        self.own_title = hash64(own)
        short = np.flatnonzero(~L.blank & (self.words <= 24))
        # three or more blanks in a row part the entries of a menu, too
        parted = squeezed(pc.replace_substring_regex(L.raw.take(pa.array(short)), r"\b[ \t]{3,}\b", " · "))
        self.parted = np.zeros(len(L.raw), np.float32)
        self.parted[short] = count(parted, SEPARATORS)
        some = line_key_text(parted)
        at, parts = _segments(some)
        keep = numbers(pc.utf8_length(parts)) > 0
        self.seg_line, self.seg_words = short[at[keep]], words_of(parts)[keep]
        self.seg_key = hash64(parts.filter(pa.array(keep)))
        long = np.flatnonzero(~L.blank & (self.words >= 3) & (self.words <= 40))
        at, starts = _prefixes(L.key_text.take(pa.array(long)))
        self.pre_line = long[at] if len(at) else np.zeros(0, np.int64)
        self.pre_key = hash64(pa.array(["t:" + s for s in starts], pa.large_string()))
        self.pre_own = self.pre_key == self.own_title_prefix(own)[L.page[self.pre_line]] if len(at) else np.zeros(0, bool)
        labels = _label(L.key_text)
        self.lab_line = np.flatnonzero(pc.greater(pc.utf8_length(labels), 1).to_numpy(zero_copy_only=False))
        self.lab_key = hash64(pc.binary_join_element_wise(pa.scalar("l:", pa.large_string()), labels.take(pa.array(self.lab_line)), NONE))

    @staticmethod
    def own_title_prefix(own: pa.Array) -> np.ndarray:
        first = pc.list_element(pc.split_pattern_regex(own, r" [-–—|] "), 0)
        return hash64(pc.binary_join_element_wise(pa.scalar("t:", pa.large_string()), first, NONE))

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (page, key) to look up, distinct."""
        use = ~self.lines.blank
        page = np.concatenate([self.lines.page[use], self.lines.page[self.seg_line], self.lines.page[self.pre_line], self.lines.page[self.lab_line]])
        key = np.concatenate([self.key[use], self.seg_key, self.pre_key, self.lab_key])
        order = np.lexsort((key, page))
        page, key = page[order], key[order]
        new = np.ones(len(page), bool)
        new[1:] = (page[1:] != page[:-1]) | (key[1:] != key[:-1])
        return page[new], key[new]


def _batches(frames: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in frames:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def _counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page: each distinct block, segment-free, and label once; titles as link texts; one mark of the site."""
    for b in _batches(frames):
        k = Keyed(b.column("text"), b.column("title"))
        L, site = k.lines, b.column("site").to_numpy(zero_copy_only=False)
        use = np.flatnonzero(~L.blank)
        page = np.concatenate([L.page[use], L.page[k.lab_line]])
        key = np.concatenate([k.key[use], k.lab_key])
        order = np.lexsort((key, page))
        page, key = page[order], key[order]
        new = np.ones(len(page), bool)
        new[1:] = (page[1:] != page[:-1]) | (key[1:] != key[:-1])
        page, key = page[new], key[new]
        own = line_key_text(squeezed(pc.fill_null(b.column("title").cast(pa.large_string()), "")))
        at, starts = _prefixes(own)
        named = numbers(pc.count_substring(pa.array(starts, pa.large_string()), " ")) >= 2 if len(starts) else np.zeros(0, bool)
        t_key = hash64(pa.array(["t:" + s for s in starts], pa.large_string()))[named]
        at = at[named] if len(at) else at
        rows = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([site[page], site[at], site]), pa.int64()),
                pa.array(np.concatenate([key, t_key, np.full(rows, SITE_MARK)]), pa.int64()),
                pa.array(np.concatenate([np.ones(len(key)), np.zeros(len(t_key)), np.ones(rows)]), pa.int64()),
                pa.array(np.concatenate([np.zeros(len(key)), np.ones(len(t_key)), np.zeros(rows)]), pa.int32()),
            ],
            names=["site", "key", "pages", "link"],
        )


def _asked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _batches(frames):
        k = Keyed(b.column("text"), b.column("title"))
        page, key = k.wanted()
        site, ids = b.column("site").to_numpy(zero_copy_only=False), b.column("row_id").to_numpy(zero_copy_only=False)
        page, key = np.concatenate([page, np.arange(b.num_rows)]), np.concatenate([key, np.full(b.num_rows, SITE_MARK)])
        yield pa.RecordBatch.from_arrays([pa.array(site[page]), pa.array(key, pa.int64()), pa.array(ids[page])], names=["site", "key", "row_id"])


def _anchor_keys(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        texts = line_key_text(squeezed(pc.fill_null(b.column("text").cast(pa.large_string()), "")))
        keep = pc.not_equal(texts, "")
        keys = hash64(texts.filter(keep))
        yield pa.RecordBatch.from_arrays([b.column("site").filter(keep), pa.array(keys), pa.array(np.zeros(len(keys)), pa.int64()), pa.array(np.ones(len(keys)), pa.int32())], names=["site", "key", "pages", "link"])


def features(k: Keyed, found_page: np.ndarray, found_key: np.ndarray, found_pages: np.ndarray, found_link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix of the non-blank lines, and their indices. The found arrays hold what was looked up, by row of the page."""
    L = k.lines
    mix = found_key ^ (found_page * np.int64(-7046029254386353131))
    order = np.argsort(mix, kind="stable")
    mix, pages, link = mix[order], found_pages[order].astype(np.float32), found_link[order].astype(np.float32)

    def get(page: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(mix) or not len(key):
            return np.zeros(len(key), np.float32), np.zeros(len(key), np.float32)
        m = key ^ (page * np.int64(-7046029254386353131))
        i = np.minimum(np.searchsorted(mix, m), len(mix) - 1)
        hit = mix[i] == m
        return np.where(hit, pages[i], 0), np.where(hit, link[i], 0)

    n = len(L.raw)
    every = np.arange(L.n_pages)
    site_pages = np.maximum(get(every, np.full(L.n_pages, SITE_MARK))[0], 1)
    df, link_line = get(L.page, k.key)
    df = np.maximum(df, 1)
    per = site_pages[L.page]
    seg_link = get(L.page[k.seg_line], k.seg_key)[1]
    linked = np.bincount(k.seg_line, weights=seg_link * k.seg_words, minlength=n)
    seg_all = np.bincount(k.seg_line, weights=k.seg_words, minlength=n)
    density = np.where(seg_all > 0, linked / np.maximum(seg_all, 1), 0)
    density = np.maximum(density, link_line)
    title = np.zeros(n, np.float32)
    if len(k.pre_line):
        hit = get(L.page[k.pre_line], k.pre_key)[1] * ~k.pre_own
        np.maximum.at(title, k.pre_line, hit)
    density = np.maximum(density, title)
    label = np.zeros(n, np.float32)
    label[k.lab_line] = np.maximum(get(L.page[k.lab_line], k.lab_key)[0], 1) / per[k.lab_line]
    share = np.where(df > 1, df / per, 0)
    w = np.maximum(k.words, 1)
    flat = L.flat
    f = {
        "words": k.words,
        "letters_a_word": numbers(pc.utf8_length(flat)) / w,
        "ends_sentence": k.ends,
        "sentences": count(flat, r"[.!?…] "),
        "commas_a_word": count(flat, ",") / w,
        "separators_a_word": k.parted / w,
        "capitals": count(flat, r"(?:^| )\p{Lu}") / w,
        "digits": count(flat, r"(?:^| )[^ ]*[0-9]") / w,
        "bullet": count(flat, r"^[-*•–] "),
        "site_share": share,
        "site_pages": np.minimum(df, 50),
        "link_density": density,
        "label_share": label,
        "title_link": title,
        "from_top": L.no / np.maximum(L.count[L.page], 1),
        "from_end": np.minimum(L.count[L.page] - L.no, 20),
        "colon": count(flat, ":"),
    }
    at = np.flatnonzero(~L.blank)
    page = L.page[at]
    prev_same, next_same = np.zeros(len(at), bool), np.zeros(len(at), bool)
    prev_same[1:] = page[1:] == page[:-1]
    next_same[:-1] = page[1:] == page[:-1]

    def near(values: np.ndarray, step: int) -> np.ndarray:
        v = np.asarray(values, np.float32)[at]
        out = np.zeros(len(v), np.float32)
        if step < 0:
            out[1:] = v[:-1]
            return np.where(prev_same, out, -1)
        out[:-1] = v[1:]
        return np.where(next_same, out, -1)

    for name, source in (("words", "words"), ("links", "link_density"), ("share", "site_share"), ("sentence", "ends_sentence")):
        f[f"before_{name}"], f[f"after_{name}"] = near(f[source], -1), near(f[source], 1)
    cols = [v if name.startswith(("before_", "after_")) else np.asarray(v, np.float32)[at] for name, v in ((c, f[c]) for c in FEATURES)]
    return (np.stack(cols, 1) if len(at) else np.zeros((0, len(FEATURES)), np.float32)), at


def prepared(pages: DataFrame, text: str, *extra: str) -> DataFrame:
    return pages.select(
        F.col("page_id").alias("row_id"), F.xxhash64(site_of(F.col("url"))).alias("site"), F.coalesce(F.col("title"), F.lit("")).alias("title"), F.col(text).alias("text"), *extra
    ).filter(F.length(F.col("text")) > 0)


def classified(pages: DataFrame, links: DataFrame, text: str, emit: Callable, schema: str | T.StructType, extra: tuple[str, ...] = (), tree: Tree | None = None) -> DataFrame:
    """Runs ``emit(batch, keyed, own, x, at)`` on Arrow batches of pages whose blocks have been classified.

    ``own`` is True for each non-blank line of the batch that is the page's own content (index as in ``keyed.lines``);
    ``x`` has the features of the non-blank lines, whose indices are ``at``.
    ``emit`` yields Arrow batches of ``schema``. Pages without text do not appear.
    """
    tree = tree or train()
    p = prepared(pages, text, *extra)
    one = "site long, key long, pages long, link int"
    said = p.select("row_id", "site", "title", "text").mapInArrow(_counted, one)
    anchors = links.select(F.xxhash64(site_of(F.col("src_url"))).alias("site"), "text").filter(F.length("text") > 0).mapInArrow(_anchor_keys, one)
    table = (
        said.unionByName(anchors).groupBy("site", "key").agg(F.sum("pages").alias("pages"), F.max("link").alias("link")).filter("pages >= 2 or link = 1")
    )
    table = stored(table, "block-keys")
    total = table.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    asked = p.select("row_id", "site", "title", "text").mapInArrow(_asked, "site long, key long, row_id long")
    weight = F.greatest(F.col("pages"), F.lit(1))
    hits = lookup(asked, table.withColumn("weight", weight), ["site", "key"], ["pages", "link"], "weight", max(total, 1), F.col("row_id")).filter("pages is not null")
    found = hits.groupBy("row_id").agg(F.collect_list(F.struct("key", "pages", "link")).alias("found"))
    joined = p.join(found, "row_id", "left")

    def run(frames):
        for b in _batches(frames):
            k = Keyed(b.column("text"), b.column("title"))
            found = b.column("found")
            flat = found.flatten()
            page = pc.list_parent_indices(found).to_numpy(zero_copy_only=False).astype(np.int64)
            get = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
            x, at = features(k, page, get("key"), get("pages"), get("link"))
            own = np.zeros(len(k.lines.raw), bool)
            own[at] = tree.predict(x) == 0
            yield from emit(b, k, own, x, at)

    return joined.mapInArrow(run, schema)


def _features(b, k, own, x, at):
    L = k.lines
    yield pa.RecordBatch.from_arrays(
        [pa.array(b.column("row_id").to_numpy(zero_copy_only=False)[L.page[at]]), pa.array(L.no[at], pa.int64()), L.raw.take(pa.array(at)).cast(pa.string()), *[pa.array(x[:, i].astype(np.float64)) for i in range(x.shape[1])]],
        names=["page_id", "line_no", "line", *FEATURES],
    )


def block_features(pages: DataFrame, links: DataFrame, text: str = "body_text") -> DataFrame:
    """The features of every block: for labelling and for looking into a decision."""
    dummy = Tree(1).fit(np.zeros((1, len(FEATURES))), np.zeros(1, int))
    return classified(pages, links, text, _features, "page_id long, line_no long, line string, " + ", ".join(f"{c} double" for c in FEATURES), tree=dummy)


def heads(b, k, at: np.ndarray, size: int) -> np.ndarray:
    """Which of the lines ``at`` begin within the first ``size`` characters of their text."""
    L = k.lines
    length = pc.utf8_length(L.raw).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    before = np.cumsum(length) - length
    return (before - before[np.minimum(L.first[L.page], max(len(before) - 1, 0))])[at] < size


def boilerplate_lines(pages: DataFrame, links: DataFrame, text: str = "body_text", tree: Tree | None = None, head: int | None = None) -> DataFrame:
    """``page_id, line_no`` of each non-blank line that is not the page's own content.

    With ``head``, pages whose first ``head`` characters are template residue or a keyword or link list are left out: nothing on
    them is content. Null or empty texts give no rows; pages with a null or hostless URL count as one site; extra columns are ignored.
    """

    def emit(b, k, own, x, at):
        from .residue import excluded

        L = k.lines
        other = ~L.blank & ~own
        if head:
            first = heads(b, k, at, head)
            other &= ~(excluded(b, k, own, x[first], at[first]) & b.column("sampled").to_numpy(zero_copy_only=False))[L.page]
        other = np.flatnonzero(other)
        yield pa.RecordBatch.from_arrays([pa.array(b.column("row_id").to_numpy(zero_copy_only=False)[L.page[other]]), pa.array(L.no[other], pa.int64())], names=["page_id", "line_no"])

    sampled = (F.length("body_sample") > 0) if "body_sample" in pages.columns else F.lit(True)
    pages = pages.withColumn("sampled", F.coalesce(sampled, F.lit(False)))
    return classified(pages, links, text, emit, "page_id long, line_no long", ("sampled",), tree=tree)


def main_text(pages: DataFrame, links: DataFrame, text: str = "body_text", tree: Tree | None = None) -> DataFrame:
    """``page_id, main_text``: the page's own lines, in order, joined by line feeds ('' when none is left)."""

    def emit(b, k, own, x, at):
        L = k.lines
        keep = np.flatnonzero(own)
        size = np.bincount(L.page[keep], minlength=L.n_pages)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), L.raw.take(pa.array(keep)).cast(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pc.binary_join(lists, "\n")], names=["page_id", "main_text"])

    return classified(pages, links, text, emit, "page_id long, main_text string", tree=tree)
