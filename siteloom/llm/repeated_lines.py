"""Lines repeated across one site's documents: distributed PrefixSpan over line-identifier sequences per source.

A document is the sequence of the identifiers of its lines (hashes of the text without regard to case, white space and
digit values). Level 1 counts the distinct documents that hold each line; lines that are not frequent cannot be part of a
frequent sequence and are dropped. What is left of a document is often the same as in many others (a template), so equal
sequences are one row with a number of documents. From there prefixes grow: the projected database of a prefix is where it ends
in each sequence, its extensions are the items behind these places, and those with enough documents are the next
prefixes, until none is left; there is no greatest length. ``gap`` lets an extension skip so many frequent lines (infrequent ones never count).

Sites whose different sequences are short enough in all are mined many to a task, a whole level at once; larger ones by one
distributed join and count a level. Both give the same patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..plans.lineage import stored
from ..plans.skew import lookup
from .lines import Lines

SUPPORT = 8
CUT_AT = 1500
#: Sites with more items in their different sequences are mined level by level on the cluster; about so many items make a task.
LOCAL_ITEMS = 1_000_000
#: Of which site a pattern is, its length, documents that hold it, and where it stands first (least document, least line).
PATTERN = "site long, length int, docs long, doc long, line_no int"


def line_items(pages: DataFrame, text: str = "body_sample", cut_at: int | None = CUT_AT) -> DataFrame:
    """``site, doc, line_no, item`` of each non-blank line. A text of exactly ``cut_at`` characters may be cut off: its last line is left out."""

    def run(frames):
        for b in frames:
            for start in range(0, b.num_rows, 1000):
                c = b.slice(start, 1000)
                L = Lines(c.column("text"))
                keep = ~L.blank
                cut = c.column("cut").to_numpy(zero_copy_only=False)
                keep &= ~(cut[L.page] & (L.no == L.count[L.page]))
                at = np.flatnonzero(keep)
                items = L.keys()[at]
                get = lambda name: pa.array(c.column(name).to_numpy(zero_copy_only=False)[L.page[at]])
                yield pa.RecordBatch.from_arrays([get("site"), get("doc"), pa.array(L.no[at], pa.int32()), pa.array(items)], names=["site", "doc", "line_no", "item"])

    cut = (F.length(text) == cut_at) if cut_at else F.lit(False)
    return (
        pages.filter(F.length(text) > 0)
        .select(F.xxhash64(site_of(F.col("url"))).alias("site"), F.col("page_id").alias("doc"), F.col(text).alias("text"), cut.alias("cut"))
        .mapInArrow(run, "site long, doc long, line_no int, item long")
    )


def frequent_lines(items: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Level 1: ``site, item, docs, uses`` of the lines that stand in at least ``support`` documents of a site."""
    once = items.groupBy("site", "item", "doc").agg(F.count("*").alias("uses"))
    return once.groupBy("site", "item").agg(F.count("*").alias("docs"), F.sum("uses").alias("uses")).filter(F.col("docs") >= support)


def frequent_occurrences(items: DataFrame, level1: DataFrame, total: int) -> DataFrame:
    """Occurrences of the frequent lines, ``site, doc, line_no, item``."""
    return lookup(items, level1, ["site", "item"], ["docs"], "uses", max(total, 1), F.col("doc")).filter("docs is not null").select("site", "doc", "line_no", "item")


def document_sequences(occurrences: DataFrame) -> DataFrame:
    """``site, doc, nos, items, seq``: the frequent lines of each document in order, their numbers, and the identity of the sequence."""
    pairs = F.sort_array(F.collect_list(F.struct("line_no", "item")))
    d = occurrences.groupBy("site", "doc").agg(pairs.alias("s")).select("site", "doc", F.col("s.line_no").alias("nos"), F.col("s.item").alias("items"))
    return d.withColumn("seq", F.xxhash64("site", "items"))


def different_sequences(documents: DataFrame) -> DataFrame:
    """``site, seq, docs, doc, nos, items``: each sequence once, with its number of documents and the least of them."""
    g = documents.groupBy("site", "seq").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "nos", "items")).alias("first"))
    return g.select("site", "seq", "docs", "first.doc", "first.nos", "first.items")


def mine(site: np.ndarray, docs: np.ndarray, start: np.ndarray, items: np.ndarray, support: int, gap: int = 0) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """PrefixSpan on sequences that lie one after the other in ``items`` (``start``: where each begins, and the end of all).

    Returns the levels as (length, number of documents of each pattern, where it stands first), and for each item the length of the longest
    frequent pattern over it (without gaps). Pattern ids are pairs (prefix, item), numbered anew on each level.
    """
    many, n = len(docs), len(items)
    seq = np.repeat(np.arange(many), np.diff(start))
    end = start[1:][seq] if n else start[:0]
    code = np.unique(items, return_inverse=True)[1].astype(np.int64)
    width = int(code.max()) + 1 if n else 1
    prefix = np.unique(site[seq] if n else items, return_inverse=True)[1].astype(np.int64)
    at = begin = np.arange(n)
    levels, cover, length = [], np.zeros(n, np.int32), 0
    while len(at):
        length += 1
        group = np.unique(prefix * width + code[at], return_inverse=True)[1]
        held = np.unique(group * many + seq[at])
        found = np.bincount(held // many, weights=docs[held % many]).astype(np.int64)
        keep = found[group] >= support
        group, at, begin = group[keep], at[keep], begin[keep]
        ids, first = np.unique(group, return_index=True)
        if not len(ids):
            break
        levels.append((length, found[ids], begin[first]))
        if gap == 0:
            edge = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(begin + length, minlength=n + 1)[: n + 1]
            cover[np.cumsum(edge)[:n] > 0] = length
        parts = []
        for step in range(1, gap + 2):
            ok = at + step < end[at]
            parts.append((group[ok], at[ok] + step, begin[ok]))
        prefix, at, begin = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if gap:  # the same place may be reached in several ways: one is enough, the first
            order = np.lexsort((begin, at, prefix))
            prefix, at, begin = prefix[order], at[order], begin[order]
            new = np.ones(len(at), bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (at[1:] != at[:-1])
            order = np.flatnonzero(new)[np.lexsort((at[new], begin[new]))]
            prefix, at, begin = prefix[order], at[order], begin[order]
    return levels, cover


_MINED = f"{PATTERN}, seq long, cover array<int>"


def _mined_here(support: int, gap: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc").combine_chunks()
        column = lambda name: table.column(name).combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)
        flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False)
        site, docs, doc = (column(c).to_numpy(zero_copy_only=False) for c in ("site", "docs", "doc"))
        size = pc.list_value_length(column("items")).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        levels, cover = mine(site, docs, start, flat("items"), support, gap)
        seq = np.repeat(np.arange(len(size)), size)
        first = np.concatenate([f for _, _, f in levels] or [np.zeros(0, np.int64)])
        n, m = len(first), len(size)
        nothing = lambda k, t: pa.nulls(k, t)
        covers = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(cover, pa.int32()))
        patterns = [
            pa.array(site[seq[first]]), pa.array(np.concatenate([np.full(len(f), k) for k, _, f in levels] or [first]), pa.int32()), pa.array(np.concatenate([d for _, d, _ in levels] or [first]), pa.int64()),
            pa.array(doc[seq[first]]), pa.array(flat("nos")[first], pa.int32()), nothing(n, pa.int64()), nothing(n, covers.type),
        ]
        rest = [pa.array(site), nothing(m, pa.int32()), nothing(m, pa.int64()), nothing(m, pa.int64()), nothing(m, pa.int32()), column("seq"), covers]
        return pa.table([pa.chunked_array([p, r]) for p, r in zip(patterns, rest)], names=["site", "length", "docs", "doc", "line_no", "seq", "cover"])

    return run


def _mined_by_levels(sequences: DataFrame, support: int, gap: int) -> tuple[DataFrame, DataFrame]:
    """(patterns, ``site, seq, cover``) of large sites: one join, one count and one lookup a level."""
    places = stored(sequences.select("site", "seq", "docs", "doc", "nos", F.posexplode("items").alias("at", "item")), "places")
    state = places.select("site", "seq", "docs", "doc", F.col("item").alias("prefix"), "at", F.col("at").alias("begin"), F.get("nos", F.col("at")).alias("line_no"))
    items = places.select("seq", F.col("at").alias("next"), "item")
    patterns, spans, length = None, None, 0
    while True:
        length += 1
        once = state.groupBy("site", "prefix", "seq").agg(F.first("docs").alias("docs"), F.count("*").alias("uses"), F.min(F.struct("doc", "line_no")).alias("first"))
        frequent = once.groupBy("site", "prefix").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"), F.min("first").alias("first")).filter(F.col("docs") >= support)
        frequent = stored(frequent, "frequent-prefixes")
        total = frequent.agg(F.sum("uses")).first()[0]
        if not total:
            break
        level = frequent.select("site", F.lit(length).alias("length"), "docs", "first.doc", "first.line_no")
        patterns = level if patterns is None else patterns.unionByName(level)
        known = frequent.select("site", "prefix", F.lit(True).alias("known"), "uses")
        kept = lookup(state, known, ["site", "prefix"], ["known"], "uses", total, F.col("seq")).filter("known").drop("known")
        kept = stored(kept, "projected")
        own = kept.select("site", "seq", F.struct("begin", F.lit(length).alias("length")).alias("span"))
        spans = own if spans is None else spans.unionByName(own)
        steps = kept.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(gap + 1)))).withColumn("next", F.col("at") + F.col("step"))
        grown = steps.join(items, ["seq", "next"]).withColumn("prefix", F.shiftleft("prefix", 5).bitwiseXOR(F.shiftrightunsigned("prefix", 59)).bitwiseXOR(F.col("item")))
        state = grown.groupBy("site", "seq", "docs", "doc", "prefix", F.col("next").alias("at")).agg(F.min("begin").alias("begin"), F.min("line_no").alias("line_no"))
    spark = sequences.sparkSession
    if patterns is None:
        return spark.createDataFrame([], PATTERN), spark.createDataFrame([], "site long, seq long, cover array<int>")
    longest = spans.groupBy("site", "seq", "span.begin").agg(F.max("span.length").alias("length")).groupBy("site", "seq").agg(F.collect_list(F.struct("begin", "length")).alias("spans"))
    over = "transform(sequence(0, size(items) - 1), i -> array_max(transform(filter(spans, x -> x.begin <= i and i < x.begin + x.length), x -> x.length)))"
    return patterns, longest.join(sequences.select("site", "seq", "items"), ["site", "seq"]).select("site", "seq", F.expr(over).alias("cover"))


def mined(sequences: DataFrame, support: int = SUPPORT, gap: int = 0, local_items: int = LOCAL_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(frequent patterns ``site, length, docs, doc, line_no``; ``site, seq, cover``: for each place of each sequence the length of the
    longest frequent pattern over it, 0 with gaps). ``sequences`` as of ``different_sequences``."""
    sizes = stored(sequences.groupBy("site").agg(F.sum(F.size("items")).alias("n")), "sequence-sizes")
    large = sizes.filter(F.col("n") > local_items)
    rest = sizes.filter(F.col("n") <= local_items).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(rest[1], max(2 * -(-rest[0] // max(local_items, 1)), min(sequences.sparkSession.sparkContext.defaultParallelism, rest[0] // 20_000))))
    few = large.isEmpty()
    here = sequences if few else sequences.join(large, "site", "left_anti")
    here = here.withColumn("task", F.pmod(F.xxhash64("site"), F.lit(tasks)))
    out = stored(here.groupBy("task").applyInArrow(_mined_here(support, gap), _MINED), "mined")
    patterns, covers = out.filter("seq is null").select("site", "length", "docs", "doc", "line_no"), out.filter("seq is not null").select("site", "seq", "cover")
    if few:
        return patterns, covers
    more, wider = _mined_by_levels(stored(sequences.join(large, "site", "left_semi"), "large-sites"), support, gap)
    return patterns.unionByName(more), covers.unionByName(wider)


def _sequences(pages: DataFrame, text: str, support: int, cut_at: int | None) -> tuple[DataFrame, DataFrame]:
    items = stored(line_items(pages, text, cut_at), "line-items")
    level1 = stored(frequent_lines(items, support), "frequent-lines")
    documents = stored(document_sequences(frequent_occurrences(items, level1, items.count())), "line-sequences")
    return documents, stored(different_sequences(documents), "different-sequences")


def deletions(pages: DataFrame, text: str = "body_sample", support: int = SUPPORT, cut_at: int | None = CUT_AT, local_items: int = LOCAL_ITEMS) -> DataFrame:
    """``page_id, line_no, pattern_length``: every line that belongs to an occurrence of a frequent sequence of its site,
    with the length of the longest such sequence. Null or empty texts give no rows; a null URL counts as the site ''; rows
    that repeat a page_id are one document."""
    documents, sequences = _sequences(pages, text, support, cut_at)
    _, covers = mined(sequences, support, 0, local_items)
    weighed = covers.join(sequences.select("site", "seq", "docs"), ["site", "seq"])
    total = sequences.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    marked = lookup(documents.select("site", "doc", "seq", "nos"), weighed, ["site", "seq"], ["cover"], "docs", max(total, 1), F.col("doc"))
    lines = marked.select("doc", F.explode(F.arrays_zip("nos", "cover")).alias("x")).filter("x.cover >= 1")
    return lines.groupBy(F.col("doc").alias("page_id"), F.col("x.nos").cast("long").alias("line_no")).agg(F.max("x.cover").alias("pattern_length"))


def repeated_lines(pages: DataFrame, text: str = "body_sample", support: int = SUPPORT, cut_at: int | None = CUT_AT) -> DataFrame:
    """``page_id, line_no`` of the lines to delete: those in frequent sequences, single lines included."""
    return deletions(pages, text, support, cut_at).select("page_id", "line_no")


def repeated_sequences(pages: DataFrame, text: str = "body_sample", support: int = SUPPORT, gap: int = 0, cut_at: int | None = CUT_AT, local_items: int = LOCAL_ITEMS) -> DataFrame:
    """``site, length, docs, page_id, line_no``: the frequent sequences of each site, of any length, with the number of documents that hold
    them and where they stand first (least page_id, first line)."""
    _, sequences = _sequences(pages, text, support, cut_at)
    patterns, _ = mined(sequences, support, gap, local_items)
    names = pages.select(F.xxhash64(site_of(F.col("url"))).alias("site"), site_of(F.col("url")).alias("name")).groupBy("site").agg(F.min("name").alias("name"))
    return patterns.join(names, "site").select(F.col("name").alias("site"), F.col("length").cast("long").alias("length"), "docs", F.col("doc").alias("page_id"), F.col("line_no").cast("long").alias("line_no"))


def without_repeated_lines(pages: DataFrame, text: str = "body_sample", support: int = SUPPORT, cut_at: int | None = CUT_AT) -> DataFrame:
    """``page_id, text``: each document without its site's repeated lines. Documents without text keep it as it is."""
    gone = repeated_lines(pages, text, support, cut_at=cut_at).groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.expr(f"concat_ws('\\n', transform(filter(transform(split(`{text}`, '\\n', -1), (x, i) -> named_struct('x', x, 'n', cast(i + 1 as bigint))), x -> gone is null or not array_contains(gone, x.n)), x -> x.x))")
    return pages.select("page_id", F.col(text)).join(gone, "page_id", "left").select("page_id", F.when(F.col(text).isNotNull(), kept).alias("text"))
