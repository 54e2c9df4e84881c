"""Queries of the training-data operators, with production parameters, over whole tables; and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import stored
from ..sources.tables import table
from . import blocks, language, ledger, mixing, packing, reading, repeated_lines, residue, spans, stuffing, tokens


#: Characters of body_text that body_sample holds (fixed value).
SAMPLE = 1500


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows, repeated = ledger.hidden_duplicates(table(spark, d, "page_facts"))
    return ledger.copies_of_first(rows, repeated).select(F.col("row_id_a").alias("page_id_a"), F.col("row_id_b").alias("page_id_b"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per group: its earliest representative and its number of copies."""
    _, repeated = ledger.hidden_duplicates(table(spark, d, "page_facts"))
    return repeated.select(F.col("first_id").alias("page_id"), F.col("least_id").alias("least_page_id"), "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return blocks.boilerplate_lines(table(spark, d, "page_facts"), table(spark, d, "links"), head=SAMPLE)


def p2_main_text(spark: SparkSession, d: str) -> DataFrame:
    return blocks.main_text(table(spark, d, "page_facts"), table(spark, d, "links"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "page_facts"))


def p3_sequences(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_sequences(table(spark, d, "page_facts"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "page_facts")).select("page_id", F.col("text").alias("body_sample"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_facts")
    return language.mislabelled(pages, language.judged_line_languages(pages, table(spark, d, "links"), language.train_filters(pages)))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_facts")
    return language.segments(pages, language.train_filters(pages))


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    """One language and confidence for every page with text."""
    return language.text_languages(p4_segments(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "page_facts"), table(spark, d, "links"), table(spark, d, "reading_labels")).select("page_id", "reading_level")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(table(spark, d, "page_facts"), table(spark, d, "links")).select("page_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "page_facts"), table(spark, d, "links")).select("page_id")


def p7_line_states(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.label_lines(table(spark, d, "page_facts"), table(spark, d, "links"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_kinds(stored(tokens.token_sizes(table(spark, d, "documents")), "token-sizes"), table(spark, d, "container_sizes"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of ``p8_packing`` in each kind of container: every document once, whole unless it exceeds the capacity, no container overfull, and
    the unused space as stated."""
    documents = table(spark, d, "documents")
    sizes = stored(tokens.token_sizes(documents), "token-sizes")
    kinds = table(spark, d, "container_sizes")
    packed = stored(packing.pack_kinds(sizes, kinds), "packed")
    capacity = F.broadcast(kinds.select("container_kind", "capacity_tokens"))
    fill = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("full"), F.min("unused").alias("least"), F.max("unused").alias("most")).join(capacity, "container_kind")
    rest = F.col("capacity_tokens") - F.col("full")
    boxes = fill.groupBy("container_kind").agg(F.count_if(rest < 0).alias("overfull"), F.count_if((rest != F.col("least")) | (rest != F.col("most"))).alias("misstated"))
    whole = packed.groupBy("container_kind", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("packed")).join(sizes, "doc_id", "left").join(capacity, "container_kind")
    needed = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    items = whole.groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.col("packed") != F.col("tokens"), F.lit(True))).alias("changed"), F.count_if(F.col("pieces") != needed).alias("split"))
    return items.join(boxes, "container_kind")


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of ``p9_mixture`` for each target: no record beyond the cap on repeats or twice, none of another source, and a share that misses its
    target by no more than two records of the source (the landing of the cube method), as parts of the whole."""
    targets = table(spark, d, "mix_targets")
    sizes = stored(tokens.token_sizes(table(spark, d, "documents"), "source"), "token-sizes")
    mixed = stored(mixing.mixture(sizes, targets), "mixture")
    own = sizes.select("doc_id", F.col("source").alias("own"), F.col("tokens").alias("size"))
    rows = mixed.join(F.broadcast(targets.select("source", "max_repeats")), "source", "left").join(own, "doc_id", "left")
    by = rows.groupBy("source").agg(
        F.count_if(F.col("repeats") > F.col("max_repeats")).alias("beyond_cap"), F.count_if(~F.col("own").eqNullSafe(F.col("source")) | (F.col("size") != F.col("tokens"))).alias("foreign"), (F.count("*") - F.count_distinct("doc_id")).alias("twice")
    )
    zero = F.lit(0).cast("long")
    off = mixing.landing(mixed, sizes, targets).select("source", (F.abs(F.col("tokens") - F.col("wanted_tokens")) > F.col("landing_bound")).alias("off"))
    return targets.select("source").join(by, "source", "left").join(off, "source", "left").select("source", *[F.coalesce(c, zero).alias(c) for c in ("beyond_cap", "foreign", "twice")], F.coalesce("off", F.lit(False)).alias("off"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(tokens.token_sizes(table(spark, d, "documents"), "source"), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_records, p2_found, p2_main_text, p3_found, p3_sequences, p3_cleaned, p4_found, p4_segments, p4_pages, p5_found, p6_found, p7_found, p7_line_states, p8_packing, p8_invariants, p9_mixture, p9_invariants, p9_shares, p10_found, p10_shared)
}

_KEY = r"regexp_replace(lower(upper(nfc_normalize(regexp_replace({}, '[\x{{fe00}}-\x{{fe0f}}]', '', 'g')))), '[^\p{{L}}\p{{N}}\p{{Mn}}\p{{Mc}}]', '', 'g')"
_GROUPS = f"""
with k as (
  select page_id, fetched_at, {_KEY.format("title")} as a, {_KEY.format("meta_description")} as b from page_facts
), g as (
  select page_id, fetched_at, least(a, b) as x, greatest(a, b) as y from k where a <> '' and b <> ''
), m as (
  select x, y, min(page_id) as least_page_id, arg_min(page_id, (fetched_at, page_id)) as page_id, count(*) as copies from g group by x, y having count(*) > 1
)"""
_SITE = r"regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1)"
_SPACE = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_LINES = f"""
with l as (
  select page_id, {_SITE} as site, length(body_sample) as n, string_split(body_sample, chr(10)) as parts from page_facts where body_sample is not null
), i as (
  select page_id, site, n, len(parts) as many, unnest(parts) as line, generate_subscripts(parts, 1) as line_no from l
), t as (
  select page_id, site, line_no, regexp_replace(replace(lower(trim(regexp_replace(line, '{_SPACE}', ' ', 'g'), ' ')), 'ß', 'ss'), '[0-9]+', '0', 'g') as item
  from i where not (n = 1500 and line_no = many)
), f as (
  select site, item from t where item <> '' group by site, item having count(distinct page_id) >= 8
)"""
#: Every window of 200 characters of every document; cut in two steps, as a place in a long text costs its distance.
_WINDOWS = """
with c as (select doc_id, text, unnest(generate_series(0, (length(text) - 1) // 200)) as b from documents where length(text) >= 200),
p as (select doc_id, b, substring(text, b * 200 + 1, 399) as part from c),
w as (select doc_id, b * 200 + i as place, substring(part, i, 200) as span from (select doc_id, b, part, unnest(generate_series(1, least(200, length(part) - 199))) as i from p where length(part) >= 200)),
g as (select span, list_sort(list(distinct doc_id)) as docs from w group by span having min(doc_id) < max(doc_id))"""
ORACLES: dict[str, str] = {
    "p10_found": _WINDOWS + ", u as (select distinct docs from g), a as (select docs, unnest(docs) as x from u) select distinct x as doc_id_a, y as doc_id_b from (select x, unnest(docs) as y from a) where x < y",
    "p10_shared": _WINDOWS + """, s as (select doc_id, least(200, coalesce(lead(place) over (partition by doc_id order by place) - place, 200)) as new from w join g using (span)),
t as (select doc_id, sum(new) as shared from s group by 1)
select doc_id, cast(coalesce(length(text), 0) as bigint) as n_chars, cast(coalesce(shared, 0) as bigint) as shared_chars, round(coalesce(shared, 0) / greatest(coalesce(length(text), 0), 1), 6) as shared_share from documents left join t using (doc_id)""",
    "p1_found": _GROUPS + " select m.least_page_id as page_id_a, g.page_id as page_id_b from m join g using (x, y) where g.page_id > m.least_page_id",
    "p1_records": _GROUPS + " select page_id, least_page_id, copies from m",
    "p8_invariants": "select container_kind, (select count(*) from documents) as documents, 0 as changed, 0 as split, 0 as overfull, 0 as misstated from container_sizes",
    "p9_invariants": "select source, 0 as beyond_cap, 0 as foreign, 0 as twice, false as off from mix_targets",
    "p3_cleaned": _LINES
    + """, gone as (select t.page_id, t.line_no from t join f using (site, item)), p as (
  select page_id, unnest(string_split(body_sample, chr(10))) as line, generate_subscripts(string_split(body_sample, chr(10)), 1) as line_no from page_facts
), k as (select page_id, string_agg(line, chr(10) order by line_no) as kept from p anti join gone using (page_id, line_no) group by page_id)
select page_id, case when body_sample is not null then coalesce(kept, '') end as body_sample from page_facts left join k using (page_id)""",
    "p3_sequences": _LINES
    + """, o as (select t.page_id, t.site, t.line_no, t.item from t join f using (site, item)),
s as (select page_id, site, list(item order by line_no) as items, list(line_no order by line_no) as nos from o group by page_id, site),
a as (select page_id, site, items, nos, unnest(generate_series(1, len(items))) as i from s), w as (select page_id, site, nos[i] as line_no, items[i:j] as pattern, j - i + 1 as length from (select *, unnest(generate_series(i, len(items))) as j from a))
select site, cast(length as bigint) as length, count(distinct page_id) as docs, min(row(page_id, line_no))[1] as page_id, cast(min(row(page_id, line_no))[2] as bigint) as line_no from w group by site, length, pattern having count(distinct page_id) >= 8""",
    "p3_found": _LINES + " select t.page_id, cast(t.line_no as bigint) as line_no from t join f using (site, item)",
}
