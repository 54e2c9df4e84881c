"""Similarity joins: exact set Jaccard with prefix filtering, and dense nearest neighbours in blocks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..plans.lineage import stored
from ..plans.skew import lookup
from ..plans.topk import top


def classes(docs: DataFrame, doc: str, items: Column) -> tuple[DataFrame, DataFrame]:
    """(membership ``doc, class_id``; classes ``class_id, items``) of documents with equal item sets; a class is named by its least document.

    Documents without items belong to no class.
    """
    once = F.explode(F.array(F.transform(F.sort_array(items), lambda x: F.xxhash64(x))))  # a filter is not carried through, so texts are parted once
    sets = docs.select(F.col(doc).alias("doc"), once.alias("items")).filter(F.size("items") > 0)
    sets = stored(sets.select("doc", F.array_sort(F.array_distinct("items")).alias("items")).withColumn("set", F.xxhash64("items")), "item-sets")
    reps = sets.groupBy("set").agg(F.min("doc").alias("class_id"))
    members = sets.select("doc", "set").join(reps, "set").select("doc", "class_id")
    return members, sets.join(reps.select(F.col("class_id").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("class_id"), "items")


#: A prefix key of more sets than this may be parted by one more item, up to so many items.
HOT_KEY, MAX_KEY_ITEMS = 64, 5


def _prefix_keys(ordered: DataFrame, least: float) -> DataFrame:
    """``class_id, n, marks, key, most`` of ``ordered(class_id, n, items, marks)``: similar sets share a key, and the first that they share has in ``most`` no less than their overlap.

    A set that is similar to one of n items shares c = ceil(least x n) of them, the k-th shared one among its first n - c + k. So a key
    is an item among the first n - c + 1, and if so many sets have it that its pairs cost more than its rows, it is replaced by that
    item with each that may be shared next, and so on. Sets that may share no more than the key keep it in a form of its own.
    """
    need = F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int")
    first = ordered.select("class_id", "n", "marks", need.alias("c"), F.posexplode(F.slice("items", F.lit(1), F.col("n") - need + 1)).alias("pos", "key"))
    rows, parts = first, []
    out = lambda d, k: d.select("class_id", "n", "marks", "key", (F.col("n") - F.col("pos") + (k - 1)).alias("most"))
    for k in range(1, MAX_KEY_ITEMS):
        last = F.least(F.col("n"), F.col("n") - F.col("c") + (k + 1))  # the k + 1st shared item is among so many
        cost = rows.groupBy("key").agg(F.count("*").alias("sets"), F.sum(last - F.col("pos")).alias("grown"))
        hot = stored(cost.filter((F.col("sets") > HOT_KEY) & (F.col("sets") * F.col("sets") > 8 * F.col("grown"))).select("key"), "hot-keys")
        if hot.isEmpty():
            break
        parts.append(out(rows.join(hot, "key", "left_anti"), k))
        some = rows.join(hot, "key", "left_semi")
        parts.append(out(some.filter(F.col("c") <= k).withColumn("key", F.xxhash64("key", F.lit("alone"))), k))
        after = some.join(ordered.select("class_id", "items"), "class_id").select("class_id", "n", "marks", "c", "key", F.col("pos").alias("at"), F.posexplode(F.slice("items", F.lit(1), last)).alias("pos", "item"))
        rows = stored(after.filter("pos > at").select("class_id", "n", "marks", "c", "pos", F.xxhash64("key", "item").alias("key")), "longer-keys")
    else:
        k = MAX_KEY_ITEMS
    parts.append(out(rows, k))
    return reduce(DataFrame.unionByName, parts)


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """``a, b, similarity`` (a < b) of all pairs of classes with Jaccard at least ``least``; exact.

    Prefix filter: with items in ascending document frequency, similar sets share one of their first
    n - ceil(least x n) + 1 items; so only rare items meet, or several frequent ones together, and the sizes of the sets must fit. No item is skipped.
    """
    items = sets.select("class_id", F.size("items").alias("n"), F.explode("items").alias("item"))
    freq = stored(items.groupBy("item").agg(F.count("*").alias("df")), "item-sets-per-item").withColumn("uses", F.col("df"))
    total = freq.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    known = lookup(items, freq, ["item"], ["df"], "uses", max(total, 1), F.col("class_id"))
    ordered = known.groupBy("class_id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "item"))), lambda x: x["item"]).alias("items"))
    marks = F.aggregate("items", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))))
    ordered = stored(ordered.withColumn("marks", marks), "ordered-sets")
    # an item that only one set has in its prefix joins nothing
    keys = _prefix_keys(ordered, least)
    x, y = keys.alias("x"), keys.alias("y")
    fits = (F.col("x.n") >= F.lit(least) * F.col("y.n") - 1e-9) & (F.col("y.n") >= F.lit(least) * F.col("x.n") - 1e-9)
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    # the first shared key bounds the overlap by what is left behind it in either set; each bit in which the marks differ stands for an item that only one set has
    enough = (F.least("x.most", "y.most") >= need) & (F.bit_count(F.col("x.marks").bitwiseXOR(F.col("y.marks"))) <= F.col("x.n") + F.col("y.n") - 2 * need)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.class_id") < F.col("y.class_id")) & fits & enough).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()
    left = ordered.select(F.col("class_id").alias("a"), F.col("items").alias("ia"))
    right = ordered.select(F.col("class_id").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("ia") + F.size("ib") - both)).alias("similarity")).filter(F.col("similarity") >= least)


def near_duplicates(docs: DataFrame, doc: str, text: Column, k: int = dims.SHINGLE, least: float = dims.NEAR_DUPLICATE) -> DataFrame:
    """``doc, class_id, links``: every document with shingles; its class of equal shingle sets, and to how many other classes that is similar."""
    members, sets = classes(docs, doc, X.shingles(text, k))
    pairs = jaccard_pairs(sets, least)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("doc", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_pairs(docs: DataFrame, doc: str, text: Column, k: int = dims.SHINGLE, least: float = dims.NEAR_DUPLICATE) -> DataFrame:
    """``a, b, similarity`` between class representatives."""
    return jaccard_pairs(classes(docs, doc, X.shingles(text, k))[1], least)


def title_tokens(title: Column, h1: Column) -> Column:
    """Tokens for cannibalisation: title and h1, folded, more than two letters, without the short stop list."""
    stop = F.array(*[F.lit(w) for w in dims.TITLE_STOP.split()])
    return F.array_distinct(F.filter(F.split(X.normalized(F.concat_ws(" ", title, h1)), " "), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)))


def _titled(pages: DataFrame, doc: str, title: Column, h1: Column) -> DataFrame:
    return pages.select(doc, F.explode(F.array(title_tokens(title, h1))).alias("__t")).filter(F.size("__t") >= 2)


def cannibal_pairs(pages: DataFrame, doc: str, title: Column, h1: Column, least: float = dims.CANNIBAL) -> DataFrame:
    """``a, b, similarity`` of classes of pages whose title and heading tokens overlap by ``least``; equal sets are one class. Sets of one token are left out."""
    some = _titled(pages, doc, title, h1)
    return jaccard_pairs(classes(some, doc, F.col("__t"))[1], least)


def cannibal_members(pages: DataFrame, doc: str, title: Column, h1: Column, least: float = dims.CANNIBAL) -> DataFrame:
    """``doc, class_id, links``: every page that ``cannibal_pairs`` compares; its class, named as there, and to how many other classes that is similar."""
    some = _titled(pages, doc, title, h1)
    members, sets = classes(some, doc, F.col("__t"))
    ends = jaccard_pairs(sets, least).select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("doc", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _matrix(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    m = np.array(vectors, np.float64).reshape(len(ids), -1)
    return np.array(ids, np.int64), m / np.linalg.norm(m, axis=1, keepdims=True)


def dense_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """``query_id, vec_id, rank, cosine``: exact nearest vectors of a stated query set, in blocks of matrix products.

    Vectors and ``queries`` (vec_id, embedding) become rows of up to ``block`` vectors each; every block of vectors meets every block of
    queries once, in one matrix product that keeps ``k`` rows per query. Nothing passes through the driver. Null and
    zero vectors are left out; a vector is not its own neighbour.
    """
    clean = lambda d: d.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")

    def packed(frames):
        for f in frames:
            for start in range(0, f.num_rows, block):
                c = f.slice(start, block)
                ids, m = _matrix(c.column(0).to_pylist(), c.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "m"])

    q = stored(clean(queries).mapInArrow(packed, "ids array<long>, m binary"), "query-blocks")
    v = stored(clean(vectors).mapInArrow(packed, "ids array<long>, m binary"), "vector-blocks")
    met = v.crossJoin(q.select(F.col("ids").alias("qids"), F.col("m").alias("qm")))

    def run(frames):
        for f in frames:
            for i in range(f.num_rows):
                ids, qid = (np.array(f.column(c)[i].as_py(), np.int64) for c in (0, 2))
                m, qm = (np.frombuffer(f.column(c)[i].as_py(), np.float64).reshape(n, -1) for c, n in ((1, len(ids)), (3, len(qid))))
                s = qm @ m.T
                s[qid[:, None] == ids[None, :]] = -2
                o = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 12)), axis=1)[:, :k]
                best, at = np.take_along_axis(s, o, 1), ids[o]
                keep = best > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, keep.sum(1))), pa.array(at[keep]), pa.array(best[keep])], names=["query_id", "vec_id", "cosine"])

    out = met.mapInArrow(run, "query_id long, vec_id long, cosine double")
    return top(out.withColumn("cosine", F.round("cosine", 6)), ["query_id"], [F.desc("cosine"), F.col("vec_id")], k)
