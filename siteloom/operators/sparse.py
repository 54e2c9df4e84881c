"""Cosine of stated documents with all others over TF-IDF vectors: blocks of documents meet blocks of queries in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored
from ..plans.topk import top
from . import ir

#: A term with more than one in so many of all (document, term) pairs is common: at most so many are, and their table goes to every task.
COMMON_PARTS = 20_000
#: Documents and queries of a block; documents that are taken together; numbers of a block's table of its most frequent terms.
DOC_BLOCK, QUERY_BLOCK, CHUNK, TABLE = 2048, 4096, 64, 8_000_000
#: A block of documents: numbers of its terms a document, then all their terms; common ones by place in the table, others by number and weight.
PARTS = {"ids": np.int64, "asked": np.bool_, "norm": np.float64, "hn": np.int32, "hi": np.int32, "ht": np.int32, "cn": np.int32, "ci": np.int64, "cw": np.float64}
_SCHEMA = ", ".join(f"{p} binary" for p in PARTS)


def _blocks(lists: DataFrame, asked: Column, n: int) -> tuple[DataFrame, np.ndarray]:
    """(blocks of documents, see PARTS; ln((n + 1) / (df + 1)) + 1 of the common terms). Terms that no asked document has count in the norm only."""
    each = lists.select(F.coalesce(asked, F.lit(False)).alias("asked"), F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"), F.max("asked").alias("asked"))
    df = stored(df.withColumn("id", F.monotonically_increasing_id()), "term-documents")
    idf = F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1
    least = max(1, (df.agg(F.sum("df")).first()[0] or 0) // COMMON_PARTS)
    hot = sorted((r.term, r.idf) for r in df.filter(F.col("df") > least).select("term", idf.alias("idf")).collect())
    table = lists.sparkSession.sparkContext.broadcast([t for t, _ in hot])

    def parted(frames):
        known = pa.array(table.value, pa.string())
        for f in frames:
            terms, tf = f.column("terms"), f.column("tf").flatten()
            ends, flat = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]), terms.flatten()
            at = pc.index_in(flat, value_set=known)
            is_hot, out = at.is_valid(), [f.column("doc")]
            before = np.concatenate([[0], np.cumsum(is_hot.to_numpy(zero_copy_only=False))])[ends]
            for part, offsets, columns in ((is_hot, before, (at, tf)), (pc.invert(is_hot), ends - before, (flat, tf))):
                out += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), c.filter(part)) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=["doc", "hot", "tf", "cold", "ctf"])

    some = lists.filter("doc is not null").mapInArrow(parted, "doc long, hot array<int>, tf array<int>, cold array<string>, ctf array<int>")
    rare = some.select("doc", F.explode(F.arrays_zip("cold", "ctf")).alias("x")).select("doc", F.col("x.cold").alias("term"), F.col("x.ctf").alias("tf"))
    rare = rare.join(df.filter(F.col("df") <= least).select("term", "id", "asked", idf.alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    rare = rare.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.collect_list(F.when(F.col("asked"), F.struct("id", "w"))).alias("c"))
    rows = some.select("doc", "hot", "tf").join(rare, "doc", "left").select("doc", F.coalesce(asked, F.lit(False)).alias("asked"), "hot", "tf", F.coalesce("square", F.lit(0.0)).alias("square"), F.coalesce(F.col("c.id"), F.array().cast("array<long>")).alias("ci"), F.coalesce(F.col("c.w"), F.array().cast("array<double>")).alias("cw"))
    weights = np.array([w for _, w in hot], np.float64)
    shared = lists.sparkSession.sparkContext.broadcast(weights)

    def packed(frames):
        for f in frames:
            for start in range(0, f.num_rows, DOC_BLOCK):
                c = f.slice(start, DOC_BLOCK)
                flat = lambda name, c=c: c.column(name).flatten().to_numpy(zero_copy_only=False)
                length = lambda name, c=c: pc.list_value_length(c.column(name)).to_numpy(zero_copy_only=False)
                b = {"ids": c.column("doc").to_numpy(zero_copy_only=False), "asked": c.column("asked").to_numpy(zero_copy_only=False), "hn": length("hot"), "hi": flat("hot"), "ht": flat("tf"), "cn": length("ci"), "ci": flat("ci"), "cw": flat("cw")}
                w = b["ht"] * shared.value[b["hi"]]
                b["norm"] = np.sqrt(c.column("square").to_numpy(zero_copy_only=False) + np.bincount(np.repeat(np.arange(c.num_rows), b["hn"]), weights=w * w, minlength=c.num_rows))
                yield _frame(b)

    return stored(rows.mapInArrow(packed, _SCHEMA), "document-blocks"), weights


def _frame(b: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b[p].astype(kind).tobytes()], pa.binary()) for p, kind in PARTS.items()], names=[*PARTS])


def _block(f: pa.RecordBatch, i: int, prefix: str = "") -> dict:
    return {p: np.frombuffer(f.column(prefix + p)[i].as_py(), kind) for p, kind in PARTS.items()}


def _only_asked(frames):
    for f in frames:
        for i in range(f.num_rows):
            b = _block(f, i)
            keep = b["asked"]
            of = {n: np.repeat(keep, b[n]) for n in ("hn", "cn")}
            if keep.any():
                yield _frame({p: v[of["hn"] if p in ("hi", "ht") else of["cn"] if p in ("ci", "cw") else keep] for p, v in b.items()})


def _joined(frames):
    """Small blocks as blocks of QUERY_BLOCK."""
    held, n = [], 0
    for f in frames:
        for i in range(f.num_rows):
            held.append(_block(f, i))
            n += len(held[-1]["ids"])
            if n >= QUERY_BLOCK:
                yield _frame({p: np.concatenate([b[p] for b in held]) for p in PARTS})
                held, n = [], 0
    if held:
        yield _frame({p: np.concatenate([b[p] for b in held]) for p in PARTS})


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Queries:
    """A block of queries, and the best documents for each so far.

    The terms that most queries have are a table of weights; all others are lists of queries. The sums over the lists come first, and the
    table is asked only where what it can add, the product of both lengths in it, brings a document among the best so far.
    """

    def __init__(self, b: dict, weights: np.ndarray, k: int, least: float):
        self.ids, self.n, self.h, self.idf, self.k, self.least = b["ids"], len(b["ids"]), len(weights), weights, k, least
        row, w = np.repeat(np.arange(self.n), b["hn"]), b["ht"] * weights[b["hi"]]
        w = w / b["norm"][row]
        count = np.bincount(b["hi"], minlength=self.h)
        most = np.argsort(-count, kind="stable")[: max(1, TABLE // self.n)]
        most = most[count[most] > max(8, self.n // 33)]
        self.column = np.full(self.h, -1)
        self.column[most] = np.arange(len(most))
        at = self.column[b["hi"]]
        self.table = np.zeros((len(most), self.n))
        self.table[at[at >= 0], row[at >= 0]] = w[at >= 0]
        self.length = np.sqrt((self.table * self.table).sum(0))
        crow = np.repeat(np.arange(self.n), b["cn"])
        self.rare = np.unique(b["ci"])
        slot = np.concatenate([b["hi"][at < 0], self.h + np.searchsorted(self.rare, b["ci"])])
        order = np.argsort(slot, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=self.h + len(self.rare)))])
        self.query = np.concatenate([row[at < 0], crow])[order]
        self.weight = np.concatenate([w[at < 0], b["cw"] / b["norm"][crow]])[order]
        self.floor = np.full(self.n, least)
        self.best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        self.new, self.waiting = [], 0

    def meet(self, d: dict) -> None:
        n = len(d["ids"])
        row, w = np.repeat(np.arange(n), d["hn"]), d["ht"] * self.idf[d["hi"]]
        w, at = w / d["norm"][row], self.column[d["hi"]]
        crow = np.repeat(np.arange(n), d["cn"])
        place = np.searchsorted(self.rare, d["ci"])
        known = place < len(self.rare)
        known[known] = self.rare[place[known]] == d["ci"][known]
        r, slot, lw = (np.concatenate(x) for x in ((row[at < 0], crow[known]), (d["hi"][at < 0], self.h + place[known]), (w[at < 0], (d["cw"] / d["norm"][crow])[known])))
        size = self.start[slot + 1] - self.start[slot]
        order = np.flatnonzero(size)[np.argsort(r[size > 0], kind="stable")]
        r, slot, lw, size = r[order], slot[order], lw[order], size[order]
        trow, tat, tw = row[at >= 0], at[at >= 0], w[at >= 0]
        length = np.sqrt(np.bincount(trow, weights=tw * tw, minlength=n))
        tstart = np.searchsorted(trow, np.arange(n + 1))
        for a in range(0, n, CHUNK):
            z = min(n, a + CHUNK)
            i, j = np.searchsorted(r, (a, z))
            places = _runs(self.start[slot[i:j]], size[i:j])
            key = np.repeat(r[i:j] - a, size[i:j]) * self.n + self.query[places]
            sums = np.bincount(key, weights=np.repeat(lw[i:j], size[i:j]) * self.weight[places], minlength=(z - a) * self.n).reshape(z - a, self.n)
            reach = length[a:z, None] * self.length
            reach += sums
            of, q = np.nonzero(reach >= self.floor - 1e-6)
            value, ends = sums[of, q], np.searchsorted(of, np.arange(z - a + 1))
            for x in range(z - a):
                s, e = ends[x], ends[x + 1]
                c, cw = tat[tstart[a + x] : tstart[a + x + 1]], tw[tstart[a + x] : tstart[a + x + 1]]
                if s < e and len(c):
                    value[s:e] += (cw @ self.table[c])[q[s:e]] if (e - s) * 8 > self.n else cw @ self.table[c[:, None], q[s:e]]
            ids = d["ids"][a + of]
            keep = (value >= self.least) & (value >= self.floor[q] - 1e-6) & (ids != self.ids[q])
            self.new.append((q[keep], ids[keep], np.floor(value[keep] * 1e6 + 0.5) / 1e6))
            self.waiting += keep.sum()
            if self.waiting > 4 * self.n or self.waiting > self.n and not len(self.best[0]):
                self.settle()

    def settle(self) -> None:
        q, ids, value = (np.concatenate(x) for x in zip(self.best, *self.new, strict=True))
        o = np.lexsort((ids, -value, q))
        q, ids, value = q[o], ids[o], value[o]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.least, value[last])
        self.best, self.new, self.waiting = [x[rank < self.k] for x in (q, ids, value)], [], 0


def similar(docs: DataFrame, doc: str, text: Column, asked: Column, k: int = 15, least: float = 0.0) -> DataFrame:
    """``query, doc, cosine``: for each document that is ``asked`` (a condition over ``doc``) its ``k`` most similar others by the cosine, rounded to six places, of ``ir.tfidf`` weights, if that is ``least`` or more; ids are whole numbers."""
    v, weights = _blocks(ir.term_lists(docs.withColumn(doc, F.col(doc).cast("long")), doc, text), asked, docs.count())
    some = stored(v.mapInArrow(_only_asked, _SCHEMA), "query-blocks")
    n = some.agg(F.coalesce(F.sum(F.length("asked")), F.lit(0))).first()[0]
    q = stored(some.repartition(-(-n // QUERY_BLOCK) or 1).mapInArrow(_joined, _SCHEMA), "query-blocks")
    q = q.select(*[F.col(p).alias(f"q_{p}") for p in PARTS])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(frames):
        held: dict[tuple, _Queries] = {}
        for f in frames:
            for i in range(f.num_rows):
                name = f.column("q_ids")[i].as_py()
                if name not in held:
                    yield from out(held)
                    held = {name: _Queries(_block(f, i, "q_"), shared.value, k, least)}
                held[name].meet(_block(f, i))
        yield from out(held)

    def out(held):
        for x in held.values():
            x.settle()
            at, ids, value = x.best
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[at]), pa.array(ids), pa.array(value)], names=["query", "doc", "cosine"])

    found = q.crossJoin(v).mapInArrow(run, "query long, doc long, cosine double")
    return top(found, ["query"], [F.desc("cosine"), F.col("doc")], k)
