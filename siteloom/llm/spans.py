"""Long exact spans shared between records, by suffix automata of reference shards.

A document need only be streamed past the shards where a match of the asked length is possible. So shards are cut by
content: of every window of ``length`` characters the k-gram with the least hash is an anchor (k = 0.6 x length), so two
documents that share a window share its anchor, at the same place in the window. The reference shard of an anchor holds
the different surroundings of its occurrences (all that a window around the anchor can reach); a suffix automaton is
built of each, and the other surroundings of the shard are streamed through it for matching statistics. Maximal spans of
at least ``length`` characters remain. The result is exact: nothing is sampled, and spans are compared character by
character.

Texts are not shuffled with their anchors: an anchor is three numbers, and only for those that several documents hold are
the surroundings cut from the texts. The filter that is broadcast is a bit map of a fixed size. It only spares shuffling
anchors that cannot match; where it fills up, the exact join behind it still holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored
from ..plans.skew import lookup

LENGTH = 200
MAP_BITS = 25
#: Different surroundings of one anchor that are compared in one task; larger shards are compared block by block.
BLOCK = 500
#: Members of a group of copies that meet in one task when pairs are written out; larger groups are paired block by block.
PAIR_BLOCK = 1000
_BASE = 0x9E3779B97F4A7C15


class Anchors:
    """Anchors of a batch of texts: for every window of ``length`` characters the position of its least k-gram hash."""

    def __init__(self, length: int):
        self.length, self.k = length, max(1, int(length * 0.6))
        self.w = length - self.k + 1

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of all k-grams, from prefix sums of a polynomial modulo 2^64, in stretches so that powers are reused."""
        k, n = self.k, len(codes) - self.k + 1
        size = 1 << 16
        if not hasattr(self, "_powers"):
            self._powers = np.cumprod(np.full(size + k, _BASE, np.uint64))
            self._inverse = np.cumprod(np.full(size + k, pow(_BASE, -1, 1 << 64), np.uint64))
        out = np.empty(n, np.uint64)
        for s in range(0, n, size):
            e = min(n, s + size)
            part = codes[s : e + k - 1].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * self._powers[: len(part)], out=sums[1:])
            out[s:e] = (sums[k:] - sums[:-k]) * self._inverse[: e - s]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return out

    def _places(self, h: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Position of the least hash of the windows that begin at ``at``, the last if there are several."""
        w = self.w
        place = at + w - 1
        rest = np.flatnonzero(h[place] != value)
        for s in range(0, len(rest), 1 << 15):
            r = rest[s : s + (1 << 15)]
            window = h[(at[r] + w - 1)[:, None] - np.arange(w)[None, :]]
            place[r] = at[r] + w - 1 - window.argmin(1)
        return place

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the text, position of the anchor, hash), each anchor once."""
        w, k = self.w, self.k
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(lengths) or lengths.sum() < self.length:
            return empty
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        start = np.concatenate([[0], np.cumsum(lengths)])
        h = self._hashes(codes)
        m = len(h) - w + 1
        pad = (-len(h)) % w
        blocks = np.concatenate([h, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
        # window starts that lie in one text, where the least hash is another than one place before
        count = np.maximum(lengths - self.length + 1, 0)
        row_of = np.repeat(np.arange(len(lengths)), count)
        at = np.arange(len(row_of)) + np.repeat(start[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        value = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (row_of[1:] != row_of[:-1])
        begins = np.flatnonzero(new)
        last = at[np.concatenate([begins[1:], [len(at)]]) - 1] if len(begins) else at[:0]
        at, row_of, value = at[new], row_of[new], value[new]
        place = self._places(h, at, value)
        # in periodic text the same least hash goes on behind the anchor: take its further occurrences, too
        parts = [(row_of, place, value)]
        more = place < last
        while more.any():
            row_of, value, last, at = row_of[more], value[more], last[more], place[more] + 1
            place = self._places(h, at, value)
            parts.append((row_of, place, value))
            more = place < last
        row_of, place, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((place, row_of))
        row_of, place, value = row_of[order], place[order], value[order]
        return row_of, place - start[row_of], value.view(np.int64)


class SuffixAutomaton:
    """Suffix automaton of one text; ``longest`` streams another through it."""

    def __init__(self, text: str):
        self.next, self.link, self.size, self.end = [{}], [-1], [0], [-1]
        last = 0
        nxt, link, size, end = self.next, self.link, self.size, self.end
        for i, c in enumerate(text):
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            end.append(i)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    size.append(size[p] + 1)
                    end.append(end[q])
                    link.append(link[q])
                    link[q] = link[cur] = copy
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
            last = cur

    def longest(self, text: str) -> tuple[int, int, int]:
        """(length, end in ``text``, end in the automaton's text) of the longest common span; ends are exclusive."""
        nxt, link, size, end = self.next, self.link, self.size, self.end
        state = matched = best = at = there = 0
        for i, c in enumerate(text):
            while state and c not in nxt[state]:
                state = link[state]
                matched = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
                if matched > best:
                    best, at, there = matched, i + 1, end[state] + 1
        return best, at, there


def _bitmap(table: DataFrame, key: str, bits: int = MAP_BITS) -> np.ndarray:
    """A bit map of 2^bits bits, with the low bits of each key set: at most 2^bits / 8 bytes whatever the table."""
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    parts = (
        table.select(slot.alias("slot"))
        .groupBy(F.expr("slot div 32768").alias("part"))
        .agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        got = np.frombuffer(bytes(r.bits), np.uint8)
        out[r.part * 4096 : r.part * 4096 + len(got)] = got
    return out


def _texts(documents: DataFrame, length: int) -> DataFrame:
    return documents.filter(F.length("text") >= length).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), "text")


def surroundings(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``anchor, doc, pos, left, text, here``: each occurrence of an anchor that at least two documents hold, with all
    text that a window of ``length`` around it can reach; ``left`` is the anchor's place in it, ``here`` hashes it."""
    cutter = Anchors(length)

    def batches(frames):
        for b in frames:
            for s in range(0, b.num_rows, 500):
                yield b.slice(s, 500)

    def anchors(frames):
        for b in batches(frames):
            row, pos, h = cutter(b.column("text").cast(pa.large_string()))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column("doc").take(row), b.column("version").take(row), pa.array(pos, pa.int32())], names=["anchor", "doc", "version", "pos"])

    docs = _texts(documents, length)
    places = stored(docs.mapInArrow(anchors, "anchor long, doc long, version long, pos int"), "anchors")
    several = places.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).filter("a < b").select("anchor", "n")
    several = stored(several, "shared-anchors")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = documents.sparkSession.sparkContext.broadcast(_bitmap(several, "anchor"))
    k, reach = cutter.k, length - cutter.k

    def possible(frames):
        mask = (1 << MAP_BITS) - 1
        for b in frames:
            slot = b.column("anchor").to_numpy(zero_copy_only=False) & mask
            yield b.filter(pa.array((bits.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0))

    found = places.mapInArrow(possible, "anchor long, doc long, version long, pos int")
    exact = lookup(found, several, ["anchor"], ["n"], "n", max(total, 1), F.col("doc")).filter("n is not null")
    of_doc = exact.groupBy("doc", "version").agg(F.collect_list(F.struct("anchor", "pos")).alias("at"))

    def cuts(frames):
        for b in batches(frames):
            flat = b.column("at").flatten()
            row = pc.list_parent_indices(b.column("at"))
            h, pos = flat.field("anchor"), flat.field("pos").to_numpy(zero_copy_only=False)
            left = np.minimum(pos, reach)
            own, last, out = "", -1, []
            for r, p, lf in zip(row.to_pylist(), pos.tolist(), left.tolist()):
                if r != last:
                    own, last = b.column("text")[r].as_py(), r
                out.append(own[p - lf : p + k + reach])
            yield pa.RecordBatch.from_arrays([h, b.column("doc").take(row), pa.array(pos, pa.int32()), pa.array(left, pa.int32()), pa.array(out, pa.string())], names=["anchor", "doc", "pos", "left", "text"])

    # rows with the same doc_id are one document, but each text has places of its own
    exact = docs.join(of_doc, ["doc", "version"]).select("doc", "text", "at").mapInArrow(cuts, "anchor long, doc long, pos int, left int, text string")
    return exact.withColumn("here", F.xxhash64("left", "text"))


_SHARD = ("anchor", "side", "part", "one", "other")
_MATCH = "anchor long, here_a long, here_b long, from_a int, from_b int, size int"


def _compared(length: int, k: int):
    """Compares the surroundings of each shard; shards come one after the other in sorted batches."""
    reach = length - k

    def shard(key, rows, out):
        """Pairs of different surroundings that share a span of ``length`` over the anchor."""
        anchor, side, _, one, other = key
        for i, (here, left, text, block) in enumerate(rows):
            machine = None
            for here_j, left_j, text_j, block_j in rows[i + 1 :]:
                if one != other and block == block_j:
                    continue
                if side == 1 and left >= reach // 2 and left_j >= reach // 2 and text[left - reach // 2 : left] == text_j[left_j - reach // 2 : left_j]:
                    continue  # the shard of what stands before the anchor compares these
                machine = machine or SuffixAutomaton(text)
                n, at_j, at_i = machine.longest(text_j)
                if n >= length:
                    out.append((anchor, here, here_j, at_i - n, at_j - n, n))

    def run(frames):
        import itertools

        def rows():
            for b in frames:
                yield from zip(zip(*[b.column(c).to_pylist() for c in _SHARD]), zip(*[b.column(c).to_pylist() for c in ("here", "left", "text", "block")]))

        names = ["anchor", "here_a", "here_b", "from_a", "from_b", "size"]
        types = [pa.int64()] * 3 + [pa.int32()] * 3
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
        for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
            shard(key, [r for _, r in group], out)
            if len(out) > 50_000:
                yield batch()
                out.clear()
        yield batch()

    return run


def shard_matches(around: DataFrame, length: int = LENGTH) -> DataFrame:
    """``anchor, here_a, here_b, from_a, from_b, size``: maximal spans shared by two different surroundings of an anchor.

    A window over the anchor has, before or behind it, at least half of what is left of its length: shards are cut
    further by that half, so that surroundings that cannot match do not meet. Large shards are compared in blocks.
    """
    k = Anchors(length).k
    half = (length - k) // 2
    distinct = around.groupBy("anchor", "here").agg(F.first("left").alias("left"), F.first("text").alias("text"))
    before = F.when(F.col("left") >= half, F.xxhash64(F.expr(f"substring(text, left - {half} + 1, {half})")))
    behind = F.when(F.length("text") - F.col("left") - k >= length - k - half, F.xxhash64(F.expr(f"substring(text, left + {k} + 1, {length - k - half})")))
    sided = distinct.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), before.alias("part")), F.struct(F.lit(1).alias("side"), behind.alias("part")))).alias("s")).select("anchor", "here", "left", "text", "s.side", "s.part").filter("part is not null")
    sided = stored(sided, "shards")
    sizes = sided.groupBy("anchor", "side", "part").agg(F.count("*").alias("m")).filter("m >= 2")
    total = sided.count()
    many = lookup(sided, stored(sizes, "shard-sizes"), ["anchor", "side", "part"], ["m"], "m", max(total, 1), F.col("here")).filter("m is not null")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    many = many.withColumn("block", F.pmod(F.xxhash64("here", "anchor"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = many.withColumn("one", F.least("block", "with")).withColumn("other", F.greatest("block", "with"))
    shards = many.select(*_SHARD, "here", "left", "text", "block").repartition(*_SHARD).sortWithinPartitions(*_SHARD, "here")
    return shards.mapInArrow(_compared(length, k), _MATCH)


def sharing_pairs(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id_a, doc_id_b`` (smaller first): documents that share a span of at least ``length`` code points, each pair once.

    Null and shorter texts share nothing; repeated doc_ids are one document; an empty table gives no rows.
    """
    around = stored(surroundings(documents, length), "surroundings")
    same = around.filter(F.length("text") >= length).select("anchor", "here", "doc").distinct()
    # copies of a long text meet at each of its anchors: of the groups with the same documents one is enough
    group = same.groupBy("anchor", "here").agg(
        F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")
    )
    several = group.filter("a < b").groupBy("a", "b", "n", "x", "y").agg(F.min(F.struct("anchor", "here")).alias("g")).select("g.anchor", "g.here", "n")
    same = same.join(several, ["anchor", "here"])
    alike = _pairs(same)
    matched = stored(shard_matches(around, length), "shard-matches")
    who = stored(around.select("anchor", "here", "doc").distinct(), "shard-documents")
    held = who.groupBy("anchor", "here").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    side = lambda x: held.select("anchor", F.col("here").alias(f"here_{x}"), F.col("blocks").alias(f"blocks_{x}"))
    met = matched.select("anchor", "here_a", "here_b").distinct().join(side("a"), ["anchor", "here_a"]).join(side("b"), ["anchor", "here_b"])
    for x in "ab":
        met = met.withColumn(f"block_{x}", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{x}") - 1)))
    blocked = who.join(held, ["anchor", "here"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    a = blocked.select("anchor", F.col("here").alias("here_a"), F.col("block").alias("block_a"), F.col("doc").alias("p"))
    b = blocked.select("anchor", F.col("here").alias("here_b"), F.col("block").alias("block_b"), F.col("doc").alias("q"))
    differing = met.join(a, ["anchor", "here_a", "block_a"]).join(b, ["anchor", "here_b", "block_b"]).filter("p != q")
    differing = differing.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"))
    return alike.unionByName(differing).distinct()


def _pairs(members: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b`` of all members of a group (``anchor, here, doc, n``), in blocks: no task pairs more than two blocks."""
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    m = members.withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.select("anchor", "here", "doc", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"))
    both = m.alias("x").join(m.alias("y"), ["anchor", "here", "one", "other"]).filter("x.doc < y.doc and (one = other or x.block <> y.block)")
    return both.select(F.col("x.doc").alias("doc_id_a"), F.col("y.doc").alias("doc_id_b"))


def shared_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, begin, end``: for each document the maximal stretches (code points, end exclusive) that stand in other documents, too."""
    around = stored(surroundings(documents, length), "surroundings")
    several = around.filter(F.length("text") >= length).groupBy("anchor", "here").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("anchor", "here")
    whole = around.join(several, ["anchor", "here"], "left_semi").select("doc", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") - F.col("left") + F.length("text")).alias("end"))
    # a surrounding's own other occurrences in the same document do not count: the pair must be of two documents
    matched = stored(shard_matches(around, length), "shard-matches")
    docs = around.groupBy("anchor", "here").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    own = lambda s: docs.select("anchor", F.col("here").alias(f"here_{s}"), F.col("a").alias(f"a_{s}"), F.col("b").alias(f"b_{s}"))
    real = matched.join(own("a"), ["anchor", "here_a"]).join(own("b"), ["anchor", "here_b"])
    sides = real.select("anchor", F.explode(F.array(
        F.struct(F.col("here_a").alias("here"), F.col("from_a").alias("at"), F.col("size").alias("size"), F.col("a_b").alias("lo"), F.col("b_b").alias("hi")),
        F.struct(F.col("here_b").alias("here"), F.col("from_b").alias("at"), F.col("size").alias("size"), F.col("a_a").alias("lo"), F.col("b_a").alias("hi")),
    )).alias("s")).select("anchor", "s.*").groupBy("anchor", "here", "at", "size").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    parts = around.join(sides, ["anchor", "here"]).filter("lo != doc or hi != doc").select("doc", (F.col("pos") - F.col("left") + F.col("at")).alias("begin"), (F.col("pos") - F.col("left") + F.col("at") + F.col("size")).alias("end"))
    every = whole.unionByName(parts).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("s"))
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<begin:int,end:int>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).end >= x.begin, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, x.end)))), concat(acc, array(x))))"
    )
    return every.select(F.col("doc").alias("doc_id"), F.explode(merged).alias("m")).select("doc_id", "m.begin", "m.end")


def shared_share(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_chars, shared_chars, shared_share``: how much of each document stands in others; every document once, 0 for null or empty texts."""
    shared = shared_spans(documents, length).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("shared_chars"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return documents.select("doc_id", n.alias("n_chars")).join(shared, "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"), F.round(F.coalesce(F.col("shared_chars"), F.lit(0)) / F.greatest("n_chars", F.lit(1)), 6).alias("shared_share")
    )
