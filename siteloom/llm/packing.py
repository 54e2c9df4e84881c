"""Filling containers of a fixed capacity: shortest-pack-first over the histogram of item lengths.

Only the histogram (at most ``capacity`` + 1 rows) comes to the driver and goes to the executors. Lengths are placed longest first; equal packs are
one pattern with a count, so the work depends on the capacity, not on the number of items. Items find their container
by their rank among the items of their length, which is computed in parallel.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stored

#: Items of one length that a task ranks; a length with more is salted.
RANKED = 200_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (how many packs, [(length, items of that length in each), ...]).

    Each length, longest first, goes to the packs with the most space left (the shortest) as long as it fits, one item a
    pack at a time; what is left opens new packs.
    """
    done: list[tuple[int, list[tuple[int, int]]]] = []
    open_: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (-space, order, packs, items)
    order = 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left and open_ and -open_[0][0] >= length:
            minus, _, packs, items = heapq.heappop(open_)
            use = min(packs, left)
            if use < packs:
                order += 1
                heapq.heappush(open_, (minus, order, packs - use, items))
            more = [*items[:-1], (length, items[-1][1] + 1)] if items[-1][0] == length else [*items, (length, 1)]
            order += 1
            heapq.heappush(open_, (minus + length, order, use, more))
            left -= use
        if left:
            each = capacity // length
            whole, rest = divmod(left, each)
            for packs, n in ((whole, each), (1, rest)):
                if packs and n:
                    order += 1
                    heapq.heappush(open_, (n * length - capacity, order, packs, [(length, n)]))
    done.extend((packs, items) for _, _, packs, items in sorted(open_))
    return done


def slots(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[int, np.ndarray]:
    """For each length the ranges of ranks: columns first rank, items in each pack, first container, unused space."""
    out, base, seen = defaultdict(list), 0, defaultdict(int)
    for packs, items in patterns:
        free = capacity - sum(length * n for length, n in items)
        for length, n in items:
            out[length].append((seen[length], n, base, free))
            seen[length] += packs * n
        base += packs
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(sizes: DataFrame, capacity: int, ranked_rows: int = RANKED) -> DataFrame:
    """``doc_id, piece, tokens, container, unused`` for ``sizes(doc_id, tokens)``.

    An item larger than the capacity is split into full pieces and a rest; others are whole (piece 0). Empty items take
    no room: they go to container 0. ``unused``: space left in the container. Null sizes count as 0; repeated rows are
    items of their own; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("a container must hold at least one token")
    spark = sizes.sparkSession
    n = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0)).cast("int")
    items = sizes.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "piece", F.least(F.col("n") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("long").alias("tokens")
    )
    items = stored(items, "pack-items")
    histogram = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    # salts grow with the items of a length; the table has at most capacity + 1 rows
    salts = spark.createDataFrame([(t, -(-m // ranked_rows)) for t, m in histogram.items()], "tokens long, salts long")
    items = items.join(F.broadcast(salts), "tokens").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")))
    counts = items.groupBy("tokens", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tokens", "salt", before.alias("before"))
    found = spark.sparkContext.broadcast(slots(pack_histogram(histogram, capacity), capacity))
    ranked = items.join(offsets, ["tokens", "salt"]).select(
        "doc_id", "piece", "tokens", (F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1 + F.col("before")).alias("rank")
    )

    def run(frames):
        for b in frames:
            tokens, rank = b.column("tokens").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            container, unused = np.zeros(len(tokens), np.int64), np.full(len(tokens), -1, np.int64)
            for t in np.unique(tokens):
                s = found.value.get(int(t))
                if s is None:
                    continue
                at = np.flatnonzero(tokens == t)
                i = np.searchsorted(s[:, 0], rank[at], side="right") - 1
                container[at] = s[i, 2] + (rank[at] - s[i, 0]) // s[i, 1]
                unused[at] = s[i, 3]
            if (unused < 0).any():
                first = next((v for v in found.value.values() for r in v if r[2] == 0), None)
                free = capacity if first is None else int(next(r[3] for v in found.value.values() for r in v if r[2] == 0))
                unused[unused < 0] = free
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("tokens"), pa.array(container), pa.array(unused)], names=["doc_id", "piece", "tokens", "container", "unused"])

    return ranked.mapInArrow(run, "doc_id long, piece int, tokens long, container long, unused long")


def pack_kinds(sizes: DataFrame, kinds: DataFrame) -> DataFrame:
    """``pack`` for every row of ``kinds(container_kind, capacity_tokens)``, a small fixed table: all items in each kind of container."""
    out = None
    for r in kinds.select("container_kind", "capacity_tokens").orderBy("capacity_tokens").collect():
        one = pack(sizes, r.capacity_tokens).select(F.lit(r.container_kind).alias("container_kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out
