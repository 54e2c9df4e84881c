"""Link-graph operators: PageRank per site, breadth-first depth, aggregated undirected edges."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..plans.lineage import stored

#: Graphs of up to so many edges are ranked in one task each; larger ones in a distributed loop.
LOCAL_EDGES = 2_000_000


def _rank(n: int, src: np.ndarray, dst: np.ndarray, rounds: int, damping: float) -> np.ndarray:
    out = np.bincount(src, minlength=n).astype(float)
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        flow = np.bincount(dst, weights=rank[src] / out[src], minlength=n) if len(src) else np.zeros(n)
        rank = (1 - damping) / n + damping * (flow + rank[out == 0].sum() / n)
    return rank


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = dims.PAGERANK_ROUNDS, damping: float = dims.DAMPING, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``site, node, rank``: power iteration within each site, dangling mass spread evenly; ranks of a site sum to 1.

    ``nodes(site, node)``; ``edges(site, src, dst)``: repeats and self-edges are dropped, edges to unknown nodes ignored.
    A site with more than ``local_edges`` edges is ranked by a distributed loop, others in one task each.
    """
    nodes = nodes.select("site", "node").distinct()
    e = edges.filter("src <> dst").select("site", "src", "dst").distinct()
    e = e.join(nodes.select("site", F.col("node").alias("src")), ["site", "src"], "left_semi").join(nodes.select("site", F.col("node").alias("dst")), ["site", "dst"], "left_semi")
    both = stored(nodes.select("site", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(e.select("site", "src", "dst")), "rank-graph")
    sizes = both.groupBy("site").agg(F.count("*").alias("n"))
    large = stored(sizes.filter(F.col("n") > local_edges).select("site"), "rank-large")

    def run(frame):
        import pandas as pd

        names = frame.loc[frame["dst"].isna(), "src"].sort_values(kind="stable").to_numpy()
        e = frame[frame["dst"].notna()].sort_values(["src", "dst"], kind="stable")
        rank = _rank(len(names), np.searchsorted(names, e["src"].to_numpy()), np.searchsorted(names, e["dst"].to_numpy()), rounds, damping)
        return pd.DataFrame({"site": frame["site"].iloc[0], "node": names, "rank": rank})

    small = both.join(F.broadcast(large), "site", "left_anti").groupBy("site").applyInPandas(run, "site string, node string, rank double")
    if large.isEmpty():
        return small
    return small.unionByName(_loop(both.join(F.broadcast(large), "site", "left_semi"), rounds, damping))


def _loop(both: DataFrame, rounds: int, damping: float) -> DataFrame:
    nodes = both.filter("dst is null").select("site", F.col("src").alias("node"))
    e = both.filter("dst is not null")
    out = e.groupBy("site", "src").agg(F.count("*").alias("out"))
    e = stored(e.join(out, ["site", "src"]).select("site", "src", "dst", (F.lit(1.0) / F.col("out")).alias("w")), "rank-edges")
    count = nodes.groupBy("site").agg(F.count("*").alias("n"))
    base = stored(nodes.join(F.broadcast(count), "site").join(out.withColumnRenamed("src", "node"), ["site", "node"], "left").select("site", "node", "n", F.col("out").isNull().alias("dangling")), "rank-nodes")
    rank = base.select("site", "node", (F.lit(1.0) / F.col("n")).alias("rank"))
    for i in range(rounds):
        flow = e.join(rank.withColumnRenamed("node", "src"), ["site", "src"]).groupBy("site", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("flow"))
        lost = base.filter("dangling").join(rank, ["site", "node"]).groupBy("site").agg(F.sum("rank").alias("lost"))
        rank = base.join(flow, ["site", "node"], "left").join(F.broadcast(lost), "site", "left").select(
            "site", "node", ((1 - damping) / F.col("n") + damping * (F.coalesce("flow", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n"))).alias("rank")
        )
        if i % 5 == 4 or i == rounds - 1:
            rank = stored(rank, "rank-round")
    return rank


def bfs_depth(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node, depth``: least number of steps from a start node. One join per level; ends when a level brings nothing new,
    or, with ``most``, raises where a graph goes on behind that level."""
    e = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "bfs-edges")
    front = stored(starts.select("node").distinct().withColumn("depth", F.lit(0)), "bfs-0")
    seen = front
    for depth in itertools.count(1):
        new = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = stored(new.withColumn("depth", F.lit(depth)), f"bfs-{depth}")
        if front.isEmpty():
            return seen
        if most is not None and depth > most:
            raise ValueError(f"there are nodes deeper than {most} steps")
        seen = seen.unionByName(front)
        if depth % 10 == 0:
            seen = stored(seen, "bfs-seen")


def undirected_weights(edges: DataFrame) -> DataFrame:
    """``a, b, weight`` (a < b) from directed edges; loops are left out."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))
