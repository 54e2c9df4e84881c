"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets whole passes over its records and, for the rest, a fraction. Whether a record is in the fractional pass
is decided by the cube method: inclusion probabilities are moved along the null space of the constraints (token and
document totals of the source) until all but at most two of a block are 0 or 1. Blocks of bounded size fly in parallel;
what they leave over is regrouped and flown again; the last two of each source land on the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored

BLOCK = 2000
MAX_SOURCES = 10_000
_EDGE = 1e-9


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping their sum and their sum weighted by size; at most two stay between."""
    p = p.astype(np.float64).copy()
    rng = np.random.default_rng(seed)
    waiting = [i for i in range(len(p)) if _EDGE < p[i] < 1 - _EDGE]
    hand = waiting[:3]
    at = 3
    while len(hand) == 3:
        a, b, c = (float(size[i]) for i in hand)
        u = np.array([b - c, c - a, a - b])  # orthogonal to (1, 1, 1) and to the sizes
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        x = p[hand]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
            down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
        x = x + u * (up if rng.random() * (up + down) < down else -down)
        p[hand] = x
        hand = [i for i, v in zip(hand, x) if _EDGE < v < 1 - _EDGE]
        while len(hand) < 3 and at < len(waiting):
            hand.append(waiting[at])
            at += 1
    if len(hand) == 2 and size[hand[0]] == size[hand[1]]:  # of equal size, one more can be settled
        i, j = hand
        whole = p[i] + p[j]
        low, high = max(0.0, whole - 1), min(1.0, whole)
        p[i] = high if rng.random() * (high - low) < p[i] - low else low
        p[j] = whole - p[i]
    return np.where(p < _EDGE, 0.0, np.where(p > 1 - _EDGE, 1.0, p))


def plan(totals: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total_tokens: float | None = None) -> dict[str, tuple[int, float]]:
    """For each source (whole passes, fraction of a further one).

    ``totals``: tokens and documents of each source. Shares are taken among the sources that have tokens. Without
    ``total_tokens`` the mixture is as large as the caps on repeats allow with all shares met; with it, sources at their
    cap give their shortfall to the others in proportion to their shares.
    """
    live = [(s, share, cap) for s, share, cap in targets if share > 0 and cap > 0 and totals.get(s, (0, 0))[0] > 0]
    if not live:
        return {}
    whole = sum(share for _, share, _ in live)
    most = {s: cap * totals[s][0] for s, _, cap in live}
    if total_tokens is None:
        size = min(most[s] * whole / share for s, share, _ in live)
        want = {s: size * share / whole for s, share, _ in live}
    else:
        want, free, rest = {}, list(live), float(total_tokens)
        while free:
            among = sum(share for _, share, _ in free)
            full = [x for x in free if rest * x[1] / among >= most[x[0]]]
            if not full:
                want |= {s: rest * share / among for s, share, _ in free}
                break
            for x in full:
                want[x[0]] = float(most[x[0]])
                rest -= most[x[0]]
                free.remove(x)
    out = {}
    for s, _, cap in live:
        ratio = min(want[s] / totals[s][0], float(cap))
        passes = int(ratio + 1e-9)
        out[s] = (passes, max(0.0, ratio - passes) if ratio - passes > 1e-9 else 0.0)
    return out


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, tokens, repeats`` of the chosen records of ``sizes(doc_id, source, tokens)``.

    Records without a source or of a source without a target are left out; target rows must name each source once.
    Sources without records get nothing (see ``shares``). No record is used more than the source's cap.
    """
    spark = sizes.sparkSession
    rows = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = [tuple(r) for r in rows if r[0] is not None]
    sizes = stored(sizes.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).join(F.broadcast(spark.createDataFrame([(w[0],) for w in wanted] or [("",)], "source string")), "source", "left_semi"), "mix-sizes")
    totals = {r.source: (r.t, r.n) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    passes = plan(totals, wanted, total_tokens)
    if not passes:
        return spark.createDataFrame([], "doc_id long, source string, tokens long, repeats int")
    table = spark.createDataFrame([(s, p, f, max(1, -(-totals[s][1] // block))) for s, (p, f) in passes.items()], "source string, passes int, fraction double, blocks int")
    joined = sizes.join(F.broadcast(table), "source")
    schema = "source string, doc_id long, tokens long, passes int, p double"

    def fly(frame):
        import pandas as pd

        # large records first: those left over at the end are small, and so is what their rounding costs
        frame = frame.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        first = int(frame["doc_id"].min()) if len(frame) else 0
        frame["p"] = flight(frame["p"].to_numpy(), frame["tokens"].to_numpy(), (seed * 1_000_003 + first) % (1 << 32))
        return pd.DataFrame(frame[["source", "doc_id", "tokens", "passes", "p"]])

    level = joined.withColumn("p", F.col("fraction")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    flown = stored(level.groupBy("source", "block").applyInPandas(fly, schema), "mix-flight")
    decided = flown.filter("p = 0 or p = 1")
    open_ = flown.filter("p > 0 and p < 1")
    blocks = max(-(-totals[s][1] // block) for s in passes)
    while blocks > 1:
        blocks = -(-2 * blocks // block)
        again = open_.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(blocks)))
        flown = stored(again.groupBy("source", "block").applyInPandas(fly, schema), "mix-flight")
        decided = decided.unionByName(flown.filter("p = 0 or p = 1"))
        open_ = flown.filter("p > 0 and p < 1")
    # landing: at most two records a source; the rounding that keeps token and document totals closest
    last: dict[str, list] = {}
    for r in open_.collect():
        last.setdefault(r.source, []).append(r)
    landed = []
    for s, units in last.items():
        mean = max(totals[s][0] / totals[s][1], 1.0)
        cost = lambda x, units=units, mean=mean: abs(sum((v - u.p) * u.tokens for v, u in zip(x, units))) / mean + abs(sum(v - u.p for v, u in zip(x, units)))
        best = min(itertools.product((0.0, 1.0), repeat=len(units)), key=cost)
        landed += [(s, u.doc_id, u.tokens, u.passes, v) for u, v in zip(units, best)]
    every = decided.unionByName(spark.createDataFrame(landed, schema))
    return every.select("doc_id", "source", "tokens", (F.col("passes") + F.col("p").cast("int")).alias("repeats")).filter("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, documents, tokens, most_repeats, actual_share`` of a mixture, for every target row."""
    by = mixed.groupBy("source").agg(F.sum("repeats").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    whole = by.agg(F.sum("tokens").alias("whole"))
    zero = F.lit(0).cast("long")
    return targets.select("source", "target_share", "max_repeats").join(by, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
    )


def landing(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``source, tokens, wanted_tokens, landing_bound`` of each source in a mixture: what it contributes, what the plan gives it, and by how much
    the cube method may miss that: its flights keep token totals exactly, and the landing rounds at most two records."""
    spark = mixed.sparkSession
    rows = [tuple(r) for r in targets.filter("source is not null").select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(MAX_SOURCES).collect()]
    by = sizes.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("largest"))
    known = {r.source: r for r in by.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()}
    passes = plan({s: (r.t or 0, r.n) for s, r in known.items()}, rows, total_tokens)
    wanted = spark.createDataFrame([(s, (p + f) * known[s].t, 2 * known[s].largest) for s, (p, f) in passes.items()], "source string, wanted_tokens double, landing_bound long")
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    return F.broadcast(wanted).join(got, "source", "left").select("source", F.coalesce("tokens", F.lit(0)).alias("tokens"), "wanted_tokens", "landing_bound")
