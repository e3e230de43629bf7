"""A two-dimensional map that keeps neighbours: a graph of nearest neighbours, then attraction along its links and sampled repulsion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Tables
from . import vectors as V

#: Shape of the curve 1 / (1 + A d^(2B)) of a link's likelihood by distance, that of a least distance of 0.5.
A, B = 0.583, 1.334
#: Nodes that repel each other in an epoch: those of a random block of about this size.
CROWD = 256


def knn(index: DataFrame, k: int = 15) -> DataFrame:
    """(name, other, sim, rank): each name's k most similar others, exact, ties by name. Each pair of blocks gives k rows a name at most."""
    kind = index.schema["name"].dataType.simpleString()

    def best(a, b, tiles):
        near = {0: _Nearest(len(a), k), 1: _Nearest(len(b), k)}
        whole = len(a) == len(b) and (a == b).all()
        for i, j, sim, keep in tiles:
            if keep is not None:
                sim[~keep] = -np.inf
            near[0].add(i, j, sim)
            if not whole:
                near[1].add(j, i, sim.T)
        for own, other, of in ((a, b, near[0]), (b, a, near[1])):
            at = np.nonzero(np.isfinite(of.sims))
            yield pd.DataFrame({"name": own[at[0]], "other": other[of.others[at]], "sim": of.sims[at]})

    found = V._each_block(index, None, best, f"name {kind}, other {kind}, sim double", whole=True).drop("g")
    each = found.groupBy("name").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("d"), "other"))), 1, k).alias("near"))
    return each.select("name", F.posexplode("near").alias("rank", "n")).select("name", "n.other", (-F.col("n.d")).alias("sim"), (F.col("rank") + 1).alias("rank"))


class _Nearest:
    """The k most similar others of each of n rows so far, similarities to 12 digits, equal ones in order."""

    def __init__(self, n: int, k: int):
        self.k, self.sims, self.others = k, np.full((n, k), -np.inf), np.zeros((n, k), dtype=np.int64)

    def add(self, i: int, j: int, sim: np.ndarray) -> None:
        """Rows from i on by columns from j on. Only values that may be among the k best are sorted."""
        m, c = sim.shape
        least = self.sims[i : i + m, -1]
        if np.isneginf(least).any() and c > self.k:
            sim[np.isnan(sim)] = -np.inf  # no neighbour
            least = np.maximum(least, np.partition(sim, c - self.k, axis=1)[:, c - self.k])
        row, col = np.nonzero((sim >= (least - 1e-11)[:, None]) & (sim > -np.inf))
        if not len(row):
            return
        rows = np.unique(row)
        held = self.sims[i + rows]
        row_all = np.concatenate([row, np.repeat(rows, self.k)])
        sims = np.concatenate([np.round(sim[row, col], 12), held.ravel()])
        others = np.concatenate([col + j, self.others[i + rows].ravel()])
        order = np.lexsort((others, -sims, row_all))
        row_all = row_all[order]
        place = np.arange(len(order)) - np.searchsorted(row_all, row_all)
        top = place < self.k
        self.sims[i + row_all[top], place[top]] = sims[order][top]
        self.others[i + row_all[top], place[top]] = others[order][top]


def weighted(near: DataFrame) -> DataFrame:
    """(a, b, w), both directions of each link: how likely two are neighbours in either's view, by the distance beyond the nearest one over a width
    that gives each name about log2(k) neighbours."""
    kind = near.schema["name"].dataType.simpleString()

    def widths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, others, sims in zip(pdf["name"], pdf["others"], pdf["sims"]):
                d = np.maximum(0.0, 1 - np.asarray(sims))
                beyond = np.maximum(0.0, d - d.min())
                low, high, goal = 1e-9, 10.0, math.log2(max(len(d), 2))
                for _ in range(50):
                    mid = (low + high) / 2
                    low, high = (low, mid) if np.exp(-beyond / mid).sum() > goal else (mid, high)
                out += zip([name] * len(d), others, np.exp(-beyond / high))
            yield pd.DataFrame(out, columns=["a", "b", "w"])

    rows = near.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "sim"))).alias("n")).select("name", F.col("n.other").alias("others"), F.col("n.sim").alias("sims"))
    one = rows.mapInPandas(widths, f"a {kind}, b {kind}, w double")
    both = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg((1 - F.product(1 - F.col("w"))).alias("w"))
    return both.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))


def _repelled(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Each node's mean push by the others of its block."""
    pdf = pdf.sort_values("name")
    p = pdf[["x", "y"]].to_numpy()
    d = p[:, None, :] - p[None, :, :]
    sq = (d**2).sum(2)
    f = 2 * B / ((0.001 + sq) * (1 + A * sq**B))
    push = np.clip(f[:, :, None] * d, -4, 4)
    push = push.sum(1) / max(1, len(p) - 1)
    return pd.DataFrame({"name": pdf["name"].to_numpy(), "x": pdf["x"].to_numpy(), "y": pdf["y"].to_numpy(), "px": push[:, 0], "py": push[:, 1]})


def neighbour_map(index: DataFrame, k: int = 15, epochs: int = 24, rate: float = 1.0, negatives: float = 5.0, near: DataFrame | None = None) -> DataFrame:
    """(name, x, y): positions by epochs of joins, from the principal components on. The same rows give the same map, but for the order of sums.

    In an epoch each node is drawn along its links, weighed by their likelihood, and pushed by the nodes of a block that hashes of name and epoch make
    anew. Links meet positions by a join; blocks have about CROWD nodes; nothing but the number of rows reaches the driver.
    Vectors need one dimension; a null vector is an error of the components. Up to two names keep their components. near: knn(index, k), where it is known.
    """
    n = index.count()
    tables = Tables(index.sparkSession)
    at = V.projection_2d(index)
    size = at.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")).select(F.greatest("x", "y", F.lit(1e-9)).alias("size"))
    jitter = lambda i: (F.pmod(F.xxhash64("name", F.lit(i)), F.lit(1000)) / 1000 - 0.5) * 0.01
    at = tables.write(at.join(F.broadcast(size)).select("name", (F.col("x") / F.col("size") * 10 + jitter(0)).alias("x"), (F.col("y") / F.col("size") * 10 + jitter(1)).alias("y")))
    if n < 3:
        return at
    links = tables.write(weighted(knn(index, min(k, n - 1)) if near is None else near))
    kind = index.schema["name"].dataType.simpleString()
    blocks = max(1, round(n / CROWD))
    for t in range(epochs):
        step = rate * (1 - t / epochs)
        own, other = at.select(F.col("name").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), at.select(F.col("name").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        drawn = links.join(other, "b").join(own, "a")
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        sq = dx * dx + dy * dy
        f = F.when(sq > 0, -2 * A * B * F.pow(sq, F.lit(B - 1)) / (1 + A * F.pow(sq, F.lit(B)))).otherwise(0.0) * F.col("w")
        clip = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
        pull = drawn.groupBy("a").agg(F.sum(clip(f * dx)).alias("fx"), F.sum(clip(f * dy)).alias("fy"), F.sum("w").alias("ws")).withColumnRenamed("a", "name")
        pushed = at.groupBy(F.pmod(F.xxhash64("name", F.lit(t)), F.lit(blocks)).alias("block")).applyInPandas(_repelled, f"name {kind}, x double, y double, px double, py double")
        moved = pushed.join(pull, "name", "left")
        ws = F.coalesce("ws", F.lit(0.0))
        go = lambda p, f, g: (F.col(p) + step * (F.coalesce(f, F.lit(0.0)) / F.greatest(ws, F.lit(1.0)) + negatives * F.col(g))).alias(p)
        at, old = tables.write(moved.select("name", go("x", "fx", "px"), go("y", "fy", "py"))), at
        tables.drop(old)
    tables.drop(links)
    return at


def kept_neighbours(index: DataFrame, points: DataFrame, k: int = 10, near: DataFrame | None = None) -> DataFrame:
    """One row, kept: the mean share of each name's k nearest by cosine that are among its k nearest on the map. near: knn(index, k or more), where it is known."""
    near = (knn(index, k) if near is None else near.where(F.col("rank") <= k)).select("name", "other")
    kind = index.schema["name"].dataType.simpleString()
    # The nearest by distance on a plane are those with the highest cosine after a lift to the sphere over it, if that is large.
    far = points.agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.lit(1e-9))).alias("far"))
    u, v = F.col("x") / F.col("far") / 1000, F.col("y") / F.col("far") / 1000
    s = u * u + v * v
    lifted = points.join(F.broadcast(far)).select("name", F.array(2 * u / (1 + s), 2 * v / (1 + s), (1 - s) / (1 + s)).alias("vec"))
    on_map = knn(lifted, k).select("name", "other")
    both = near.join(on_map, ["name", "other"]).groupBy("name").agg(F.count("*").alias("n"))
    return index.select(F.col("name").cast(kind)).join(both, "name", "left").agg((F.avg(F.coalesce("n", F.lit(0))) / k).alias("kept"))
