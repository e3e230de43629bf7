"""Exact top-k inner products over norm-sorted vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path

#: Queries of a block, vectors of a chunk, longest vectors that give the first bounds, vectors that the rotation is fitted on.
QUERIES, CHUNK, SEEDS, FITTED = 8_192, 2_048, 1_024, 4_096
#: Leading rotated dimensions of the partial sums.
LEADING = 16


def _matrix(vectors, d: int) -> np.ndarray:
    """Rows of 64-bit integers, zeros after the end of shorter ones."""
    lengths = np.array([len(v) for v in vectors], dtype=int)
    out = np.zeros((len(lengths), d), np.int64)
    if len(lengths) and (lengths == d).all():
        out[:] = np.stack([np.asarray(v, dtype=np.int64) for v in vectors])
    else:
        for i, v in enumerate(vectors):
            out[i, : lengths[i]] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: in doubles where no sum can reach 2^53, else in integers of any size; ValueError beyond 64 bits."""
    largest = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (q, x)]
    if largest[0] * largest[1] * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if largest[0] * largest[1] * q.shape[1] < 2.0**62:
        return q @ x.T
    out = q.astype(object) @ x.astype(object).T
    if out.size and (out.max() >= 1 << 63 or out.min() < -(1 << 63)):
        raise ValueError("a score doesn't fit 64 bits")
    return out.astype(np.int64)


def rotation(sample: np.ndarray, d: int) -> np.ndarray:
    """An orthogonal matrix whose first columns hold most of the sample's length. Any sample gives exact results."""
    return np.linalg.svd(sample.astype(np.float64), full_matrices=True)[2].T if len(sample) else np.eye(d)


#: Below any score.
_LEAST = -(1 << 63)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, qid: np.ndarray, k: int):
        self.qid, self.k = qid, k
        self.q, self.score, self.id = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bound = np.full(len(qid), _LEAST)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, q))  # ~: no overflow at the least score
        q, score, ids = q[order], score[order], ids[order]
        heads = np.searchsorted(q, q)  # each query's first place
        rank = np.arange(len(q)) - heads
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        last = rank == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], score[last])


def _search(block: dict, k: int, d: int):
    """A function over chunks of norm-sorted candidates that keeps what can be among a query's k best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = block.value
        q, qid, turn = b["q"], b["id"], b["turn"]
        qr = q @ turn
        length, tail = np.linalg.norm(q.astype(np.float64), axis=1), np.linalg.norm(qr[:, LEADING:], axis=1)
        best = Best(qid, k)
        best.bound = b["bound"].copy()

        def can_gain(longest: float) -> np.ndarray:
            """Places of the queries that vectors of this length or less can still gain; Cauchy-Schwarz on whole vectors."""
            return np.flatnonzero(length * longest + 1e-6 * (1 + length * longest) >= best.bound)

        def chunk(ids: np.ndarray, x: np.ndarray) -> None:
            longest = np.linalg.norm(x.astype(np.float64), axis=1).max()
            slack = 1e-6 * (1 + length * longest)
            live = can_gain(longest)
            if not len(live):
                return
            xr = x @ turn
            rest = np.linalg.norm(xr[:, LEADING:], axis=1)
            upper = qr[live, :LEADING] @ xr[:, :LEADING].T + tail[live, None] * rest[None, :]  # and on the residuals
            may = upper + slack[live, None] >= best.bound[live, None]
            rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            if len(rows) and len(cols):
                exact = products(q[live[rows]], x[cols])
                hit = (exact >= best.bound[live[rows], None]) & (ids[cols][None, :] != qid[live[rows], None])
                if hit.sum() > 50 * k * len(rows):  # no useful bounds yet: the k-th of this chunk is one
                    masked = np.where(hit, exact, _LEAST)
                    kth = np.partition(masked, max(0, len(cols) - k), axis=1)[:, max(0, len(cols) - k)]
                    hit &= exact >= kth[:, None]
                i, j = np.nonzero(hit)
                best.add(live[rows][i], exact[i, j], ids[cols[j]])

        # A task may read several files, whose lengths don't follow on from one another: what can't gain is skipped, and the rest goes on.
        held, n = [], 0
        for pdf in batches:
            if len(pdf) and len(can_gain(pdf["norm"].max())):
                held.append(pdf)
                n += len(pdf)
            if n >= CHUNK:
                full = pd.concat(held)
                chunk(full["id"].to_numpy(), _matrix(full["v"], d))
                held, n = [], 0
        if n:
            full = pd.concat(held)
            chunk(full["id"].to_numpy(), _matrix(full["v"], d))
        yield pd.DataFrame({"query_id": qid[best.q], "vec_id": best.id, "score": best.score})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with all other ids, ties to smaller ids.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and null ids, take
    no part. Shorter vectors count as ending in zeros. Of several vectors with one id the least asks; all are candidates.
    Scores are exact for components of any size; a component or score that doesn't fit a long is an error. No queries: no rows.

    Candidates are dealt by descending length (then id, so equal ones don't meet in one task). A query block of bounded size is
    broadcast with the k-th best score among the longest vectors; each task then goes down its lengths, skips batches whose
    lengths can't reach, and drops vectors whose partial sum over the leading rotated dimensions, plus the product of the
    residual lengths, stays below the bound. What is left gets its exact score. Blocks follow one another; what a block finds is written, and
    its broadcast dropped, before the next one, so the driver holds one block at a time whatever the number of queries.
    """
    spark = vectors.sparkSession
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fit = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(~bad)
    scaled = lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**63, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component doesn't fit a long")).cast("long"))
    v = fit.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, scaled).alias("v"))
    v = v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    v = cut(v.repartitionByRange(F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm")), "vectors")
    queries = cut(v.join(fit.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, d = queries.count(), v.agg(F.max(F.size("v"))).first()[0] or 0
    shape = "query_id long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = v.orderBy(F.xxhash64("id"), "id").limit(FITTED).select("v").toArrow()
    turn = rotation(_matrix(sample["v"].to_numpy(), d), d)
    seeds = v.orderBy(F.desc("norm"), "id").limit(SEEDS).select("id", "v").toArrow()
    seed_id, seed = seeds["id"].to_numpy(), _matrix(seeds["v"].to_numpy(), d)
    blocks, path = -(-n // QUERIES), new_path(spark, "found")
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()
        qid, q = part["id"].to_numpy(), _matrix(part["v"].to_numpy(), d)
        bound = np.full(len(qid), _LEAST)
        if len(seed) > k and len(qid):
            s = np.where(seed_id[None, :] == qid[:, None], _LEAST, products(q, seed))
            bound = np.partition(s, len(seed) - k, axis=1)[:, len(seed) - k]
        block = spark.sparkContext.broadcast({"id": qid, "q": q, "turn": turn, "bound": bound})
        v.select("id", "norm", "v").mapInPandas(_search(block, k, d), shape).write.mode("append").parquet(path)
        block.destroy()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(shape).parquet(path)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
