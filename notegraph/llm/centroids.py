"""Centroid clustering: Lloyd's rounds over distinct quantised vectors with multiplicities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A vector with over this part of all rows is joined by broadcast: there are at most as many such vectors.
HOT_PART = 200
#: Greatest absolute component: squared distances of 64 components then fit a long.
GREATEST = 1 << 27


def quantised(vector: Column, scale: int, dims: int) -> Column:
    """floor(scale * x) of each component as longs; null where the vector hasn't `dims` components, or one is null, NaN or infinite."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & (F.size(vector) == dims) & fine, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(-1, dims)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, ties to the smaller number; exact in longs."""
    best, at = None, None
    for j, c in enumerate(centroids):
        d = x - c
        d = np.einsum("ij,ij->i", d, d)
        if best is None:
            best, at = d, np.zeros(len(x), np.int64)
        else:
            nearer = d < best
            best[nearer], at[nearer] = d[nearer], j
    return at, best


def _summer(centroids: np.ndarray):
    dims = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for pdf in batches:
            x, n = _matrix(pdf["q"], centroids.shape[1]), pdf["n"].to_numpy()
            at, _ = _nearest(x, centroids)
            np.add.at(total, at, x * n[:, None])
            np.add.at(count, at, n)
        met = np.flatnonzero(count)
        out = {"cluster": met, "n": count[met]} | {f"s{i}": total[met, i] for i in range(dims)}
        yield pd.DataFrame(out)

    return run


def _assigner(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, d = _nearest(_matrix(pdf["q"], centroids.shape[1]), centroids)
            yield pd.DataFrame({"q": pdf["q"], "n": pdf["n"], "cluster": at.astype(np.int32), "distance": d})

    return run


def lloyd(distinct: DataFrame, starts: list[list[int]], rounds: int) -> list[list[int]]:
    """Centroids after so many rounds over (q, n). Tasks sum their vectors by cluster; of each round only the sums of the clusters reach the driver.

    A centroid becomes the componentwise floor of sum over count; one without vectors stays.
    """
    centroids = [list(c) for c in starts]
    for _ in range(rounds):
        dims = len(centroids[0])
        kind = "cluster long, n long, " + ", ".join(f"s{i} long" for i in range(dims))
        sums = distinct.mapInPandas(_summer(np.array(centroids, np.int64)), kind).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dims)])
        for r in sums.collect():  # a row for each centroid
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return centroids


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector, repeated ids too.

    Vectors of another length, null, or with a null or non-finite component take no part. Equal quantised vectors are one row with
    a multiplicity, so a vector that many rows share is summed up before it is shuffled, and assigned once. The k starts are the vectors
    with the least sha256 of `seed:<id>`; ties, rows of one id, by components; a row without id is no start. Fewer vectors give
    fewer clusters, none no rows. Sums and distances are exact: a component of GREATEST or more, or sums that don't fit a long, are an error.
    Vectors with over a HOT_PART-th of the rows get their clusters back by broadcast, at most HOT_PART of them, all others by a join on the vector.
    """
    kept = vectors.select(F.col(id_col).alias("_id"), quantised(F.col(vector_col), scale, dims).alias("q")).where("q is not null")
    rows = cut(kept, "vectors")
    distinct = cut(rows.groupBy("q").agg(F.count("*").alias("n")), "distinct-vectors")
    out = f"{vectors.select(id_col).schema[0].dataType.simpleString()}"
    total, most = distinct.agg(F.sum("n"), F.max(F.greatest(F.array_max("q"), -F.array_min("q")))).first()
    spark = vectors.sparkSession
    if not total:
        return spark.createDataFrame([], f"`{id_col}` {out}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if most >= GREATEST or most * total >= 1 << 63:
        raise ValueError(f"components up to {most} in {total} vectors: sums or distances may not fit a long")
    by_hash = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_id").cast("string")), 256)
    starts = [list(r["q"]) for r in rows.where("_id is not null").orderBy(by_hash, "q").select("q").limit(k).collect()]
    if not starts:
        starts = [list(r["q"]) for r in distinct.orderBy("q").select("q").limit(k).collect()]
    centroids = lloyd(distinct, starts, rounds)
    assigned = cut(distinct.mapInPandas(_assigner(np.array(centroids, np.int64)), "q array<long>, n long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance")).alias("d")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), s) for j, s in enumerate(shas)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    is_hot = F.col("n") * HOT_PART > total
    hot = assigned.where(is_hot).select("q", F.col("cluster").alias("h_cluster"), F.col("distance").alias("h_distance"))
    marked = rows.join(F.broadcast(hot), "q", "left")
    easy = marked.where("h_cluster is not null").select("_id", F.col("h_cluster").alias("cluster"), F.col("h_distance").alias("distance"))
    other = marked.where("h_cluster is null").select("_id", "q").join(assigned.where(~is_hot).select("q", "cluster", "distance"), "q").select("_id", "cluster", "distance")
    joined = easy.unionByName(other).join(F.broadcast(table), "cluster")
    return joined.select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
