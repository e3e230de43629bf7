"""Similarity over embeddings: cosine, top-k, all pairs, cohesion, drift, and the incremental index.

Inputs have (name, vec). All-pairs results are quadratic by definition; vectors meet in square blocks, each pair of
blocks in one task's numpy product, and rows leave it only for pairs that pass the floor, or for counts and maxima.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block at least, blocks of a side unless a block would have more than WIDE vectors, and vectors of a side of a tile, whose products are held at once.
BLOCK, SIDE, WIDE, TILE = 512, 16, 65_536, 512


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 if a length is 0; an error if dimensions differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    safe = F.when(norm(a) * norm(b) == 0, F.lit(0.0)).otherwise(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)))
    return F.when(F.size(a) == F.size(b), safe).otherwise(F.raise_error("vectors differ in dimension").cast("double"))


def loose_cosine(a: Column, b: Column) -> Column:
    """As cosine, but vectors of unlike dimensions are multiplied as far as the shorter one goes."""
    k = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, F.lit(1), k), F.slice(b, F.lit(1), k), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def top_k(index: DataFrame, query: list[float], k: int = 10, exclude: str | int | None = None) -> DataFrame:
    """(name, sim): the k nearest to one vector, ties by name. The query is a literal, so nothing is shuffled but k rows a task."""
    df = index if exclude is None else index.where(F.col("name") != F.lit(exclude))
    return df.select("name", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query])).alias("sim")).orderBy(F.desc("sim"), "name").limit(k)


def filtered(ranked: DataFrame, catalog: DataFrame, k: int, summaries: DataFrame | None = None) -> DataFrame:
    """ranked results that are current content pages, with path and summary, the best k: filtered first, so k are found if there are k."""
    out = ranked.join(catalog.where("folder not in ('', 'meta')"), "name")
    out = out.join(summaries, "name", "left") if summaries is not None else out
    return out.orderBy(F.desc("sim"), "name").limit(k)


def _spots(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] = u and b[j] = v of a pair (u, v). a and b are in order and may repeat."""
    i, j = np.searchsorted(a, u), np.searchsorted(b, v)
    n, m = np.searchsorted(a, u, side="right") - i, np.searchsorted(b, v, side="right") - j
    each = np.repeat(np.arange(len(u)), n * m)
    k = np.arange(len(each)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    return i[each] + k // np.maximum(m[each], 1), j[each] + k % np.maximum(m[each], 1)


def _each_block(index: DataFrame, group: str | None, emit: Callable, fields: str, whole: bool = False, without: DataFrame | None = None) -> DataFrame:
    """Rows (fields, g) that emit(a, b, tiles) yields for each pair of blocks: names a and b in order, and tiles (i, j, sim, keep) of their products from
    row i and column j on, of which keep tells the pairs of two vectors that count here (all, if it is none). A block that meets itself has
    the pairs in order only, or with `whole` all pairs of two. Each vector goes to the block pairs that hold its block, once; a side has SIDE blocks, so that
    what is shuffled grows with the vectors, and more only where a block would pass WIDE. A null vector takes no part; unlike dimensions are an error.
    without: pairs (a, b), a < b, that don't count; without a group only. Each goes to the one pair of blocks that has it, so pairs of vectors needn't be joined to them."""
    g = F.col(group) if group else F.lit(0)
    rows = index.where("vec is not null").select("name", "vec", g.alias("g"))
    blocks = lambda n: F.greatest(F.least(F.ceil(n / BLOCK), F.lit(SIDE)), F.ceil(n / WIDE), F.lit(1)).cast("int")
    if group is None:
        n = rows.count()
        side = max(min(math.ceil(n / BLOCK), SIDE), math.ceil(n / WIDE), 1)
        rows = rows.withColumn("b", F.pmod(F.xxhash64("name"), F.lit(side)).cast("int")).withColumn("nb", F.lit(side))
    else:
        sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
        rows = rows.join(sizes, "g").withColumn("nb", blocks(F.col("n"))).withColumn("b", F.pmod(F.xxhash64("name"), F.col("nb")).cast("int"))
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("g", "name", "vec", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    fewer = without is not None  # a task can't hold the frame itself
    if fewer:
        kind = rows.schema["name"].dataType
        at = without.select(*[F.col(c).try_cast(kind).alias(c) for c in ("a", "b")]).dropna().select("a", "b", *[F.pmod(F.xxhash64(c), F.lit(side)).cast("int").alias(f"_{c}") for c in ("a", "b")])
        pairs_ = at.select(F.lit(0).alias("g"), F.col("a").alias("name"), F.lit(None).cast(rows.schema["vec"].dataType).alias("vec"), F.lit(-1).alias("b"), F.least("_a", "_b").alias("p"), F.greatest("_a", "_b").alias("q"), F.col("b").alias("other"))
        dealt = dealt.withColumn("other", F.col("name")).unionByName(pairs_)
    if group is None:
        dealt = dealt.repartition(side * (side + 1) // 2, "g", "p", "q")  # few bytes and much work: not to be coalesced

    def block(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("name")
        if fewer:
            no = pdf[pdf["b"] < 0]
            pdf = pdf[pdf["b"] >= 0]
        if pdf["vec"].map(len).nunique() > 1:
            raise ValueError("vectors differ in dimension")
        left, right = pdf[pdf["b"] == key[1]], pdf[pdf["b"] == key[2]]
        x, y = (_unit(np.array([np.asarray(v, dtype=np.float64) for v in s["vec"]])) for s in (left, right))
        a, b, same = left["name"].to_numpy(), right["name"].to_numpy(), key[1] == key[2]

        nowhere = None
        if fewer and len(no) and len(a) and len(b):
            u, v = no["name"].to_numpy(), no["other"].to_numpy()
            i, j = _spots(a, b, u, v) if same else map(np.concatenate, zip(_spots(a, b, u, v), _spots(a, b, v, u)))
            of = i // TILE * (len(b) // TILE + 1) + j // TILE
            order = np.argsort(of, kind="stable")
            nowhere = i[order], j[order], of[order]

        def tiles() -> Iterator[tuple]:
            for i, j, sim, keep in products():
                if nowhere is not None:
                    of = i // TILE * (len(b) // TILE + 1) + j // TILE
                    start, end = np.searchsorted(nowhere[2], [of, of + 1])
                    if start < end:
                        keep = np.ones(sim.shape, bool) if keep is None else keep
                        keep[nowhere[0][start:end] - i, nowhere[1][start:end] - j] = False
                yield i, j, sim, keep

        def products() -> Iterator[tuple]:
            for i in range(0, len(x), TILE):
                for j in range(i if same and not whole else 0, len(y), TILE):
                    sim = x[i : i + TILE] @ y[j : j + TILE].T
                    u, v = a[i : i + TILE, None], b[None, j : j + TILE]
                    yield i, j, sim, None if not same or i != j else u != v if whole else u < v

        for out in emit(a, b, tiles() if len(x) and len(y) else ()):
            out["g"] = key[0]
            yield out

    kind = rows.schema["g"].dataType.simpleString()
    return dealt.groupBy("g", "p", "q").applyInPandas(block, f"{fields}, g {kind}")


def _named(a: np.ndarray, b: np.ndarray, sim: np.ndarray, at: tuple) -> pd.DataFrame:
    u, v = a[at[0]], b[at[1]]
    swap = u > v
    return pd.DataFrame({"a": np.where(swap, v, u), "b": np.where(swap, u, v), "sim": sim[at]})


def pairs(index: DataFrame, floor: float | None = None, group: str | None = None, without: DataFrame | None = None) -> DataFrame:
    """(a, b, sim[, group]) for names a < b with sim > floor (all without one), within equal groups if one is named, or else without some pairs (a, b)."""
    kind = index.schema["name"].dataType.simpleString()

    def above(a, b, tiles):
        for i, j, sim, keep in tiles:
            some = np.ones(sim.shape, bool) if keep is None else keep
            yield _named(a[i : i + TILE], b[j : j + TILE], sim, np.nonzero(some if floor is None else some & (sim > floor)))

    out = _each_block(index, group, above, f"a {kind}, b {kind}, sim double", without=without)
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def closest(index: DataFrame) -> DataFrame:
    """(a, b, sim): the tightest pair, similarities equal to 12 digits by name; a row leaves each pair of blocks."""
    kind = index.schema["name"].dataType.simpleString()

    def best(a, b, tiles):
        found = []
        for i, j, sim, keep in tiles:
            most = sim.max(initial=-2.0, where=True if keep is None else keep)
            at = np.nonzero(sim >= most - 1e-12 if keep is None else keep & (sim >= most - 1e-12))
            if len(at[0]):
                found.append(_named(a[i : i + TILE], b[j : j + TILE], sim, at).round({"sim": 12}).sort_values(["sim", "a", "b"], ascending=[False, True, True]).head(1))
        if found:
            yield pd.concat(found).sort_values(["sim", "a", "b"], ascending=[False, True, True]).head(1)

    return tightest(_each_block(index, None, best, f"a {kind}, b {kind}, sim double").drop("g"))


def nearest(index: DataFrame) -> DataFrame:
    """(name, nearest): each name's highest similarity to another, 0 at least; a row for each name leaves each pair of blocks."""
    kind = index.schema["name"].dataType.simpleString()

    def maxima(a, b, tiles):
        of_a, of_b = np.full(len(a), -2.0), np.full(len(b), -2.0)
        for i, j, sim, keep in tiles:
            where = True if keep is None else keep
            for of, at, axis in ((of_a, i, 1), (of_b, j, 0)):
                of[at : at + TILE] = np.maximum(of[at : at + TILE], sim.max(axis=axis, initial=-2.0, where=where))
        both = pd.DataFrame({"name": np.concatenate([a, b]), "nearest": np.concatenate([of_a, of_b])})
        yield both[both["nearest"] > -2.0]

    found = _each_block(index, None, maxima, f"name {kind}, nearest double")
    return found.groupBy("name").agg(F.greatest(F.max("nearest"), F.lit(0.0)).alias("nearest"))


#: Equal bins of the first pass, bins of a later pass, and values of a bin that are gathered.
FIRST, BINS, GATHERED = 65_536, 4_096, 10_000


def _first_bin(sim: np.ndarray) -> np.ndarray:
    """Bins 0 to FIRST - 1 in order of similarity; what isn't a number comes last."""
    at = sim + 1.0
    at *= FIRST / 2
    at = np.fmin(at, FIRST - 1, out=at).astype(np.int64)
    return np.maximum(at, 0, out=at)


def pair_ranks(index: DataFrame, points: list[float]) -> tuple[int, list[float], float, float]:
    """(pairs, exact percentiles at points, min, max) over all pairs' similarities; zeros without pairs.

    Blocks count their values by equal bins, without sorting them. Only values in bins that a wanted rank falls into are looked at again: such a bin is
    split until it holds one value or few. What reaches the driver is bounded by bins and GATHERED values for each rank, whatever the number of pairs.
    """

    def spread(a, b, tiles):
        n, low, high = np.zeros(FIRST, np.int64), np.inf, -np.inf
        for _, _, sim, keep in tiles:
            s = sim.ravel() if keep is None else sim[keep]
            if len(s):
                n += np.bincount(_first_bin(s), minlength=FIRST)
                low, high = np.fmin(low, np.fmin.reduce(s)), np.fmax(high, np.fmax.reduce(s))
        at = np.nonzero(n)[0]
        yield pd.DataFrame({"bin": at, "n": n[at], "lo": low, "hi": high})

    fields = "bin long, n long, lo double, hi double"
    h = _each_block(index, None, spread, fields).groupBy("bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("bin").toPandas()
    if not len(h):
        return 0, [0.0] * len(points), 0.0, 0.0
    least, most, ends = float(h["lo"].min()), float(h["hi"].max()), h["n"].cumsum().to_numpy()
    total = int(ends[-1])
    spots = [(total - 1) * p for p in points]
    ranks = sorted({r for k in spots for r in (int(k), min(int(k) + 1, total - 1))})
    at = np.unique(np.searchsorted(ends, ranks, side="right"))
    looked = np.zeros(FIRST, bool)  # bins whose values are looked at again
    looked[h["bin"].to_numpy()[at]] = True
    below = np.concatenate([[0], ends])[at]  # values before each of them
    first, sizes = h["bin"].to_numpy()[at], h["n"].to_numpy()[at]
    edges = np.unique(np.concatenate([np.linspace(k * 2 / FIRST - 1, (k + 1) * 2 / FIRST - 1, BINS + 1 if m > GATHERED else 2) for k, m in zip(first, sizes)]))

    def again(tiles):
        for _, _, sim, keep in tiles:
            s = sim.ravel() if keep is None else sim[keep]
            k = _first_bin(s)
            some = looked[k]
            if some.any():
                yield k[some], s[some]

    fields = "first long, bin long, n long, lo double, hi double"
    while True:

        def count(a, b, tiles, edges=edges):
            out = []
            for k, s in again(tiles):
                order = np.argsort(s, kind="stable")
                k, s = k[order], s[order]
                bins = np.searchsorted(edges, s, side="right")
                _, start, n = np.unique(k * (len(edges) + 1) + bins, return_index=True, return_counts=True)
                out.append(pd.DataFrame({"first": k[start], "bin": bins[start], "n": n, "lo": s[start], "hi": s[start + n - 1]}))
            if out:
                yield pd.concat(out).groupby(["first", "bin"], as_index=False).agg({"n": "sum", "lo": "min", "hi": "max"})

        if (sizes > GATHERED).any():
            h = _each_block(index, None, count, fields).groupBy("first", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("first", "bin").toPandas()
        else:  # few enough to gather as they are
            h = pd.DataFrame({"first": first, "bin": -1, "n": sizes, "lo": 0.0, "hi": 1.0})
        start = below[np.searchsorted(first, h["first"])]  # values before each row's first bin
        before = h["n"].groupby(h["first"]).cumsum().to_numpy() - h["n"].to_numpy() + start
        rows = np.searchsorted(before, ranks, side="right") - 1
        wide = sorted({i for i in rows if h["lo"][i] < h["hi"][i] and h["n"][i] > GATHERED})
        if not wide:
            break
        finer = [np.linspace(h["lo"][i], h["hi"][i], BINS + 1) for i in wide]
        grown = np.unique(np.concatenate([edges, *finer]))
        if len(grown) == len(edges):  # neighbouring doubles
            break
        edges = grown
    want = {(int(h["first"][i]), int(h["bin"][i])) for i in rows if h["lo"][i] < h["hi"][i]}

    def gather(a, b, tiles):
        for k, s in again(tiles):
            bins = np.searchsorted(edges, s, side="right")
            for f, i in want:
                some = (k == f) if i < 0 else (k == f) & (bins == i)
                if some.any():
                    yield pd.DataFrame({"first": f, "bin": i, "sim": s[some]})

    values = {k: np.sort(v["sim"].to_numpy()) for k, v in _each_block(index, None, gather, "first long, bin long, sim double").toPandas().groupby(["first", "bin"])} if want else {}
    got = {}
    for r, i in zip(ranks, rows):
        k = (int(h["first"][i]), int(h["bin"][i]))
        got[r] = float(values[k][r - before[i]]) if k in values else float(h["lo"][i])
    out = []
    for k in spots:
        low, high = got[int(k)], got[min(int(k) + 1, total - 1)]
        out.append(low + (high - low) * (k - int(k)))
    return total, out, least, most


def _unit(m: np.ndarray) -> np.ndarray:
    if not m.size:
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def pair_stats(index: DataFrame) -> DataFrame:
    """One row: pairs, min, p25, p50, p75, p95, p99, max; zeros without pairs."""
    total, (p25, p50, p75, p95, p99), least, most = pair_ranks(index, [0.25, 0.5, 0.75, 0.95, 0.99])
    row = {"pairs": total, "min": least, "p25": p25, "p50": p50, "p75": p75, "p95": p95, "p99": p99, "max": most}
    return index.sparkSession.range(1).select(*[F.lit(v).cast("long" if k == "pairs" else "double").alias(k) for k, v in row.items()])


def tightest(sims: DataFrame) -> DataFrame:
    return sims.orderBy(F.desc("sim"), "a", "b").limit(1)


def isolation(sims: DataFrame) -> DataFrame:
    """(name, nearest): each name's highest similarity to another, 0 at least."""
    both = sims.select(F.explode(F.array("a", "b")).alias("name"), "sim")
    return both.groupBy("name").agg(F.greatest(F.max("sim"), F.lit(0.0)).alias("nearest"))


def most_isolated(sims: DataFrame) -> DataFrame:
    return isolation(sims).orderBy("nearest", "name").limit(1)


def centroids(index: DataFrame, group: str) -> DataFrame:
    """(group, pos, mean, n): element-wise means, summed map-side."""
    return index.select(group, F.posexplode("vec").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def centroid_vectors(index: DataFrame, group: str) -> DataFrame:
    """(group, vec)."""
    c = centroids(index, group).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("_v"))
    return c.select(group, F.col("_v")["mean"].alias("vec"))


def cohesion(index: DataFrame, group: str, zero_fill: bool = True) -> DataFrame:
    """(group, cohesion, members): mean cosine of a group's pairs.

    The sum over pairs is (|sum of unit vectors|^2 - number of non-zero vectors) / 2, so no pairs are made. Fewer than two
    members: 0, or no row without zero_fill.
    """
    of = index.select(group, "vec", norm(F.col("vec")).alias("_n"))
    each = of.select(group, "_n", F.posexplode("vec").alias("pos", "x"))  # the length is taken once for a vector, below the explode
    unit = F.when(F.col("_n") > 0, F.col("x").cast("double") / F.col("_n")).otherwise(F.lit(0.0))
    sums = each.groupBy(group, "pos").agg(F.sum(unit).alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    sizes = of.groupBy(group).agg(F.count("*").alias("members"), F.sum((F.col("_n") > 0).cast("long")).alias("nz"))
    m = F.col("members")
    out = sizes.join(sums, group, "left").select(group, F.when(m > 1, (F.col("sq") - F.col("nz")) / (m * (m - 1))).otherwise(F.lit(0.0)).alias("cohesion"), m)
    return out if zero_fill else out.where("members > 1")


def similar_unlinked(index: DataFrame, edges: DataFrame, names: DataFrame, percentile: float = 0.95, min_similarity: float = 0.6) -> DataFrame:
    """Pairs above the percentile of all pairs (and min_similarity), both among names, without a link either way.

    Names and links are applied to the vectors and inside the blocks; only the result's rows leave these, and they aren't shuffled."""
    threshold = max(pair_ranks(index, [percentile])[1][0], min_similarity)
    linked = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    named = index.select("name", "vec").join(names.select("name").distinct(), "name", "left_semi")
    return pairs(named, threshold, without=linked).select("a", "b", "sim", F.lit(threshold).alias("threshold"))


def contradiction_candidates(index: DataFrame, names: DataFrame, percentile: float = 0.75, min_similarity: float = 0.5) -> DataFrame:
    """Pairs among names above the percentile of all pairs (and min_similarity), by rounded similarity."""
    kind = index.schema["name"].dataType.simpleString()
    none = names.sparkSession.createDataFrame([], f"src {kind}, dst {kind}")
    return similar_unlinked(index, none, names, percentile, min_similarity).select("a", "b", F.round("sim", 3).alias("similarity")).orderBy(F.desc("similarity"), "a", "b")


def drift(index: DataFrame, members: DataFrame, sources: DataFrame, stds: float = 1.5, floor: float = 0.1) -> DataFrame:
    """(name, drift, threshold): pages whose distance to the centroid of their sources exceeds mean + stds * deviation.

    members: (name, source); sources: (name, vec). Nothing if all distances are equal.
    """
    of = members.join(sources.select(F.col("name").alias("source"), "vec"), "source").select("name", "vec")
    c = centroid_vectors(of, "name").withColumnRenamed("vec", "_c")
    d = index.join(c, "name").select("name", (1 - cosine(F.col("vec"), F.col("_c"))).alias("drift"))
    s = d.agg(F.avg("drift").alias("m"), F.stddev_pop("drift").alias("s")).where("s > 0").select(F.greatest(F.col("m") + stds * F.col("s"), F.lit(floor)).alias("threshold"))
    return d.join(F.broadcast(s), F.col("drift") > F.col("threshold"))


def index_changes(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, action): insert, update, delete or keep, by content hash. index and pages: (name, hash)."""
    j = index.select("name", F.col("hash").alias("_old")).join(pages.select("name", F.col("hash").alias("_new")), "name", "full_outer")
    return j.select("name", F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "insert").when(F.col("_old") != F.col("_new"), "update").otherwise("keep").alias("action"))


def update_index(index: DataFrame, pages: DataFrame, embed, model: str) -> DataFrame:
    """The next index (name, hash, vec, model): only new and changed texts are embedded; other models' rows and stale names go.

    pages: (name, hash, text); embed: a column function of texts.
    """
    same = index.where(F.col("model") == model)
    kept = same.join(pages.select("name", "hash"), ["name", "hash"], "left_semi").select("name", "hash", "vec", "model")
    fresh = pages.join(kept.select("name"), "name", "left_anti").select("name", "hash", embed(F.col("text")).alias("vec"), F.lit(model).alias("model"))
    return kept.unionByName(fresh)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashing_embedder(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """An offline stand-in for a provider: word hashes on 64 axes. It knows nothing of meaning."""
    import zlib

    for s in texts:
        out = []
        for t in s.fillna(""):
            v = np.zeros(64)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % 64] += 1 if h >> 16 & 1 else -1
            out.append(v.tolist())
        yield pd.Series(out)


def projection_2d(index: DataFrame) -> DataFrame:
    """(name, x, y) by two principal components: a substitute for a neighbour-preserving map, and another projection than that."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = index.select("name", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("v"))
    p = vector_to_array("p")
    return PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("name", p[0].alias("x"), p[1].alias("y"))


def fit_to_canvas(points: DataFrame, width: float = 1200.0, height: float = 900.0) -> DataFrame:
    """x and y scaled to the canvas, y downwards; a zero range counts as 1."""
    r = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    span = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(F.lit(1.0))
    return points.join(F.broadcast(r)).select("name", ((F.col("x") - F.col("x0")) / span("x0", "x1") * width).alias("x"), ((1 - (F.col("y") - F.col("y0")) / span("y0", "y1")) * height).alias("y"))
