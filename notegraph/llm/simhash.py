"""SimHash fingerprints and the search for all fingerprints within a Hamming radius, in DataFrame operations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

#: A lane of 32 bits for each of two bits of a hash: one long sums the votes on both.
_TWO_LANES = 0x100000001
_LANE = 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def vote(df: DataFrame, keys: list[str], hashes: list[Column], weight: Column, *more: Column) -> DataFrame:
    """keys, one long f0, f1, ... for each hash, and aggregates `more` of df's columns: bit b is 1 if terms of over half the weight have bit b set.

    df has a row for each term; rows whose hash is null have no vote, and keys without votes get zero.
    Votes are summed map-side, two bits to a long, so a key sends one row from each task. A key's weights
    must sum to less than 2^31, else it is an error.
    """
    h = [f"_h{i}" for i in range(len(hashes))]
    terms = df.select(*(["*"] if more else keys), *[x.alias(n) for x, n in zip(hashes, h)], weight.cast("long").alias("_w"))
    sums = [F.sum(F.shiftrightunsigned(F.col(n), j).bitwiseAND(F.lit(_TWO_LANES)) * F.col("_w")).alias(f"{n}_{j}") for n in h for j in range(32)]
    total = terms.groupBy(*keys).agg(F.sum(F.when(F.col(h[0]).isNotNull(), F.col("_w"))).alias("_total"), *sums, *more)
    fits = F.coalesce(F.col("_total"), F.lit(0)) < F.lit(1 << 31)

    def bits(n: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            v = F.col(f"{n}_{j}")
            for lane, at in ((v.bitwiseAND(F.lit(_LANE)), j), (F.shiftrightunsigned(v, 32), j + 32)):
                out = out.bitwiseOR(F.when(lane * 2 > F.col("_total"), F.lit(_signed(1 << at))).otherwise(F.lit(0).cast("long")))
        return out

    rest = [c for c in total.columns[len(keys) + 1 + len(sums) :]]
    return total.select(*keys, *[F.when(fits, bits(n)).otherwise(F.raise_error(F.lit("votes of a text sum to 2^31 or more")).cast("long")).alias(f"f{i}") for i, n in enumerate(h)], *rest)


def hex_of(*longs: Column) -> Column:
    """16 lowercase hex digits for each long."""
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in longs])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """1 less the share of bits that differ."""
    return 1.0 - sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0)).cast("double") / (64.0 * len(a))


def _tables(n_words: int, radius: int, spare: int) -> list[list[int]]:
    """Masks of the permuted block tables: of radius + spare blocks, each choice of `spare` that may agree."""
    bits, blocks = 64 * n_words, radius + spare
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), spare):
        whole = sum(((1 << edges[c + 1]) - (1 << edges[c])) for c in chosen)
        out.append([_signed((whole >> (64 * w)) & ((1 << 64) - 1)) for w in range(n_words)])
    return out


def components(fingerprints: DataFrame, fp: list[str], rep: str, radius: int, spare: int = 3, bucket_rows: int = 64) -> DataFrame:
    """(rep, component) over distinct fingerprints that differ in `radius` bits or fewer, linked transitively.

    fingerprints: one row for each distinct fingerprint, its longs in fp and a unique long in rep. Rows without
    any link are left out. Two fingerprints within the radius agree in `spare` of radius + spare blocks, so they share
    a bucket of at least one table (pigeonhole). Buckets of up to bucket_rows are joined to themselves and verified.
    Larger buckets take an exact way without pairs: a fingerprint's variants with at most radius // 2 free bits flipped
    meet the variants with at most radius - radius // 2 flipped of all that lie within the radius, and each variant
    has few owners, so no key gets hot. Nothing is capped.
    """
    masks = _tables(len(fp), radius, spare)
    keys = [f"_k{w}" for w in range(len(fp))]
    entry = F.array(*[F.struct(F.lit(t).alias("_t"), *[F.col(f).bitwiseAND(F.lit(m)).alias(k) for f, m, k in zip(fp, mask, keys)]) for t, mask in enumerate(masks)])
    tables = fingerprints.select(F.col(rep).alias("_id"), *fp, F.explode(entry).alias("_e")).select("_id", *fp, "_e.*")
    at = ["_t", *keys]
    sizes = tables.groupBy(*at).agg(F.count("*").alias("_n")).where("_n > 1")
    placed = cut(tables.join(sizes, at), "buckets")
    some = placed.where(F.col("_n") <= bucket_rows)
    other = some.select(*at, F.col("_id").alias("_id2"), *[F.col(f).alias(f"{f}_2") for f in fp])
    distance = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}_2"))) for f in fp), F.lit(0))
    near = some.join(other, at).where((F.col("_id") < F.col("_id2")) & (distance <= radius)).select(F.col("_id").alias("u"), F.col("_id2").alias("v"))
    # The exact way for large buckets.
    few, more = radius // 2, radius - radius // 2
    large = placed.where(F.col("_n") > bucket_rows)
    free = [[b for b in range(64 * len(fp)) if not (mask[b // 64] >> (b % 64)) & 1] for mask in masks]
    flips = F.array(*[F.array(*[F.lit(b) for b in f]) for f in free])[F.col("_t")]
    cols = [F.col(f) for f in fp]

    def flipped(of: list[Column], bit: Column) -> list[Column]:
        return [x.bitwiseXOR(F.when(F.floor(bit / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).otherwise(F.lit(0).cast("long"))) for w, x in enumerate(of)]

    def variants(most: int, side: str) -> DataFrame:
        out = step = large.select("_t", "_id", *fp, flips.alias("_free"), F.lit(-1).alias("_last"))
        for _ in range(most):
            step = step.withColumn("_b", F.explode("_free")).where("_b > _last")
            step = step.select("_t", "_id", *[x.alias(f) for x, f in zip(flipped(cols, F.col("_b")), fp)], "_free", F.col("_b").alias("_last"))
            out = out.unionByName(step)
        return out.select("_t", *fp, "_id", F.lit(side).alias("_side"))

    if large.limit(1).count():
        if few == more:
            every = variants(few, "a")
            heads = every.groupBy("_t", *fp).agg(F.min("_id").alias("v"))
        else:
            every = variants(more, "b")
            heads = variants(few, "a").groupBy("_t", *fp).agg(F.min("_id").alias("v"))
        near = near.unionByName(every.join(heads, ["_t", *fp]).where("_id <> v").select(F.col("_id").alias("u"), "v"))
    return connected_components(near)
