"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v) are stars round their minima: each u has one v, and no v is a u itself."""
    several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
    return not several.unionByName(chained).limit(1).count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge (u, v) of longs; component is the smallest node reachable.

    Each round replaces edges by stars around minima, in five shuffles, with map-side minima before any shuffle; a hub's edges
    are only joined to the hub's minimum, which adaptive execution splits. Each round is written to the shared folder, and
    the round before is deleted. It ends when no edge can change, as all are stars.
    Edges with a null end and loops are ignored. No edges: no rows.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        # Large stars: an end (v) hands its larger neighbours to its least one; ends without a smaller one keep theirs.
        least = e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = e.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        # Small stars. Equal rows go with the last distinct.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        before, e = e, cut(small.where("u <> v").distinct(), "edges")
        release(before)
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
