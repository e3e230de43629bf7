"""Document fingerprints by SimHash, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shingles, whole, words
from .simhash import components, vote

#: Words of a term, and longs of a fingerprint.
TERM_WORDS, LONGS = 5, 2


def fingerprints(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys and the longs f0, f1 of each text's 128-bit fingerprint.

    Terms are shingles of five lower-cased words (of all words, if there are fewer), each occurrence weighted by
    its characters; each bit of the terms' hashes is a signed vote. Equal texts have equal fingerprints; a text
    without words (null too) has zero. Rows with equal keys must have equal texts and give one row.
    """
    w = df.select(*keys, words(F.lower(text)).alias("_words"))
    s = shingles(w.select(*keys, "_words"), "_words", TERM_WORDS, "_s").select(*keys, "_s.*")
    parts = [F.col(f"w{i + 1}") for i in range(TERM_WORDS)]
    here = F.col("w1").isNotNull()
    hashes = [F.when(here, F.xxhash64(F.lit(i), *parts)) for i in range(LONGS)]
    return vote(s, keys, hashes, sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0)))


def near_classes(fps: DataFrame, fp: list[str], id_col: str, radius: int = 3) -> DataFrame:
    """fps with class_id: the smallest id among fingerprints linked by steps of at most `radius` bits.

    All such links are found, by permuted block tables (see simhash.components). Null ids: class_id is that of the
    fingerprint, null if no row with an id has it.
    """
    reps = cut(fps.groupBy(*fp).agg(F.min(id_col).alias("_rep")), "reps")
    linked = components(reps.where("_rep is not null"), fp, "_rep", radius)
    classes = reps.join(linked.withColumnRenamed("node", "_rep"), "_rep", "left").select(*fp, F.coalesce("component", "_rep").alias("class_id"))
    return fps.join(classes, fp, "left")


def successors(ids: DataFrame, id_col: str) -> DataFrame:
    """id, next_id, prev_id among distinct ids, in ascending order and closed to a ring (a lone id follows itself).

    Ids are dealt out by ranges; each range's ends are joined to its neighbours', so no task sees all ids.
    """
    ranged = ids.select(F.col(id_col).alias("id")).repartitionByRange(F.col("id")).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    w = Window.partitionBy("_p").orderBy("id")
    inner = ranged.select("_p", "id", F.lead("id").over(w).alias("next_id"), F.lag("id").over(w).alias("prev_id"))
    ends = ranged.groupBy("_p").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))  # as many rows as partitions
    order = Window.orderBy("_p")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_p", F.coalesce(F.lead("_first").over(order), F.first("_first").over(around)).alias("_after"), F.coalesce(F.lag("_last").over(order), F.last("_last").over(around)).alias("_before"))
    joined = inner.join(F.broadcast(ends), "_p")
    return joined.select("id", F.coalesce("next_id", "_after").alias("next_id"), F.coalesce("prev_id", "_before").alias("prev_id"))


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, next_id, n_chars and the edited text: its last floor(n/2) code points replaced by as many of the next document.

    Rows with a null id take no part; of several texts with one id the one with the smallest SHA-256 counts.
    Texts are dealt out by id once; then only the half that stays moves to the next document's place.
    """
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("sha", F.sha2("text", 256))
    chosen = cut(d.groupBy("id").agg(F.min("sha").alias("sha")), "ids")
    ring = successors(chosen, "id").select("id", "next_id")
    texts = d.join(chosen, ["id", "sha"]).dropDuplicates(["id"]) if _repeats(d, chosen) else d
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    heads = texts.join(ring, "id").select("id", "next_id", n.cast("long").alias("n_chars"), half.alias("half"), F.left("text", n - half).alias("head"))
    after = texts.select(F.col("id").alias("next_id"), F.col("text").alias("_next"))
    return heads.join(after, "next_id").select("id", "next_id", "n_chars", F.concat("head", F.left("_next", F.col("half"))).alias("edited"))


def _repeats(d: DataFrame, chosen: DataFrame) -> bool:
    return d.select("id").count() != chosen.count()
