"""Near-duplicate groups: by SimHash, joined on pigeonhole blocks, and by the similarity of shingle sets, joined on their prefixes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let_go, release, shingles, small_side, whole, words
from .graph import connected_components
from .simhash import components, vote


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """(id, f0, component_id): a row for each row of docs, repeated ones too; component_id is the smallest id linked.

    f0 is the 64-bit SimHash of the lower-cased (A-Z) text's word shingles under XXH64 with seed 42, each occurrence
    one vote. A text of fewer words gives one shingle; without words (null too) f0 is zero and links like any other.
    Fingerprints link at `radius` or fewer differing bits: blocks, join on blocks, then the exact distance
    (simhash.components). Rows with a null id get the component of their fingerprint, null if no id has it.
    """
    d = docs.select(F.col(id_col).alias("id"), ascii_lower(whole(text_col)).alias("_text"))
    d = d.select("id", F.xxhash64("_text").alias("_x"), words(F.col("_text")).alias("_words"))
    s = shingles(d, "_words", shingle_words, "_s", first="_one").select("id", "_x", "_one", "_s.*")
    term = F.concat_ws(" ", *[F.col(f"w{i + 1}") for i in range(shingle_words)])
    # Rows equal in id and text vote together, which changes no bit; _rows of them are made again.
    fps = cut(vote(s, ["id", "_x"], [F.when(F.col("w1").isNotNull(), F.xxhash64(term))], F.lit(1), F.sum("_one").cast("int").alias("_rows")), "fingerprints")
    reps = cut(fps.groupBy("f0").agg(F.min("id").alias("rep")), "reps")
    linked = components(reps.where("rep is not null"), ["f0"], "rep", radius)
    classes = reps.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("f0", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(classes, "f0", "left")
    return out.select("id", "_x", "f0", "component_id", F.explode(F.sequence(F.lit(1), "_rows")).alias("_row")).drop("_row")


#: Words of a shingle, bins of a sketch, and the chance that the candidate search or the sketches lose a pair.
_WORDS, _BINS, _MISS = 5, 64, 1e-8
#: Hamming radius of the SimHash blocks that come first, and rounds in which large buckets are compared with one member.
_RADIUS, _ROUNDS = 3, 3
#: Texts that common shingles are looked for in, and texts of these that make a shingle common. Any choice gives the same result.
_SAMPLED, _COMMON = 8_192, 3


def _shingle_set(text: str) -> np.ndarray:
    """The distinct 64-bit hashes of the text's five-word shingles, ascending; fewer words make one shingle, none make no shingle."""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < _WORDS:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(ws))], np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in ws], np.uint64)
    g = np.zeros(len(h) - _WORDS + 1, np.uint64)
    for i in range(_WORDS):
        g = (g ^ h[i : i + len(g)]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return np.unique(g)


def _simhash(s: np.ndarray) -> int:
    """Each hash votes on 64 signed bits."""
    votes = np.unpackbits(s.astype(">u8").view(np.uint8)).reshape(len(s), 64).sum(axis=0)
    return int(np.packbits(2 * votes > len(s)).view(">i8")[0])


def _sketch(s: np.ndarray) -> np.ndarray:
    """Eight bits of the least hash in each of _BINS bins: a bin of two sets differs with a chance of 1 less their similarity at most."""
    out = np.zeros(_BINS, np.uint8)
    bins, first = np.unique(s & np.uint64(_BINS - 1), return_index=True)
    out[bins.astype(np.int64)] = (s[first] >> np.uint64(8)).astype(np.uint8)
    return out.view(np.int64)


def _parity(s: np.ndarray) -> np.ndarray:
    """512 bits, of which each hash flips one: those of two sets differ in as many bits at most as elements are in one set only."""
    flips = np.bincount((s >> np.uint64(16) & np.uint64(511)).astype(np.int64), minlength=512)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def _least_hashes(similarity: float) -> int:
    """How many least hashes of two sets at this similarity share one, but for a chance of _MISS."""
    return math.ceil(math.log(_MISS) / math.log(1 - similarity))


def _most_differing(similarity: float) -> int:
    """As many bins of two sets at this similarity differ at most, but for a chance of _MISS."""
    p, above = 1 - similarity, 1.0
    for most in range(_BINS + 1):
        above -= math.comb(_BINS, most) * p**most * (1 - p) ** (_BINS - most)
        if above < _MISS:
            return most
    return _BINS


def _prefix(n: int, similarity: float) -> int:
    """Two sets at this similarity share one of the first so many of n elements, in any order that is the same for both."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _marks(similarity: float):
    """(id, _x, _s, _size, f0, _sketch, _parity, _at): each text's set as a hash, its size, SimHash, sketches and least hashes."""
    few = _least_hashes(similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for pdf in batches:
            out = []
            for i, x, text in zip(pdf["id"], pdf["_x"], pdf["_text"]):
                g = _shingle_set(text)
                s = int(np.uint64(xxhash.xxh3_64_intdigest(g.tobytes())).view(np.int64))
                out.append((i, x, s, len(g), _simhash(g), _sketch(g), _parity(g), g[: min(few, _prefix(len(g), similarity))].view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "_x", "_s", "_size", "f0", "_sketch", "_parity", "_at"]).astype({"id": pdf["id"].dtype})

    return run


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    let_go()
    for pdf in batches:
        yield pd.DataFrame({"_at": np.concatenate([np.zeros(0, np.uint64), *map(_shingle_set, pdf["_text"])]).view(np.int64)})


def _prefixes(common: Broadcast, similarity: float):
    """(_s, _at): the shingles of a whole prefix, in an order of all shingles with common ones last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        last = common.value
        for pdf in batches:
            out = []
            for text in pdf["_text"]:
                g = _shingle_set(text)
                late = last[np.searchsorted(last, g).clip(max=len(last) - 1)] == g if len(last) else np.zeros(len(g), bool)
                out.append(np.concatenate([g[~late], g[late]])[: _prefix(len(g), similarity)].view(np.int64))
            yield pd.DataFrame({"_s": pdf["_s"], "_at": out})

    return run


class _Groups:
    """The state of similar_groups: sets as nodes (_s), and what they are linked to (_s, _c) so far, by the smallest _s."""

    def __init__(self, docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, similarity: float, bucket_rows: int):
        self.docs, self.id_col, self.text_col, self.similarity, self.bucket_rows = docs, id_col, text_col, similarity, bucket_rows
        keys = marks.groupBy("id", "_x", "_s").agg(F.count("*").alias("_rows"))
        least = F.min_by(F.struct("_x", "_rows"), "id").alias("_r")
        self.nodes = cut(keys.where("id is not null").groupBy("_s").agg(F.min("id").alias("rep"), least).select("_s", "rep", F.col("_r._x").alias("_rep_x"), F.col("_r._rows").alias("_rep_rows")), "near-nodes")
        self.ends = cut(marks.where("id is not null").select("_s", "_size", "f0", "_sketch", "_parity", "_at").dropDuplicates(["_s"]), "near-ends")
        self.linked: DataFrame | None = None

    def texts(self, ends: DataFrame) -> DataFrame:
        """(_s, _text) of ends (_s), a text for each set."""
        wanted = cut(self.nodes.join(ends, "_s").select(F.col("rep").alias("_near_id"), "_rep_x", "_rep_rows", "_s"), "near-wanted")
        d = self.docs.select(F.col(self.id_col).alias("id"), whole(self.text_col).alias("_text"))
        d = d.join(small_side(wanted), F.col("id") == F.col("_near_id")).select("_s", "_rep_x", ascii_lower(F.col("_text")).alias("_text"))
        d = d.where(F.xxhash64("_text") == F.col("_rep_x")).select("_s", "_text")
        return d.dropDuplicates(["_s"]) if wanted.where("_rep_rows > 1").limit(1).count() else d

    def may(self, a: str, b: str) -> Column:
        """Whether sizes and sketches allow the similarity. As many elements are in one of two similar sets only as `apart`, and no more bits of
        the parities or bins of the sketches differ; of bins no more than _most_differing either."""
        m, o = F.col(f"{a}_size"), F.col(f"{b}_size")
        differ = F.lit(0)
        for k in range(_BINS // 8):
            y = F.col(f"{a}_sketch")[k].bitwiseXOR(F.col(f"{b}_sketch")[k])
            for by in (4, 2, 1):  # the last bit of each byte: whether any of its bits is set
                y = y.bitwiseOR(F.shiftrightunsigned(y, by))
            differ = differ + F.bit_count(y.bitwiseAND(F.lit(0x0101010101010101)))
        apart = (m + o) * (1 - self.similarity) / (1 + self.similarity) + 1e-6
        flipped = sum((F.bit_count(F.col(f"{a}_parity")[k].bitwiseXOR(F.col(f"{b}_parity")[k])) for k in range(8)), F.lit(0))
        alike = (flipped <= apart) & (differ <= F.least(F.lit(float(_most_differing(self.similarity))), apart))
        return (F.least(m, o) >= self.similarity * F.greatest(m, o) - 1e-9) & alike

    def sided(self, rows: DataFrame, side: str, node: str) -> DataFrame:
        return rows.select(F.col("_s").alias(node), F.col("_size").alias(f"{side}_size"), F.col("_sketch").alias(f"{side}_sketch"), F.col("_parity").alias(f"{side}_parity"))

    def link(self, pairs: DataFrame, known: bool = False) -> None:
        """Link those of pairs (u, v) whose whole sets are similar. known: sizes and sketches allow it."""
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
        if not known:
            pairs = pairs.join(self.sided(self.ends, "_l", "u"), "u").join(self.sided(self.ends, "_r", "v"), "v").where(self.may("_l", "_r")).select("u", "v")
        pairs = cut(pairs, "near-pairs")
        if not pairs.limit(1).count():
            return
        similarity = self.similarity

        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            let_go()
            for pdf in batches:
                yield pd.DataFrame({"_s": pdf["_s"], "_set": [_shingle_set(t).view(np.int64) for t in pdf["_text"]]})

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            let_go()
            for pdf in batches:
                keep = []
                for a, b in zip(pdf["_a"], pdf["_b"]):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
                yield pdf.loc[keep, ["u", "v"]]

        sets = cut(self.texts(pairs.select(F.explode(F.array("u", "v")).alias("_s")).distinct()).mapInPandas(hashed, "_s long, _set array<long>"), "near-sets")
        both = pairs.join(sets.toDF("u", "_a"), "u").join(sets.toDF("v", "_b"), "v")
        found = cut(both.mapInPandas(verify, "u long, v long"), "near-links")
        release(sets)
        if found.limit(1).count():
            old = self.linked
            edges = found if old is None else found.unionByName(old.toDF("u", "v"))
            self.linked = cut(connected_components(edges).toDF("_s", "_c"), "near-components")

    def of(self, rows: DataFrame) -> DataFrame:
        """rows (_s, ...) with the component _c."""
        return rows.withColumn("_c", F.col("_s")) if self.linked is None else rows.join(self.linked, "_s", "left").withColumn("_c", F.coalesce("_c", "_s"))

    def opened(self, buckets: DataFrame, seed: int) -> DataFrame:
        """(_at, _s, _c, _n, _most, _head) of buckets (_at, _s, _in) that hold several components: the rows, the component with most of
        them, and one of its members: with seed 0 the one in most buckets, as a text that others were made from shares most with them;
        else any. Of buckets with more rows than bucket_rows only those outside of that component."""
        parts = self.of(buckets)
        rank = (F.col("_in") if seed == 0 else F.lit(0)).cast("long")
        head = F.max_by("_s", F.struct(rank, F.xxhash64("_s", F.lit(seed)))).alias("_head")
        by = parts.groupBy("_at", "_c").agg(F.count("*").alias("_n"), F.max(rank).alias("_rank"), head)
        most = F.max_by(F.struct("_c", "_head"), F.struct("_n", "_rank", F.xxhash64("_c", F.lit(seed)))).alias("_m")
        of = by.groupBy("_at").agg(F.sum("_n").alias("_n"), most, F.count("*").alias("_k")).where("_k > 1")
        rows = parts.join(of.select("_at", "_n", F.col("_m._c").alias("_most"), F.col("_m._head").alias("_head")), "_at")
        return cut(rows.where((F.col("_n") <= self.bucket_rows) | (F.col("_c") != F.col("_most"))), "near-open")

    def compare(self, buckets: DataFrame) -> DataFrame:
        """Link what shares a bucket; small buckets are done then. The keys (_at) of larger ones that still hold several components are returned.

        All members are first compared with one of the bucket's largest component, several times, as most links fall there; then all
        pairs of small buckets that no link joins yet.
        """
        for seed in range(_ROUNDS):
            rows = self.opened(buckets, seed)
            if not rows.limit(1).count():
                return rows.select("_at")
            self.link(rows.where("_c <> _most").select(F.col("_s").alias("u"), F.col("_head").alias("v")))
        rows = self.opened(buckets, _ROUNDS)
        small = rows.where(F.col("_n") <= self.bucket_rows)
        other = small.select("_at", F.col("_s").alias("v"), F.col("_c").alias("_d"))
        self.link(small.join(other, "_at").where((F.col("_s") < F.col("v")) & (F.col("_c") != F.col("_d"))).select(F.col("_s").alias("u"), "v"))
        return cut(self.opened(buckets, 0).where(F.col("_n") > self.bucket_rows).select("_at").distinct(), "near-large")

    def several(self, tables: DataFrame) -> DataFrame:
        """The rows of tables (_at, _pos, _s) whose bucket has another, with the number of such rows of their _s (_in)."""
        rows = cut(tables.join(tables.groupBy("_at").agg(F.count("*").alias("_n")).where("_n > 1").select("_at"), "_at"), "near-shared")
        out = cut(rows.join(rows.groupBy("_s").agg(F.count("*").alias("_in")), "_s"), "near-buckets")
        release(rows)
        return out

    def enough(self) -> Column:
        """Whether as many shingles as the similarity needs can be common, if none before the places _l_pos and _r_pos is: true where
        two similar sets have their first common shingle."""
        m, n = F.col("_l_size"), F.col("_r_size")
        return F.least(m - F.col("_l_pos"), n - F.col("_r_pos")) >= self.similarity / (1 + self.similarity) * (m + n) - 1e-6


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bucket_rows: int = 16) -> DataFrame:
    """(id, _x, component_id): a row for each distinct pair of id and text (_x: hash of the lower-cased text); component_id
    is the smallest id linked by texts whose sets of five-word shingles have a Jaccard similarity of `similarity` or more.

    Every such pair ends in one component, but for a chance of 2e-8 for each. Texts of one set (by a 64-bit hash of its sorted 64-bit
    shingle hashes) are one node.
    - SimHash: fingerprints of the sets that differ in _RADIUS bits or fewer meet in pigeonhole blocks (simhash.components); each is
      compared with its class's representative. That finds nearly equal texts, and makes large groups one component early.
    - SimHash can't find pairs at 0.8, whose fingerprints differ in 10 of 64 bits. So nodes also meet in buckets of their least shingle hashes:
      of the least elements of two sets each is a common one with a chance of `similarity`, so of 12 one is but for 4e-9.
    - Members of a bucket are compared with one of its largest component, then all pairs of buckets up to bucket_rows that no link joins.
    - Of larger buckets that still hold several components, all members meet again in buckets of whole prefixes: two sets of n shingles or more share
      one of the first n - ceil(similarity * n) + 1 of each in any fixed order. Shingles that a sample finds common come last, which keeps
      buckets small. Of buckets that stay large, all pairs of different components are compared.
    Sizes, the places of common shingles, parities of 512 bits and sketches of 64 bins drop most pairs that aren't similar; what is left is
    decided by the whole sets.
    Texts of fewer words give one shingle; those without words (null too) have the empty set and are one node.
    Rows with a null id get the component of their set, null if no id has it. Repeated rows give one row. Empty table: no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), ascii_lower(whole(text_col)).alias("_text")).select("id", F.xxhash64("_text").alias("_x"), "_text")
    shape = f"id {d.schema['id'].dataType.simpleString()}, _x long, _s long, _size int, f0 long, _sketch array<long>, _parity array<long>, _at array<long>"
    marks = cut(d.mapInPandas(_marks(similarity), shape), "near-marks")
    g = _Groups(docs, marks, id_col, text_col, similarity, bucket_rows)

    # SimHash
    reps = cut(g.ends.groupBy("f0").agg(F.min("_s").alias("_rep")), "near-simhash")
    near = components(reps, ["f0"], "_rep", _RADIUS).toDF("_rep", "_class")
    classes = reps.join(near, "_rep", "left").select("f0", F.coalesce("_class", "_rep").alias("v"))
    g.link(g.ends.select(F.col("_s").alias("u"), "f0").join(classes, "f0").where("u <> v").select("u", "v"))

    # Least hashes, then whole prefixes of what stays apart in large buckets
    buckets = g.several(g.ends.select("_s", F.posexplode("_at").alias("_pos", "_at")))
    large = g.compare(buckets)
    if large.limit(1).count():
        crowd = cut(buckets.join(large, "_at", "left_semi").select("_s").distinct(), "near-crowd")
        texts = g.texts(crowd)
        share = F.lit(-(-_SAMPLED * (1 << 20) // max(crowd.count(), 1)))
        often = texts.where(F.pmod(F.xxhash64("_s"), F.lit(1 << 20)) < share).mapInPandas(_own, "_at long").groupBy("_at").count()
        often = often.where(F.col("count") >= _COMMON).orderBy(F.desc("count"), "_at").limit(1 << 18)
        common = spark.sparkContext.broadcast(np.sort(often.select("_at").toArrow()["_at"].to_numpy().astype(np.int64).view(np.uint64)))
        prefixes = cut(texts.mapInPandas(_prefixes(common, similarity), "_s long, _at array<long>").select("_s", F.posexplode("_at").alias("_pos", "_at")), "near-prefixes")
        buckets = g.several(prefixes)
        release(prefixes)
        large = g.compare(buckets)
        if large.limit(1).count():
            # All pairs of different components, of which one lies outside of the bucket's largest; sketches are compared within the join.
            every = cut(g.of(buckets.join(large, "_at", "left_semi")).join(g.ends.select("_s", "_size", "_sketch", "_parity"), "_s"), "near-rest")
            outside = g.opened(buckets, 0).where(F.col("_n") > bucket_rows).select("_at", "_s").join(every, ["_at", "_s"])
            left = outside.select("_at", F.col("_s").alias("u"), *[F.col(f"_{c}").alias(f"_l_{c}") for c in ("c", "pos", "size", "sketch", "parity")])
            right = every.select("_at", F.col("_s").alias("v"), *[F.col(f"_{c}").alias(f"_r_{c}") for c in ("c", "pos", "size", "sketch", "parity")])
            g.link(left.join(right, "_at").where((F.col("_l_c") != F.col("_r_c")) & g.enough() & g.may("_l", "_r")).select("u", "v"), known=True)
    least = g.of(g.nodes.select("_s", "rep"))
    classes = cut(least.join(least.groupBy("_c").agg(F.min("rep").alias("component_id")), "_c").select("_s", "component_id"), "near-classes")
    return marks.select("id", "_x", "_s").distinct().join(classes, "_s", "left").select("id", "_x", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs less all but one document of each near-duplicate group (similar_groups): the one with the smallest id.

    Documents whose id is null stay. Rows that repeat the kept id stay together if their texts are in the group, as they share its id.
    """
    groups = similar_groups(docs, id_col, text_col, similarity)
    gone = small_side(cut(groups.where("id <> component_id").select(F.col("id").alias("_ng_id"), F.col("_x").alias("_ng_of")).distinct(), "near-gone"))
    marked = docs.withColumn("_ng_x", F.xxhash64(ascii_lower(whole(text_col))))
    return marked.join(gone, (F.col(id_col) == F.col("_ng_id")) & (F.col("_ng_x") == F.col("_ng_of")), "left_anti").drop("_ng_x")
