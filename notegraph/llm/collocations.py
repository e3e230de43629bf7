"""Phrase collocations: candidates by upper bounds of a sketch, counts by guarded automata over the passages that hold them."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole

#: Counters of a row of the sketch: one for CHARS characters of text, within these powers of two. The upper one bounds what is broadcast: 2 rows of 2^30 bits.
CHARS, LEAST_BITS, MOST_BITS = 32, 16, 30
#: Phrases whose hashes are gathered before their counters are written out, and counters of a block of the sketch.
GATHERED, BLOCK_BITS = 4_000_000, 16
#: Passages of an automaton, unless more start with the same two words, and counts of a batch that leaves it.
SHARD, COUNTS = 400_000, 4_096
#: Counters of a row of the sketch, as a power of two, for a bucket of passages.
BUCKET_BITS = 15
#: Characters after which a long text is taken apart, at the end of a piece.
SEGMENT = 1_000_000
#: Words that a task counts or hashes before it writes them out or forgets them.
WORDS = 500_000

#: Tabs part words as blanks do; every separator of pieces becomes a full stop, which so is no part of a word.
_TABLE = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" " + b"." * 9)
_MIX, _NEXT, _ROW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """A number for each word met, 0 for a full stop; `hashes` has each number's hash, 0 for a full stop only."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes = np.zeros(1 << 12, np.uint64)
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        if i == len(self.hashes):
            self.hashes = np.append(self.hashes, np.zeros(i, np.uint64))
        self.hashes[i] = (xxhash.xxh3_64_intdigest(word) >> 1) or 1
        return i

    def numbers(self, part: list[bytes]) -> np.ndarray:
        if len(self) > WORDS:
            self.forget()
        return np.fromiter(map(self.__getitem__, part), np.int64, len(part))


def tokens(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in order, with a full stop after each piece; a long text in several lists."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_TABLE)
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > SEGMENT:
            last = data.rfind(b".", start, start + SEGMENT)
            last = last if last >= 0 else data.find(b".", start + SEGMENT)
            end = last + 1 if last >= 0 else end
        yield (data[start:end].replace(b".", b" . ") + b" .").split()
        start = end


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _batches(pdf: pd.DataFrame, known: _Words) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, tokens, their numbers) of the texts of a batch, some texts of a language together."""
    for lang, texts in pdf.groupby("lang", sort=False)["text"]:
        part: list[bytes] = []
        for text in texts:
            for more in tokens(text):
                part += more
                if len(part) > SEGMENT // 4:
                    yield lang, part, known.numbers(part)
                    part = []
        if part:
            yield lang, part, known.numbers(part)


def _longer(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return (h ^ (h >> np.uint64(29))) * _MIX + nxt * _NEXT


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (((h ^ (h >> np.uint64(32))) * (_ROW if row else _MIX)) >> np.uint64(64 - bits)).astype(np.uint32)


def _pack(cells: np.ndarray, row: int) -> Iterator[tuple[int, bytes]]:
    """(block, what it counts): of each block's counters in order the low and high bytes of gaps, and counts up to 255; larger ones take several places."""
    cells.sort()
    at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    n = np.diff(np.append(at, len(cells)))
    cell = cells[at]
    if n.max() > 255:
        times = (n + 254) // 255
        cell, n = np.repeat(cell, times), np.repeat(n, times)
        ends = np.cumsum(times) - 1
        left = np.full(len(n), 255)
        left[ends] = n[ends] - 255 * (times - 1)
        n = left
    block = cell >> np.uint32(BLOCK_BITS)
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    offset = (cell & np.uint32((1 << BLOCK_BITS) - 1)).astype(np.uint16)
    gap = np.diff(offset, prepend=np.uint16(0))  # wraps at a block's start, where it is set anew
    gap[starts] = offset[starts]
    low, high, n = (gap & np.uint16(255)).astype(np.uint8), (gap >> np.uint16(8)).astype(np.uint8), n.astype(np.uint8)
    for a, b in zip(starts, np.append(starts[1:], len(cell))):
        yield 2 * int(block[a]) + row, low[a:b].tobytes() + high[a:b].tobytes() + n[a:b].tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, n = np.frombuffer(data, np.uint8).reshape(3, -1)
    return np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8)), n


def _sketcher(bits: int, longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, n_held = _Words(), [], 0
        words: dict[str, Counter] = {}

        def rows_of_words() -> pd.DataFrame:
            rows = [(lang, w.decode("utf-8", "surrogatepass"), n) for lang, c in words.items() for w, n in c.items() if w != b"."]
            words.clear()
            return pd.DataFrame({"lang": [r[0] for r in rows], "word": [r[1] for r in rows], "n": [r[2] for r in rows], "block": None, "data": None}).astype({"n": "Int64", "block": "Int64"})

        def rows_of_blocks() -> Iterator[pd.DataFrame]:
            h = np.concatenate(held)
            held.clear()
            for row in range(2):
                packed = list(_pack(_cells(h, row, bits), row))
                for a in range(0, len(packed), 256):
                    yield pd.DataFrame({"lang": None, "word": None, "n": None, "block": [b for b, _ in packed[a : a + 256]], "data": [d for _, d in packed[a : a + 256]]}).astype({"n": "Int64"})

        for pdf in batches:
            for lang, part, number in _batches(pdf, known):
                words.setdefault(lang, Counter()).update(part)
                h, inside = known.hashes[number], number != 0
                phrase, good = h ^ np.uint64(_seed(lang)), inside
                for k in range(1, longest):
                    phrase, good = _longer(phrase[:-1], h[k:]), good[:-1] & inside[k:]
                    held.append(phrase[good])
                    n_held += len(held[-1])
                if n_held >= GATHERED:
                    yield from rows_of_blocks()
                    n_held = 0
            if sum(map(len, words.values())) > WORDS:
                yield rows_of_words()
        if n_held:
            yield from rows_of_blocks()
        if words:
            yield rows_of_words()

    return run


def _summer(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, total = None, np.zeros(1 << BLOCK_BITS, np.int64)

        def bits() -> pd.DataFrame:
            return pd.DataFrame({"block": [block], "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})

        for pdf in batches:
            for b, data in zip(pdf["block"], pdf["data"]):
                if b != block:
                    if block is not None:
                        yield bits()
                    block, total = b, np.zeros(1 << BLOCK_BITS, np.int64)
                at, n = _unpack(data)
                np.add.at(total, at, n.astype(np.int64))  # of one kind with the sums, or it takes some ten times as long
        if block is not None:
            yield bits()

    return run


def _finder(frequent, bits: int, longest: int, buckets: int):
    """A task's passages with counts: from each word on, the longest phrase of which every part reaches the threshold by both rows of the sketch.

    Whether a phrase may reach it depends on its words only, and its beginnings may then, too. So the candidates are the beginnings of passages, and one
    occurs as often as passages begin with it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, found = _Words(), {}
        rows = [np.frombuffer(x, np.uint8) for x in frequent.value]

        def reaches(h: np.ndarray) -> np.ndarray:
            ok = np.ones(len(h), bool)
            for row, field in enumerate(rows):
                c = _cells(h, row, bits)
                ok &= (field[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 > 0
            return ok

        def out() -> pd.DataFrame:
            dealt: dict[tuple[str, int], tuple[list[str], list[int]]] = {}
            for (lang, passage), n in found.items():
                start = b" ".join(passage.split(b" ", 2)[:2])
                passages, counts = dealt.setdefault((lang, zlib.crc32(start) % buckets), ([], []))
                passages.append(passage.decode("utf-8", "surrogatepass"))
                counts.append(n)
            found.clear()
            return pd.DataFrame([(lang, b, p, n) for (lang, b), (p, n) in dealt.items()], columns=["lang", "bucket", "passages", "counts"])

        for pdf in batches:
            for lang, part, number in _batches(pdf, known):
                at = np.flatnonzero(number)
                phrase, name = known.hashes[number[at]] ^ np.uint64(_seed(lang)), number[at]
                levels = []
                for k in range(1, longest):
                    last = at + k
                    at, phrase, name = (x[last < len(number)] for x in (at, phrase, name))
                    inside = number[at + k] != 0
                    at, name = at[inside], name[inside]
                    phrase = _longer(phrase[inside], known.hashes[number[at + k]])
                    ok = reaches(phrase)
                    if k > 1:  # what starts a word later and is a word shorter is a candidate, too
                        ok &= np.isin(at + 1, before, assume_unique=True)
                    before = at = at[ok]
                    # A phrase's name in this part: the number of its beginning's name and its last word's number.
                    _, first, name = np.unique((name[ok] << 32) | number[at + k], return_index=True, return_inverse=True)
                    phrase = phrase[ok]
                    levels.append((k, at, first, name))
                further = at[:0]
                for k, at, first, name in reversed(levels):
                    counts = np.bincount(name[~np.isin(at, further, assume_unique=True)], minlength=len(first))
                    ends = np.flatnonzero(counts)
                    for i, n in zip(at[first[ends]].tolist(), counts[ends].tolist()):
                        passage = (lang, b" ".join(part[i : i + k + 1]))
                        found[passage] = found.get(passage, 0) + n
                    further = at
            if len(found) > WORDS:
                yield out()
        if found:
            yield out()

    return run


def _counted(passages: dict[str, int], least: int) -> Iterator[tuple[str, int]]:
    """(phrase, count) of the beginnings of passages that reach the threshold: an automaton of them, a blank at either end, runs over the passages.

    A match counts where its passage starts; from the words further on there are passages of their own.
    """
    begins = {}  # in order
    for p in passages:
        end = p.find(" ", p.find(" ") + 1)
        while end >= 0:
            begins[p[:end]] = None
            end = p.find(" ", end + 1)
        begins[p] = None
    automaton, phrases = ahocorasick.Automaton(ahocorasick.STORE_INTS), list(begins)
    for i, p in enumerate(phrases):
        automaton.add_word(f" {p} ", i)
    automaton.make_automaton()
    totals = [0] * len(phrases)
    for p, n in passages.items():
        for end, i in automaton.iter(f" {p} "):
            if end == len(phrases[i]) + 1:
                totals[i] += n
    return ((p, a) for p, a in zip(phrases, totals) if a >= least)


def _counter(least: int):
    """Of rows in order of language and bucket, each candidate's count, if it reaches the threshold."""

    def counted(lang: str, passages: dict[str, int]) -> Iterator[pd.DataFrame]:
        names = sorted(passages, key=lambda p: p.split(" ")) if len(passages) > SHARD else list(passages)
        at = 0
        while at < len(names):
            end = min(at + SHARD, len(names))
            while end < len(names) and names[end].split(" ", 2)[:2] == names[end - 1].split(" ", 2)[:2]:
                end += 1  # phrases that start alike stay together
            rows = list(_counted({p: passages[p] for p in names[at:end]}, least))
            for i in range(0, len(rows), COUNTS):
                yield pd.DataFrame(rows[i : i + COUNTS], columns=["phrase", "a"]).assign(lang=lang)[["lang", "phrase", "a"]]
            at = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, {}
        for pdf in batches:
            for lang, bucket, passages, counts in zip(pdf["lang"], pdf["bucket"], pdf["passages"], pdf["counts"]):
                if key != (lang, bucket):
                    if key is not None:
                        yield from counted(key[0], held)
                    key, held = (lang, bucket), {}
                for p, n in zip(passages, counts.tolist()):
                    held[p] = held.get(p, 0) + n
        if key is not None:
            yield from counted(key[0], held)

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a), (lang, word, n)): every phrase of 2 to `longest` words with at least `least` occurrences, and every word's count.

    One pass counts words and sums the hashes of all phrases in a count-min sketch of two rows; sums only grow by collisions, so a phrase
    below the threshold in either row, or with a part that is, can't reach it. A second pass takes from each word on the longest phrase that may. These passages, summed
    up in their task, are dealt by language and their first two words; where they meet, automata of their beginnings, with a blank as guard at either end, count
    the matches. So texts are read twice, however many candidates there are. No key is hot: a task sends a passage once for WORDS others.
    A null text is empty, a null language is `und`, repeated rows count each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bits = min(max(LEAST_BITS, (chars // CHARS).bit_length()), MOST_BITS)
    counted = cut(rows.mapInPandas(_sketcher(bits, longest), "lang string, word string, n long, block long, data binary"), "phrase-sketch")
    words = cut(counted.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = counted.where("block is not null").select("block", "data").repartition(parts, "block").sortWithinPartitions("block")
    fields = [bytearray(1 << (bits - 3)) for _ in range(2)]
    size = 1 << (BLOCK_BITS - 3)
    flags = cut(blocks.mapInPandas(_summer(least), "block long, bits binary"), "phrase-flags")  # summed up by all tasks at once, before the driver takes them one by one
    for block, data in flags.toLocalIterator():  # of 2^(bits - 2) bytes in all
        fields[block % 2][block // 2 * size : (block // 2 + 1) * size] = data
    frequent = spark.sparkContext.broadcast([bytes(f) for f in fields])
    buckets = max(64, parts, 1 << max(0, bits - BUCKET_BITS))
    found = rows.mapInPandas(_finder(frequent, bits, longest, buckets), "lang string, bucket long, passages array<string>, counts array<long>")
    found = found.repartition(parts, "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return cut(found.mapInPandas(_counter(least), "lang string, phrase string, a long"), "phrase-counts"), words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2_000, cover: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by association.

    A phrase is cut where floor(1000 * a * n / (l * r)) is least, l and r the counts of the two parts, ties to the shorter first part. A phrase
    inside a longer one with at least `cover` percent of its count is left out. To compare with the next longer ones is enough:
    what lies between a phrase and a longer one has counts between theirs. Products are decimals of 38 digits. Ties by score go to the larger count, then the phrase's bytes.
    An empty table, and one without frequent phrases, give no rows; other columns of docs don't matter.
    """
    counts, words = phrase_counts(docs, text_col, lang_col, least, longest)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = counts.unionByName(words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    w = F.split("phrase", " ")
    cuts = counts.select("lang", "phrase", "a", w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left, right = parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(F.broadcast(n), "lang")  # a row for each language
    scored = scored.select("lang", "phrase", "a", "k", "l", "r", "n", (F.lit(1000).cast("decimal(4,0)") * exact("a", 15)).alias("above"), (exact("l", 18) * exact("r", 18)).alias("below"))
    scored = scored.withColumn("score", F.expr("(above * cast(n as decimal(18,0))) div below"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")
    longer = counts.where(F.size(w) > 2).select("lang", "a", F.explode(F.array(F.array_join(F.slice(w, 1, F.size(w) - 1), " "), F.array_join(F.slice(w, 2, F.size(w)), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))).drop("most")
    # A language's candidates meet in two steps, so that a common one isn't ranked by one task alone.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_part = "row_number() over (partition by lang, pmod(xxhash64(phrase), 64) order by score desc, a desc, phrase)"
    some = kept.withColumn("in_part", F.expr(in_part)).where(F.col("in_part") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
