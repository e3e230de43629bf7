"""Suffix-array dedup: bytes covered by a long string that starts elsewhere too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole

#: Bytes of the gram that an anchor hashes.
GRAM = 40
#: Distinct contexts of a gram up to which they meet in one suffix array, and contexts that fill a suffix array's batch.
GROUP, BATCH = 32_768, 8_192
#: Neighbouring windows that are compared at once where a gram has more contexts than GROUP.
BLOCK = 24
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(1 << 15, 1 << n.bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            all_ = np.full(size + 1, base, _U)
            all_[0] = 1
            _POWERS[k] = np.cumprod(all_)
    return _POWERS[0], _POWERS[1]


class Hashes:
    """64-bit hashes of any substring of data, by prefix sums."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        up, self._down = _powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, _U)
        np.cumsum(_BYTES[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self._down[start] + (end - start).astype(_U))


def _sliding(a: np.ndarray, w: int, op, fill: int) -> np.ndarray:
    """op over each window of w, by blocks: the end of one block and the beginning of the next."""
    n = len(a) - w + 1
    rows = -(-len(a) // w)
    full = np.full(rows * w, fill, a.dtype)
    full[: len(a)] = a
    blocks = full.reshape(rows, w)
    head = op.accumulate(blocks, axis=1).ravel()
    tail = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[:n], head[w - 1 : w - 1 + n])


def anchors(h: Hashes, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, first window, last window) of each anchor: every window of `length` bytes has one, its gram with
    the least hash (ties: the first). It depends on the window's bytes only, so equal windows have equal anchors at equal places."""
    at = np.arange(n - GRAM + 1)
    g = h.of(at, at + GRAM)
    least = _sliding((g & _U(0xFFFFFFFF00000000)) | at.astype(_U), length - GRAM + 1, np.minimum, 0xFFFFFFFFFFFFFFFF)
    place = (least & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    place = place[first]
    return place, g[place], first, np.append(first[1:], len(least)) - 1


def _marks(length: int):
    """(id, x, pos, start, end, gram, ctx): of each anchor, its windows' bytes and their hash with the anchor's place in them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [[np.zeros(0, np.int64)] * 7]
            for doc, x, text in zip(pdf["id"], pdf["x"], pdf["text"]):
                data = text.encode("utf-8")
                n = len(data)
                if n < length:
                    continue
                h = Hashes(data)
                at, gram, left, right = anchors(h, n, length)
                right = right + length
                ctx = _mix(h.of(left, right) ^ ((at - left).astype(_U) * _U(0xD6E8FEB86659FD93) + (right - at).astype(_U)))
                out.append([np.full(len(at), doc), np.full(len(at), x), at, left, right, gram.view(np.int64), ctx.view(np.int64)])
            yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("id", "x", "pos", "start", "end", "gram", "ctx"))})

    return run


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row with the bytes of each wanted anchor's windows; start: where they begin, off: the anchor in them."""
    for pdf in batches:
        out = []
        for doc, x, text, wanted in zip(pdf["id"], pdf["x"], pdf["text"], pdf["wanted"]):
            data = text.encode("utf-8")
            for a in wanted:
                out.append((a["gram"], doc, x, a["start"], a["n"], a["pos"] - a["start"], a["crowded"], data[a["start"] : a["end"]]))
        yield pd.DataFrame(out, columns=["gram", "id", "x", "start", "n", "off", "crowded", "data"])


def _blocks(length: int):
    """Rows for blocks of neighbouring windows of a context: the hash of what all of them cover (core), and of what any covers (union)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for gram, doc, x, start, n, off, data in zip(*(pdf[c] for c in ("gram", "id", "x", "start", "n", "off", "data"))):
                b = np.arange((length - GRAM) // BLOCK + 1)
                first, last = off - np.minimum(b * BLOCK + BLOCK - 1, length - GRAM), off - b * BLOCK
                a, z = np.maximum(first, 0), np.minimum(last, len(data) - length)
                ok = a <= z
                b, first, last, a, z = b[ok], first[ok], last[ok], a[ok], z[ok]
                h = Hashes(data)
                union = _mix(h.of(a, z + length) + (off - a).astype(_U))
                core = h.of(last, first + length)
                k = len(b)
                out.append((np.full(k, gram), b, core.view(np.int64), union.view(np.int64), np.full(k, doc), np.full(k, x), np.full(k, start), np.full(k, off), np.full(k, n), start + a, start + z + length))
            if out:
                yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("gram", "b", "core", "union", "id", "x", "start", "off", "n", "from", "to"))})

    return run


def _windows(length: int):
    """A row for each window of a context's open blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for gram, doc, x, start, off, data, blocks in zip(*(pdf[c] for c in ("gram", "id", "x", "start", "off", "data", "blocks"))):
                h = Hashes(data)
                for block in blocks:
                    b = block["b"]
                    s = np.arange(max(0, off - min(b * BLOCK + BLOCK - 1, length - GRAM)), min(off - b * BLOCK, len(data) - length) + 1)
                    k = len(s)
                    out.append((np.full(k, gram), off - s, h.of(s, s + length).view(np.int64), np.full(k, doc), np.full(k, x), start + s, np.full(k, block["n"])))
            if out:
                yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("gram", "rel", "window", "id", "x", "from", "n"))})

    return run


def _crowded(rows: DataFrame, length: int, first_stays: bool) -> DataFrame:
    """(id, x, start, end) repeated among the contexts of crowded grams, by counts of hashes, so that no group meets in one task.

    Equal unions repeat all windows of their block. A block whose core nobody else has repeats none. In what is left,
    one of each union, windows are counted.
    """
    blocks = cut(rows.mapInPandas(_blocks(length), "gram long, b int, core long, union long, id long, x long, start int, off int, n long, `from` int, `to` int"), "blocks")
    unions = cut(blocks.groupBy("gram", "b", "core", "union").agg(F.sum("n").alias("n"), F.min(F.struct("id", "x", "start", "off")).alias("rep")), "unions")
    whole_ = blocks.select("gram", "b", "core", "union", "id", "x", "start", "off", "from", "to").join(unions.where("n > 1").select("gram", "b", "core", "union", "rep"), ["gram", "b", "core", "union"])
    cores = unions.groupBy("gram", "b", "core").agg(F.count("*").alias("m")).where("m > 1")
    cores = cut(cores, "cores")
    open_ = unions.join(cores, ["gram", "b", "core"]).groupBy("gram", "rep.id", "rep.x", "rep.start", "rep.off").agg(F.collect_list(F.struct("b", "n")).alias("blocks"))
    windows = cut(rows.join(open_, ["gram", "id", "x", "start", "off"]).select("gram", "id", "x", "start", "off", "data", "blocks").mapInPandas(_windows(length), "gram long, rel int, window long, id long, x long, `from` int, n long"), "windows")
    counted = windows.groupBy("gram", "rel", "window").agg(F.sum("n").alias("c"), F.min(F.struct("id", "x", "from")).alias("head")).where("c > 1")
    counted = cut(counted, "counted")
    hits = windows.select("gram", "rel", "window", "id", "x", "from").join(counted, ["gram", "rel", "window"])
    if first_stays:
        whole_ = whole_.where(F.struct("id", "x", "start", "off") != F.col("rep"))
        hits = hits.where(F.struct("id", "x", "from") != F.col("head"))
    return whole_.select("id", "x", F.col("from").alias("start"), F.col("to").alias("end")).unionByName(hits.select("id", "x", F.col("from").alias("start"), (F.col("from") + length).cast("int").alias("end")))


class RangeMinimum:
    """Minima of any ranges of an array, by a table of the minima of all ranges whose length is a power of two."""

    def __init__(self, a: np.ndarray):
        self.levels = [a]
        while 2 * (1 << (len(self.levels) - 1)) <= len(a):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of a[first..last], both ends included."""
        level = np.log2(np.maximum(last - first + 1, 1)).astype(np.int64)
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.levels[k][first[on]], self.levels[k][last[on] - (1 << k) + 1])
        return out


def suffix_order(group: np.ndarray, texts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows of bytes (zeros after their ends) in order by group, then bytes; lcp[i]: how many bytes rows i - 1 and i
    of the order have in common, 0 at a group's first."""
    m, w = texts.shape
    wide = np.zeros((m, -(-w // 8) * 8), np.uint8)
    wide[:, :w] = texts
    words = wide.view(">u8").astype(_U)
    order = np.lexsort((lens, *words.T[::-1], group))
    a, b = order[:-1], order[1:]
    differ = wide[a] != wide[b]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), wide.shape[1])
    lcp = np.minimum(same, np.minimum(lens[a], lens[b]))
    lcp[group[a] != group[b]] = 0
    return order, np.append(0, lcp).astype(np.int32) if m else np.zeros(0, np.int32)


def factors(runs: np.ndarray, position: np.ndarray, first_stays: bool) -> np.ndarray:
    """Which suffixes have a factor of the wanted length elsewhere. Suffixes stand in suffix order; runs: those that agree in so many bytes.

    The longest factor that starts at an earlier position is that of the previous or next smaller position in suffix order: it has the
    length if a smaller position stands in the run. Without first_stays the previous or next greater one counts too.
    """
    heads = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    size = np.diff(np.append(heads, len(runs)))
    earlier = position > np.repeat(np.minimum.reduceat(position, heads), size)
    return earlier if first_stays else earlier | (position < np.repeat(np.maximum.reduceat(position, heads), size))


def repeats(rows: list[tuple], length: int, first_stays: bool) -> list[tuple[int, int, int, int]]:
    """(id, x, start, end) of bytes in rows' contexts that a string of `length` covers which also starts elsewhere in rows.

    rows: (gram, id, x, start, n, data, off). The suffixes that start at the anchors are put in suffix order, with the lengths of the common
    prefixes of neighbours. Going left from the anchors byte by byte, a stable order by the new first byte makes it the order of the suffixes
    that start there; ranges of the first array's minima give their common prefixes. In each such order, suffixes that agree
    in `length` bytes are neighbours, and factors() tells which of them occur earlier, or elsewhere. Contexts that no other goes along with leave.
    """
    m = len(rows)
    doc, x, start, n, off = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3, 4, 6))
    size = np.array([len(r[5]) for r in rows], dtype=np.int64)
    group = pd.factorize(np.array([r[0] for r in rows], dtype=np.int64))[0]
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    anchor = np.cumsum(size) - size + off
    right = size - off

    def around(step: int, count: np.ndarray) -> np.ndarray:
        """A row of bytes from each anchor on (step 1) or before it (step -1), zeros after count."""
        k = np.arange(count.max(initial=0))
        at = anchor[:, None] + (k if step == 1 else -1 - k)
        return np.where(k < count[:, None], data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)

    order, lcp = suffix_order(group, around(1, right), right)
    common = RangeMinimum(lcp)
    before = around(-1, off)
    position = np.empty(m, np.int64)
    position[np.lexsort((start + off, x, doc))] = np.arange(m)
    covered = np.zeros((m, off.max(initial=0) + 1), bool)
    # on: rows whose suffix from `back` bytes before the anchor stands in the order; rank: that of the anchor's suffix; kind: the same group and bytes up to the anchor
    on, rank, kind = order, np.arange(m), group[order]
    for back in range(covered.shape[1]):
        if back:
            stay = off[on] >= back
            on, rank, kind = on[stay], rank[stay], kind[stay]
            key = kind * 256 + before[on, back - 1]
            if (key[1:] < key[:-1]).any():
                by = np.argsort(key, kind="stable")
                on, rank, key = on[by], rank[by], key[by]
            kind = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(key) else key
        same = kind[1:] == kind[:-1]
        stay = np.append(False, same) | np.append(same, False) if len(kind) else np.zeros(0, bool)
        on, rank, kind = on[stay], rank[stay], kind[stay]
        if not len(on):
            break
        agree = kind[1:] == kind[:-1]
        pairs = np.flatnonzero(agree)
        agree[pairs] = common.of(rank[pairs] + 1, rank[pairs + 1]) >= length - back
        runs = np.cumsum(np.append(0, ~agree))
        hit = factors(runs, position[on], first_stays)
        covered[on[hit], back] = True
    if not first_stays:
        covered[n > 1] = False  # these contexts occur elsewhere as a whole
    edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    at = (start + off)[row]
    return list(zip(doc[row].tolist(), x[row].tolist(), (at - high).tolist(), (at - low + length).tolist()))


def _cold(length: int, first_stays: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        key = None
        for pdf in batches:
            for r in zip(*(pdf[c] for c in ("gram", "id", "x", "start", "n", "data", "off"))):
                if r[0] != key and len(held) >= BATCH:
                    yield pd.DataFrame(repeats(held, length, first_stays), columns=["id", "x", "start", "end"])
                    held = []
                key = r[0]
                held.append(r)
        if held:
            yield pd.DataFrame(repeats(held, length, first_stays), columns=["id", "x", "start", "end"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x, text): null ids as the least long, null texts as empty, x the text's hash."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), whole(text_col).alias("text"))
    return d.select("id", F.xxhash64("text").alias("x"), "text")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, first_stays: bool = True) -> DataFrame:
    """(id, x, spans): byte ranges, overlaps included, that a string of `length` bytes covers which also starts elsewhere.

    Texts are taken as UTF-8, matches stay within a text. With first_stays, only copies after the first by (id, x, start) count.

    Every window of `length` bytes has one anchor, the least gram hash in it; equal windows have equal anchors at equal places. So
    windows are compared among the contexts of one gram (the bytes of the windows that an anchor has):
    - a context that occurs more than once is repeated as a whole, and counted before any shuffle;
    - a gram with one context has no other repeats;
    - else its distinct contexts, up to GROUP, meet in suffix order, where longest previous factors tell what is repeated (see repeats);
    - for more contexts than GROUP, hashes of blocks and windows are counted instead, with no group in one task (see _crowded).
    A text shorter than `length` has no repeats; neither do empty ones. Rows equal in id and text count as copies. Time and memory
    of a text grow in proportion to its length.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    d = keyed(docs, id_col, text_col)
    marks = cut(d.mapInPandas(_marks(length), "id long, x long, pos int, start int, `end` int, gram long, ctx long"), "anchors")
    rep = F.min(F.struct("id", "x", "pos", "start", "end")).alias("rep")
    contexts = cut(marks.groupBy("gram", "ctx").agg(F.count("*").alias("n"), rep), "contexts")
    grams = contexts.groupBy("gram").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("lone")).where("m > 1" if first_stays else "m > 1 and lone > 0")
    grams = cut(grams, "grams")  # here and below: so that a join reads two plain sides, and a crowded key can be split
    settled = marks.join(contexts.where("n > 1"), ["gram", "ctx"])
    if first_stays:
        settled = settled.where(F.struct("id", "x", "pos", "start", "end") != F.col("rep"))
    spans = settled.select("id", "x", "start", "end")
    crowded = F.col("m") > GROUP
    open_ = contexts.join(grams, "gram").select("rep.*", "gram", "n", crowded.alias("crowded"))
    wanted = open_.groupBy("id", "x").agg(F.collect_list(F.struct("pos", "start", "end", "gram", "n", "crowded")).alias("wanted"))
    found = d.join(wanted, ["id", "x"]).mapInPandas(_contexts, "gram long, id long, x long, start int, n long, off int, crowded boolean, data binary")
    some = grams.where(crowded).limit(1).count() > 0
    if some:
        found = cut(found, "around")
    cold = found.where("not crowded").select("gram", "id", "x", "start", "n", "off", "data").repartition("gram").sortWithinPartitions("gram")
    spans = spans.unionByName(cold.mapInPandas(_cold(length, first_stays), "id long, x long, start int, end int"))
    if some:
        spans = spans.unionByName(_crowded(found.where("crowded").drop("crowded"), length, first_stays))
    return spans.groupBy("id", "x").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, cut at n."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["end"], n)) for s in spans if s is not None) if spans is not None else []:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, first_stays: bool = True) -> DataFrame:
    """(id, text, spans) for each row of docs: null ids are null again, null texts empty, texts without repeats have null spans."""
    spans = repeated_bytes(docs, id_col, text_col, length, first_stays)
    out = keyed(docs, id_col, text_col).join(spans, ["id", "x"], "left")
    return out.select(F.when(F.col("id") != _NONE, F.col("id")).alias("id"), "text", "spans")
