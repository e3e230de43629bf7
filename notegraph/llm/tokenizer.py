"""Byte-level BPE encoding and decoding by dynamic programming over prefixes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, whole

#: Encoded pieces and checked pairs that a worker remembers at most; older ones are worked out again.
REMEMBERED = 300_000


class Vocabulary:
    """Ranks of byte strings, and what follows from them: which tokens and pairs are stable under the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=1)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._new: dict[str, tuple[str, int]] = {}
        self._old: dict[str, tuple[str, int]] = {}

    @classmethod
    def load(cls, data: bytes, pattern: str) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}, pattern)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for single bytes, and for tokens that the merges never make."""
        if token not in self._halves:
            parts, last = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))], None
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    last = None
                    break
                last = self.ranks[parts[i]], self.ranks[parts[i + 1]]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = last
        return self._halves[token]

    def alone(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def pair(self, a: int, b: int) -> bool:
        """Whether the merges leave these two tokens as they are."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2 * REMEMBERED:
                self._pairs.clear()
            known = self._pairs[key] = self.alone(a) and self.alone(b) and self.apart(a, b)
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes first.

        Goes back in time: the later of the two tokens' last merges is undone, which leaves the parts that met at the
        border before it; a merge of these wins if its rank is lower than that of what was undone (the same rank: leftmost first).
        """
        before = 1 << 60
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < before:
                return False
            x, y = self.halves(a), self.halves(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and a > b):
                before, a = a, x[1]
            else:
                before, b = b + 1, y[0]

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fill last[i], for i from start + 1: the last token of the encoding of data's first i bytes. It is the only token
        that ends there, fits the last token before it, and has a stable pair with it. last[0] is -1."""
        ranks, longest, known, pair = self.ranks.get, self.longest, self._pairs.get, self.pair
        for i in range(start + 1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                t = ranks(data[j:i])
                if t is None:
                    continue
                if j:
                    fits = known(last[j] << 32 | t)
                    if fits is None:
                        fits = pair(last[j], t)
                else:
                    fits = self.alone(t)
                if fits:
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; one that is itself a token is that token."""
        if (whole_piece := self.ranks.get(data)) is not None:
            return [whole_piece]
        last = [-1]
        self.extend(data, last, 0)
        return self.walk(last)

    def walk(self, last: list[int]) -> list[int]:
        """Ids from a table of last tokens."""
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def text(self, text: str) -> tuple[str, int]:
        """Decimal ids joined by commas, and their number."""
        new, old, out, n = self._new, self._old, [], 0
        for p in self.split(text):
            got = new.get(p)
            if got is None:
                got = old.get(p)
                if got is None:
                    ids = self.piece(p.encode())
                    got = ",".join(map(str, ids)), len(ids)
                if len(new) >= REMEMBERED:
                    self._old = old = new
                    self._new = new = {}
                if len(p) < 100:
                    new[p] = got
            out.append(got[0])
            n += got[1]
        return ",".join(out), n

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Editable:
    """An encoded text that can be appended to and edited, with exact ids at any time.

    Each match of the pattern has its table of last tokens. A change keeps the matches that it can't reach, re-splits
    from two matches before it, and stops where the split meets the old one again.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.v, self.pieces, self.tables = vocabulary, [], []
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        out: list[int] = []
        for p, last in zip(self.pieces, self.tables):
            whole_piece = self.v.ranks.get(p.encode())
            out += [whole_piece] if whole_piece is not None else self.v.walk(last)
        return out

    def append(self, more: str) -> None:
        n = sum(map(len, self.pieces))
        self.replace(n, n, more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new in place of the code points from start to end."""
        at, i = 0, 0
        while i < len(self.pieces) and at + len(self.pieces[i]) < start:
            at += len(self.pieces[i])
            i += 1
        for _ in range(2):
            if i:
                i -= 1
                at -= len(self.pieces[i])
        old_at, tail = at, {}
        for j in range(i, len(self.pieces)):  # places, counted from the end, where old matches begin
            tail[old_at] = j
            old_at += len(self.pieces[j])
        total = old_at
        rest = "".join(self.pieces[i:])
        text = rest[: start - at] + new + rest[end - at :]
        shift = len(new) - (end - start)
        pieces, tables, here = [], [], at
        for m in self.v.split(text):
            j = tail.get(here - shift)
            if here >= start + len(new) and j is not None and self.pieces[j] == m:
                pieces += self.pieces[j:]
                tables += self.tables[j:]
                break
            data, last = m.encode(), [-1]
            k = i + len(pieces)
            if k < len(self.pieces):  # a longer form of the old match keeps the table of their common prefix
                a = self.pieces[k].encode()
                common = next((x for x, (p, q) in enumerate(zip(a, data)) if p != q), min(len(a), len(data)))
                last = self.tables[k][: common + 1]
            self.v.extend(data, last, len(last) - 1)
            pieces.append(m)
            tables.append(last)
            here += len(m)
        assert total >= 0
        self.pieces[i:], self.tables[i:] = pieces, tables


def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file's bytes, loaded once in each worker; with the words it remembers it is some 100 MB, until let_go."""
    key = "vocabulary", hash((data, pattern))
    if key not in HELD:
        HELD.clear()
        HELD[key] = Vocabulary.load(data, pattern)
    return HELD[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """id_cols, ids, n_tokens, decoded for each row: decimal ids joined by commas, their number, the bytes they decode to.

    ranks: the bytes of a rank file (token in base64, space, rank on each line), whose size doesn't follow the data; they
    go to the workers with the function. A null or empty text has no ids; null ids and repeated rows keep a row each.
    """
    names = [f"_c{i}" for i in range(len(id_cols))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(ranks, pattern)
        back = {str(i): b for i, b in v.bytes_of.items()}
        for pdf in batches:
            coded = [v.text(t) for t in pdf["_text"]]
            decoded = [b"".join(map(back.__getitem__, ids.split(","))) if n else b"" for ids, n in coded]
            yield pdf[names].assign(ids=[c[0] for c in coded], n_tokens=[c[1] for c in coded], decoded=decoded)

    d = docs.select(*[F.col(c).alias(n) for c, n in zip(id_cols, names)], whole(text_col).alias("_text"))
    kinds = ", ".join(f"{n} {d.schema[n].dataType.simpleString()}" for n in names)
    return d.mapInPandas(run, f"{kinds}, ids string, n_tokens long, decoded binary").withColumnsRenamed(dict(zip(names, id_cols)))
