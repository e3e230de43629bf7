"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole

#: Lines of a gram, and grams of a window: each repeated run of GRAM + WINDOW - 1 lines holds a fingerprint; in windows of one gram, each gram is.
GRAM, WINDOW = 2, 1
#: Words that make a line a fingerprint of its own.
LONG = 50


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the minima (ties: the rightmost) of all windows; of fewer hashes than a window, of them all."""
    out: list[int] = []
    for s in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[s : s + window]
        at = s + max(i for i, h in enumerate(part) if h == min(part))
        if not out or out[-1] != at:
            out.append(at)
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, x, text in zip(pdf["id"], pdf["x"], pdf["text"]):
            lines = [(i, _signed(xxhash.xxh3_64_intdigest(line)), len(line) >= 2 * LONG - 1 and len(line.split()) >= LONG) for i, line in enumerate(text.split("\n")) if line.strip()]
            hs = [h for _, h, _ in lines]
            k = min(GRAM, len(hs))
            grams = [xxhash.xxh3_64_intdigest(repr((len(hs) < GRAM, hs[i : i + k]))) for i in range(len(hs) - k + 1)] if hs else []
            for p in winnow(grams, WINDOW):
                out.append((doc, x, p, _signed(grams[p]), [i for i, _, _ in lines[p : p + k]]))
            out += [(doc, x, p, _signed(xxhash.xxh3_64_intdigest(repr(h))), [i]) for p, (i, h, long) in enumerate(lines) if long]
        yield pd.DataFrame(out, columns=["id", "x", "pos", "gram", "lines"]).astype({"id": pdf["id"].dtype})


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x, gone): the places of lines in each text that repeat an earlier run; x is the text's hash.

    Lines that aren't blank are hashed; GRAM successive ones make a gram, and of each window of grams the least hash
    is a fingerprint: all of them, as windows have one gram. A line of LONG words or more is a fingerprint of its own, whatever its neighbours.
    A text of fewer lines than a gram has all its lines as one. All occurrences but the first, by (id, x, place), lose their lines. So each later
    copy of a run of GRAM lines or more, and of a line of LONG words or more, goes whole, wherever its parts occurred first.
    Null ids come first; rows equal in id and text count as one and keep their lines.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).select("id", F.xxhash64("text").alias("x"), "text")
    has_id = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    kind = "id long, x long, pos int, gram long, lines array<int>"
    marks = cut(ids.withColumn("id", has_id).mapInPandas(_fingerprints, kind), "line-marks")
    first = marks.groupBy("gram").agg(F.min(F.struct("id", "x", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = first.select("gram", F.col("f.id").alias("first_id"), F.col("f.x").alias("first_x"), F.col("f.pos").alias("first_pos"))
    later = marks.join(first, "gram").where("id <> first_id or x <> first_x or pos <> first_pos")
    gone = later.groupBy("id", "x").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))
    return gone.select(F.when(F.col("id") > -(1 << 63), F.col("id")).alias("id"), "x", "gone")


def _without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Each text less the lines at the places of gone; in time that grows with the text, however many go. Null where there are none to go."""
    out = []
    for t, places in zip(text, gone):
        if t is None:
            out.append(None)
        else:
            some = set(places)
            out.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in some))
    return pd.Series(out, dtype=object)


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated line runs deleted from the text; `_n_lines` and `_n_gone` count lines.

    The first copy and blank lines stay. A null text stays null; all rows and other columns stay, but columns of those two names are replaced. Empty table: no rows.
    A long text is one row of a small batch; its lines are looked up in a set, once each.
    """
    gone = repeated_lines(docs, id_col, text_col).select(F.col("id").alias("_ng_id"), F.col("x").alias("_ng_of"), F.col("gone").alias("_ng_gone"))
    # The join of a full row with its list; both keys are unique to a text, so none is hot.
    joined = docs.withColumn("_ng_x", F.xxhash64(whole(text_col))).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_ng_id")) & (F.col("_ng_x") == F.col("_ng_of")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    some = F.col("_ng_gone").isNotNull()
    kept = F.pandas_udf(_without_lines, "string")(F.when(some, whole(text_col)), F.col("_ng_gone"))  # other texts aren't sent to Python
    counts = {"_n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "_n_gone": F.when(some, F.size("_ng_gone")).otherwise(0).cast("long")}
    kept_columns = [F.when(some, kept).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counts]
    return joined.select(*kept_columns, *[v.alias(c) for c, v in counts.items()])
