"""Rectangles of a document's pictures, merged where they are near, and the record of a conversion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rect = tuple[float, float, float, float]


def _near(a: Rect, b: Rect, gap: float) -> bool:
    """Whether a, grown by gap on all sides, overlaps b; touching is not enough, and nothing overlaps an empty b."""
    solid = b[0] < b[2] and b[1] < b[3]
    return solid and max(a[0] - gap, b[0]) < min(a[2] + gap, b[2]) and max(a[1] - gap, b[1]) < min(a[3] + gap, b[3])


def merge_rects(rects: list[Rect], gap: float = 30.0) -> list[Rect]:
    """Passes over rects until none merges: each that is left takes the later ones near to it, as it was before the pass, into one box."""
    while True:
        left, out = list(rects), []
        while left:
            first, rest = left[0], left[1:]
            hits = [r for r in rest if _near(first, r, gap)]
            left = [r for r in rest if not _near(first, r, gap)]
            box = list(zip(first, *hits))
            out.append((min(box[0]), min(box[1]), max(box[2]), max(box[3])))
        if len(out) == len(rects):
            return out
        rects = out


def merged_rects(df: DataFrame, page: str, gap: float = 30.0) -> DataFrame:
    """(page, x0, y0, x1, y1) merged within each page of df (page, place, x0, y0, x1, y1), in order of place. A page's rectangles are few."""
    sides = ["x0", "y0", "x1", "y1"]
    kind = df.schema[page].dataType.simpleString()

    def one(key, pdf):
        out = pd.DataFrame(merge_rects([tuple(r) for r in pdf.sort_values("place")[sides].itertuples(index=False)], gap), columns=sides)
        out.insert(0, page, key[0])
        return out

    doubles = [F.col(c).cast("double").alias(c) for c in sides]
    return df.select(page, "place", *doubles).groupBy(page).applyInPandas(one, f"{page} {kind}, " + ", ".join(f"{c} double" for c in sides))


def manifest(source: Column, pages: Column, images: Column, transcript: Column, large: int = 100) -> Column:
    """The record of a converted source as JSON; more pages than `large` make it a large one."""
    kind = F.lower(F.regexp_extract(source, r"\.([^./]+)$", 1))
    return F.to_json(F.struct(source.alias("source"), kind.alias("format"), F.coalesce(pages, F.lit(0)).alias("pages"), (F.coalesce(pages, F.lit(0)) > large).alias("large_doc"), images.alias("images"), transcript.alias("transcript")), {"ignoreNullFields": "false"})
