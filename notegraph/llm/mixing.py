"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole, words

#: Cells up to which the raking runs in one row of arrays; more are raked as a table, by the same steps to the same weights.
IN_A_ROW = 4_096


def topic_of(ws: Column, topics: int = 8) -> Column:
    """A stand-in where no topic is given: a class by the longest of the text's words (ties: the last in order); without words 't-'."""
    best = F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.when(F.size(ws) > 0, F.concat(F.lit("t"), F.pmod(F.xxhash64(best), F.lit(topics)).cast("string"))).otherwise(F.lit("t-"))


def _rake_table(cells: DataFrame, margins: list[str], target: Callable[[Column], Column], rounds: int) -> DataFrame:
    """What rake gives, by sums over the table of cells and joins; each round is written."""
    w = cells.select(*margins, "_tokens", F.col("_tokens").cast("double").alias("_weight"))
    every = w.agg(F.sum("_weight")).first()[0]
    wanted = []
    for m in margins:
        raw = cut(w.groupBy(m).agg(F.sum("_weight").alias("_s")).select(m, target(F.col("_s") / F.greatest(F.lit(every), F.lit(1.0))).alias("_raw")), "margin")
        wanted.append(raw.select(m, (F.col("_raw") * every / F.greatest(F.lit(raw.agg(F.sum("_raw")).first()[0]), F.lit(1e-300))).alias("_want")))
    for _ in range(rounds):
        for m, want in zip(margins, wanted):
            scale = w.groupBy(m).agg(F.sum("_weight").alias("_s")).join(want, m).select(m, F.when(F.col("_s") > 0, F.col("_want") / F.col("_s")).otherwise(0.0).alias("_by"))
            w = w.join(scale, m).withColumn("_weight", F.col("_weight") * F.col("_by")).drop("_by")
        w = cut(w.select(*margins, "_tokens", "_weight"), "raked")
    rate = F.when(F.col("_tokens") > 0, F.col("_weight") / F.col("_tokens")).otherwise(0.0)
    most = max(w.agg(F.max(rate)).first()[0], 1e-300)
    return w.select(*margins, F.col("_tokens").cast("double").alias("_tokens"), "_weight", (rate / most).alias("_rate"))


def rake(cells: DataFrame, margins: list[str], target: Callable[[Column], Column], rounds: int = 30) -> DataFrame:
    """cells (margins..., _tokens) with `_weight` and `_rate`: weights are tokens scaled until each margin's shares meet its targets.

    target makes a category's wanted share, before shares are brought to sum 1, from its present one. `_rate` is weight by
    tokens, scaled so that the largest is 1. Each round scales every margin in turn by wanted over present sum. All categories
    count on their own. Up to IN_A_ROW cells are gathered into one row of arrays, more stay a table (_rake_table). Margins that can't be met
    together end at the last one's targets. cells is read several times. No cells: no rows.
    """
    if cells.limit(IN_A_ROW + 1).count() > IN_A_ROW:
        return _rake_table(cells, margins, target, rounds)
    k = len(margins)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    row = cells.agg(F.sort_array(F.collect_list(F.struct(*margins, F.col("_tokens").cast("double").alias("n")))).alias("_c"))
    row = row.select("_c", *[F.array_distinct(F.col("_c")[m]).alias(f"_names{i}") for i, m in enumerate(margins)])

    def sums(w: Column, at: Column, names: Column) -> Column:
        """The sum of w for each name; at: each weight's place in names."""
        both = F.arrays_zip(w.alias("w"), at.alias("i"))
        return F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.aggregate(both, F.lit(0.0), lambda a, x: a + F.when(x["i"] == n, x["w"]).otherwise(F.lit(0.0))))

    def places(i: int, m: str) -> Column:
        return F.transform(F.col("_c")[m], lambda x: F.array_position(F.col(f"_names{i}"), x).cast("int"))

    def wanted(i: int) -> Column:
        return F.transform(f"_raw{i}", lambda x: x * F.col("_all") / F.greatest(F.col(f"_sum{i}"), F.lit(1e-300)))

    def scaled(w: Column, s: Column, i: int) -> Column:
        return F.zip_with(w, F.col(f"_at{i}"), lambda x, at: F.when(F.get(s, at - 1) > 0, x * F.get(F.col(f"_want{i}"), at - 1) / F.get(s, at - 1)).otherwise(F.lit(0.0)))

    row = row.where(F.size("_c") > 0).select("*", F.col("_c")["n"].alias("_n"), *[places(i, m).alias(f"_at{i}") for i, m in enumerate(margins)])
    row = row.select("*", total(F.col("_n")).alias("_all")).select("*", *[F.transform(sums(F.col("_n"), F.col(f"_at{i}"), F.col(f"_names{i}")), lambda x: target(x / F.greatest(F.col("_all"), F.lit(1.0)))).alias(f"_raw{i}") for i in range(k)])
    row = row.select("*", *[total(F.col(f"_raw{i}")).alias(f"_sum{i}") for i in range(k)])
    row = row.select("*", *[wanted(i).alias(f"_want{i}") for i in range(k)])

    def step(acc: Column, t: Column) -> Column:
        """Even steps sum a margin, odd steps scale by it."""
        w, s = acc["w"], acc["s"]
        summed, out = s, w
        for i in range(k):
            summed = F.when(t % (2 * k) == 2 * i, sums(w, F.col(f"_at{i}"), F.col(f"_names{i}"))).otherwise(summed)
            out = F.when(t % (2 * k) == 2 * i + 1, scaled(w, s, i)).otherwise(out)
        return F.struct(out.alias("w"), summed.alias("s"))

    start = F.struct(F.col("_n").alias("w"), F.array().cast("array<double>").alias("s"))
    row = row.select("*", F.aggregate(F.sequence(F.lit(0), F.lit(2 * k * rounds - 1)), start, step)["w"].alias("_w"))
    row = row.select("*", F.zip_with("_w", "_n", lambda w, n: F.when(n > 0, w / n).otherwise(F.lit(0.0))).alias("_r"))
    row = row.select("*", F.greatest(F.array_max("_r"), F.lit(1e-300)).alias("_max"))
    out = F.transform(F.arrays_zip("_c", "_w", "_r"), lambda x: F.struct(*[x["_c"][m].alias(m) for m in margins], x["_c"]["n"].alias("_tokens"), x["_w"].alias("_weight"), (x["_r"] / F.col("_max")).alias("_rate")))
    return row.select(F.inline(out))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", temper: float = 0.7, seed: int = 17, rounds: int = 30) -> DataFrame:
    """docs with `_topic`, `_tokens` (words), `_p` and `_kept`: a document is kept with its cell's calibrated probability.

    Token weights are raked to the source, language and topic marginals raised to the power `temper` (0: even shares,
    1: as found). A cell's probability is its raked weight by its tokens, scaled so that the largest is 1: then kept
    tokens meet the marginals in expectation, and nothing is repeated. A document's draw depends on its id, text and the
    seed only, so a rerun draws the same. Null categories count as '(none)'; texts without words have weight 1; an empty
    table gives no rows. Columns of docs with the four new names are replaced.
    """
    margins = ["_ng_source", "_ng_lang", "_topic"]
    named = {"_ng_source": F.coalesce(F.col(source_col), F.lit("(none)")), "_ng_lang": F.coalesce(F.col(lang_col), F.lit("(none)"))}
    marked = docs.withColumns(named).withColumn("_ng_words", words(whole(text_col)))
    marked = marked.withColumns({"_topic": topic_of(F.col("_ng_words")), "_tokens": F.greatest(F.size("_ng_words"), F.lit(1)).cast("long")}).drop("_ng_words")
    cells = cut(marked.groupBy(*margins).agg(F.sum("_tokens").alias("_tokens")), "cells")
    rates = cut(rake(cells, margins, lambda share: F.pow(share, F.lit(temper)), rounds).select(*margins, F.col("_rate").alias("_p")), "rates")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    out = marked.join(rates, margins, "left").withColumn("_kept", draw < F.col("_p"))
    return out.drop("_ng_source", "_ng_lang")
