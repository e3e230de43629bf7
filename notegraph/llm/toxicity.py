"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let_go, whole

#: Bounds of the sample that the classifier is fitted on: confirmed toxic texts, and texts taken as unlabelled.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 6_000
#: Features of the linear classifier, at most: words and their beginnings of these lengths, by the number of distinct words
#: of a text that have them, if at least this share of the positives does, and if positives, by the prior, make up this part
#: of the unlabelled texts that do.
FEATURES, STEMS, SHARE, PURITY = 500, (4, 5, 6), 0.02, 0.2
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that nothing is learnt from (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(word: str) -> list[int]:
    """Ids of a word's features: itself and its stems."""
    data = word.encode("utf-8", "surrogatepass")
    return [zlib.crc32(data), *[zlib.crc32(b"%d:" % n + word[:n].encode("utf-8", "surrogatepass")) for n in STEMS if len(word) > n]]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids = [np.unique(np.array([f for w in set(_WORD.findall(t.lower())) for f in features(w)], dtype=np.uint32), return_counts=True) for t in pdf["_text"]]
        yield pd.DataFrame({"positive": pdf["positive"], "f": [i.view(np.int32).tolist() for i, _ in ids], "n": [np.minimum(n, 255).astype(np.int32).tolist() for _, n in ids]})


def _chosen(chosen: np.ndarray):
    """Places in `chosen`, ids of features, of those that a text has, and their counts."""
    order = np.argsort(chosen)
    ascending = chosen[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _counts(batches):
            at, n = [], []
            for f, count in zip(pdf["f"], pdf["n"]):
                used = np.isin(f, ascending)
                at.append(order[np.searchsorted(ascending, np.array(f, np.int32)[used])].astype(np.int16))
                n.append(np.array(count, np.int32)[used])
            yield pd.DataFrame({"positive": pdf["positive"], "at": at, "n": n})

    return run


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier with the least non-negative positive-unlabelled risk.

    Risk: prior * E+[loss(1)] + max(0, Eu[loss(-1)] - prior * E+[loss(-1)]), logistic loss. Where the part in max is below
    zero, a step goes against its gradient, so it can't be driven down by fitting the unlabelled positives. Adam, all rows each step.
    """
    xp, xu = positive.astype(np.float32), unlabelled.astype(np.float32)
    w, b = np.zeros(xp.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        gu, gp = su / len(su), prior * sp / len(sp)  # of loss(-1)
        part = np.append(xu.T @ gu - xp.T @ gp, gu.sum() - gp.sum())
        if negative < 0:
            g = -part
        else:
            up = prior * (sp - 1) / len(sp)  # of loss(1)
            g = np.append(xp.T @ up, up.sum()) + part
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - np.float32(step[-1])
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[int, float], float]:
    """Feature weights and bias. Rows that are held out are neither labelled nor unlabelled examples.

    Positives are texts labelled 1; of all other texts nothing but the words is known. The class prior is the share of 1
    among the labels that may be learnt from. The sample is bounded by MAX_POSITIVE and MAX_UNLABELLED rows, chosen by
    their ids' hashes, whatever the size of the table. Features are the FEATURES with the highest
    frequency times log-odds among positives against unlabelled texts. Without positives: no weights, and the bias of a score near 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.count_if("toxic")).first()
    if not n_toxic:
        return {}, -10.0
    prior = min(max(n_toxic / n, 1e-3), 0.5)
    order = [F.xxhash64("_id"), F.col("_id")]
    free = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"))
    picked = known.where("toxic").select("_id").distinct().orderBy(*order).limit(MAX_POSITIVE).withColumn("positive", F.lit(True))
    picked = picked.unionByName(free.orderBy(*order).limit(MAX_UNLABELLED).withColumn("positive", F.lit(False)))
    picked = cut(picked, "toxicity-picked")
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).join(F.broadcast(picked), "_id").select("positive", "_text")
    have = {bool(r[0]): r[1] for r in rows.groupBy("positive").count().collect()}
    if len(have) < 2:
        return {}, -10.0
    # Features are counted and sifted in tasks, so that the driver gets those that may be chosen, and then only the chosen ones of each text.
    each = rows.mapInPandas(_counts, "positive boolean, f array<int>, n array<int>").select("positive", F.explode("f").alias("f"))
    seen = each.groupBy("f").agg(F.count_if("positive").alias("n_p"), F.count_if(~F.col("positive")).alias("n_u"))
    seen = seen.where(F.col("n_p") >= max(3, SHARE * have[True])).toArrow().sort_by("f")
    ids, n_p, n_u = (seen[c].to_numpy() for c in ("f", "n_p", "n_u"))
    rate_p, rate_u = n_p / have[True], (n_u + 0.5) / have[False]
    gain = np.where(prior * rate_p >= PURITY * rate_u, rate_p * np.log(rate_p / rate_u), -1.0)
    best = np.lexsort((ids, -gain))[:FEATURES]
    best = best[gain[best] > 0]
    sample = rows.mapInPandas(_chosen(ids[best]), "positive boolean, at array<short>, n array<int>").toArrow()
    is_p = sample["positive"].to_numpy().astype(bool)
    lists = sample["at"].combine_chunks()
    row = np.repeat(np.arange(len(sample)), lists.value_lengths().to_numpy())
    x = np.zeros((len(sample), len(best)), np.float32)
    x[row, lists.flatten().to_numpy()] = sample["n"].combine_chunks().flatten().to_numpy()
    w, b = fit(x[is_p], x[~is_p], prior)
    grid = 1 << 20  # on a grid sums are exact, so the order of words doesn't matter
    return {int(i) & 0xFFFFFFFF: round(float(v) * grid) / grid for i, v in zip(ids[best], w)}, round(b * grid) / grid


def scorer(weights: dict[int, float], bias: float):
    """A column function of a text's score: how likely label 1 is, by its distinct words."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        known: dict[str, float] = {}
        for texts in batches:
            z = np.full(len(texts), bias)
            for k, t in enumerate(texts):
                for w in set(_WORD.findall(t.lower())):
                    v = known.get(w)
                    if v is None:
                        if len(known) > 300_000:
                            known.clear()
                        v = known[w] = sum(weights.get(f, 0.0) for f in features(w))
                    if v:
                        z[k] += v
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return run


def score(docs: DataFrame, weights: dict[int, float], bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, repeated ones too; a text without words, or null, scores by the bias."""
    return docs.select(F.col(id_col), scorer(weights, bias)(whole(text_col)).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs less those that score threshold or more; the other rows stay as they are, null and repeated ones too."""
    weights, bias = train(docs, labels, id_col, text_col)
    return docs.where(scorer(weights, bias)(whole(text_col)) < threshold)
