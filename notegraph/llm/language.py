"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole
from .toxicity import held_out

#: Texts that each language is learnt from, at most, and windows of each of these texts.
MAX_TEXTS, MAX_WINDOWS = 1_000, 4
#: Languages that can be learnt, the most frequent ones, so that the sample has a bound.
MAX_LANGS = 200
#: Bytes of a window. The next one starts so that each filter sees every run of bytes of the text.
WINDOW = 192
#: Values of a byte's vector, widths of the filters, and filters of each width.
DEPTH, WIDTHS, FILTERS = 8, (2, 3, 4), 16
#: Windows that are scored together.
BATCH = 512
UNKNOWN = "und"


@dataclass
class Network:
    """Byte vectors, each width's filters with biases, and the weights of the softmax; langs in ascending order."""

    langs: list[str]
    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.biases, self.out, self.out_bias]


def windows(data: bytes) -> np.ndarray:
    """All windows of a text, a row each; the last one ends with zeros. An empty text has one window of zeros."""
    step = WINDOW - (max(WIDTHS) - 1)
    n = max(1, -(-(len(data) - (max(WIDTHS) - 1)) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def start(langs: list[str], rng: np.random.Generator) -> Network:
    table = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
    filters = [rng.normal(0, (2 / (k * DEPTH)) ** 0.5, (k * DEPTH, FILTERS)).astype(np.float32) for k in WIDTHS]
    out = rng.normal(0, (1 / (len(WIDTHS) * FILTERS)) ** 0.5, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
    return Network(langs, table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, np.zeros(len(langs), np.float32))


def _runs(vectors: np.ndarray, k: int) -> np.ndarray:
    """(windows, places, k * DEPTH): the vectors of each run of k bytes, side by side."""
    b, n, d = vectors.shape
    return np.lib.stride_tricks.as_strided(vectors, (b, n - k + 1, k * d), (vectors.strides[0], d * vectors.itemsize, vectors.itemsize))


def forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(probabilities, pooled values, places of the maxima, byte vectors) of windows."""
    vectors = net.table[x]
    pooled, places = [], []
    for k, f, bias in zip(WIDTHS, net.filters, net.biases):
        runs = _runs(vectors, k)
        z = (runs.reshape(-1, runs.shape[2]) @ f).reshape(runs.shape[0], runs.shape[1], FILTERS)
        at = z.argmax(1)
        places.append(at)
        pooled.append(np.maximum(np.take_along_axis(z, at[:, None, :], 1)[:, 0, :] + bias, 0))
    h = np.concatenate(pooled, 1)
    logits = h @ net.out + net.out_bias
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True), h, places, vectors


def predict(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities of windows, without what training needs."""
    vectors = net.table[x]
    pooled = []
    for k, f, bias in zip(WIDTHS, net.filters, net.biases):
        runs = _runs(vectors, k)
        z = (runs.reshape(-1, runs.shape[2]) @ f).reshape(runs.shape[0], runs.shape[1], FILTERS)
        pooled.append(np.maximum(z.max(1) + bias, 0))
    logits = np.concatenate(pooled, 1) @ net.out + net.out_bias
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted mean cross entropy of windows, and its gradient by each parameter. Only the run at a maximum counts."""
    p, h, places, vectors = forward(net, x)
    w = weight / weight.sum()
    rows = np.arange(len(x))
    loss = float(-(w * np.log(np.maximum(p[rows, y], 1e-12))).sum())
    d = p.copy()
    d[rows, y] -= 1
    d *= w[:, None]
    back = (d @ net.out.T) * (h > 0)
    table = np.zeros_like(net.table)
    g_filters, g_biases = [], []
    for i, (k, f) in enumerate(zip(WIDTHS, net.filters)):
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        runs = _runs(vectors, k)[rows[:, None], places[i]]  # (windows, FILTERS, k * DEPTH)
        g_filters.append(np.einsum("bf,bfd->df", part, runs))
        g_biases.append(part.sum(0))
        to_runs = (part[:, :, None] * f.T[None]).reshape(len(x), FILTERS, k, DEPTH)
        at = x[rows[:, None, None], places[i][:, :, None] + np.arange(k)]
        np.add.at(table, at.ravel(), to_runs.reshape(-1, DEPTH))
    return loss, [table, *g_filters, *g_biases, h.T @ d, d.sum(0)]


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 1_200, batch: int = 96, rate: float = 4e-3, seed: int = 7) -> Network:
    """A network fitted by Adam with a falling rate; languages weigh alike, however many windows each has."""
    rng = np.random.default_rng(seed)
    net = start(langs, rng)
    share = np.bincount(y, minlength=len(langs))
    weight = (1 / np.maximum(share, 1))[y].astype(np.float32)
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        some = rng.integers(0, len(x), batch)
        _, grads = gradients(net, x[some], y[some], weight[some])
        step = rate * min(1.0, 2 * (1 - (t - 1) / steps))
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network of the languages that rows outside the held-out fold name; None where there are none.

    Of each language at most MAX_TEXTS texts with letters are taken, by the hashes of their texts, and of each MAX_WINDOWS
    windows, spread evenly; of more than MAX_LANGS languages the most frequent. These bounds hold at every size; the sample
    is cut to a multiple of the bound by hashes first, so no language is ranked whole by one task. Null ids count as the empty id.
    """
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), whole(text_col).alias("text"))
    known = known.where(F.regexp_like("text", F.lit(r"\p{L}")))
    per = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    sizes = {r["lang"]: r["count"] for r in per.collect()}
    if not sizes:
        return None
    span = 1 << 30
    upto = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(span, 4 * MAX_TEXTS * span // n + 1))])
    h = F.xxhash64("text")
    some = known.withColumn("h", h).where(F.pmod("h", F.lit(span)) < F.coalesce(F.try_element_at(upto, F.col("lang")), F.lit(0)))
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))  # a text counts once
    picked = some.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h"))).where(F.col("i") <= MAX_TEXTS)
    sample = picked.mapInPandas(_samples, "lang string, i int, w array<binary>").orderBy("lang", "i").toPandas()
    langs = sorted(sizes)
    x = np.array([np.frombuffer(w, np.uint8) for ws in sample["w"] for w in ws])
    y = np.repeat([langs.index(lang) for lang in sample["lang"]], [len(ws) for ws in sample["w"]])
    return fit(x, y, langs) if len(x) else None


def _samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            all_ = windows(text.encode("utf-8", "surrogatepass"))
            at = np.unique(np.linspace(0, len(all_) - 1, MAX_WINDOWS).astype(int))
            out.append([w.tobytes() for w in all_[at]])
        yield pd.DataFrame({"lang": pdf["lang"], "i": pdf["i"].astype("int32"), "w": out})


def identifier(net: Network | None):
    """A column function of (lang_pred, score): the language with the greatest mean probability over all windows of a text, weighed by their bytes.

    A text without a letter, a null one, or any text without a network is `und`, with score 0. Ties go to the first language in order.
    """

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            sums = np.zeros((len(texts), len(net.langs) if net else 0))

            def flush(texts_of=held, sums=sums) -> None:
                if not texts_of:
                    return
                of = np.repeat([i for i, _, _ in texts_of], [len(w) for _, w, _ in texts_of])
                x, weight = np.concatenate([w for _, w, _ in texts_of]), np.concatenate([b for _, _, b in texts_of])
                texts_of.clear()
                for a in range(0, len(x), BATCH):
                    part = slice(a, a + BATCH)
                    np.add.at(sums, of[part], predict(net, x[part]).astype(np.float64) * weight[part, None])

            n = 0
            for i, text in enumerate(texts):
                if net is None or not any(map(str.isalpha, text)):
                    continue
                data = text.encode("utf-8", "surrogatepass")
                for a in range(0, len(data), 1 << 20):  # a very long text in parts, each with the bytes before that a filter needs
                    w = windows(data[max(0, a - max(WIDTHS) + 1) : a + (1 << 20)])
                    held.append((i, w, np.maximum((w > 0).sum(1), 1)))
                    n += len(w)
                    if n >= 4 * BATCH:
                        flush()
                        n = 0
                pred[i] = ""
            flush()
            for i in range(len(texts)):
                if pred[i] == "":
                    best = int(sums[i].argmax())
                    pred[i], score[i] = net.langs[best], min(1.0, sums[i][best] / sums[i].sum())
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return run


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row, repeated ones too; other columns don't matter."""
    found = docs.select(F.col(id_col), identifier(net)(whole(text_col)).alias("_ng_found"))
    return found.select(id_col, "_ng_found.lang_pred", "_ng_found.score")
