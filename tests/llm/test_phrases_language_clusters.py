"""Phrase collocations, language identification and centroid clustering on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from notegraph.llm import centroids, collocations, language

# 11


def brute_phrases(rows, least, longest, top, cover=100):
    """rows: (text, lang). The contract in plain Python."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    many = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in many.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                q = (lang, p[i : i + k])
                if 100 * a >= cover * many[q]:
                    covered.add(q)
    out = {}
    for (lang, p), a in many.items():
        if (lang, p) not in covered:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l_, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l_, r) in enumerate(sorted(x)[:top])}


def phrase_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ab", "é", "É", "x y", "ß😀", "c'", "-", "\x00", "(q)"]
    rows = [(None, None), (None, "en"), ("", "en"), (" \t\n.,", "de"), ("a a a a a", None), ("one", "xx"), ("a b " * 3000, "en"), ("b" * 5000, "en"), (". " + "a\tb  a " * 40, "und")]
    for _ in range(n):
        rows.append(("".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "!"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None])))
    return rows + rows[-3:]


@pytest.mark.parametrize("shard", [400_000, 40])
def test_phrases_equal_brute_force(spark, monkeypatch, shard):
    """Also with small blocks, gathered parts and shards, and a full sketch of few counters, which only adds candidates."""
    if shard == 40:
        for k, v in {"SHARD": 40, "GATHERED": 500, "SEGMENT": 300, "WORDS": 20, "COUNTS": 7, "LEAST_BITS": 16, "MOST_BITS": 16}.items():
            monkeypatch.setattr(collocations, k, v)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("phrase", "word", "n", "a", "block", "bucket", "rank")])
    for least, top in ((5, 2000), (12, 7)):
        got = {tuple(r) for r in collocations.collocations(df.repartition(5), least=least, top=top).collect()}
        assert got == brute_phrases(rows, least, 5, top)
    assert got
    share = {tuple(r) for r in collocations.collocations(df, least=5, cover=60).collect()}
    assert share == brute_phrases(rows, 5, 5, 2000, 60)


def test_phrases_are_counted_in_two_scans_however_many_they_are(spark, monkeypatch):
    """Candidates by the dozen for each automaton: texts are still read by the sketch and by the search only, and no flag is summed up while the driver takes it."""
    monkeypatch.setattr(collocations, "SHARD", 5)
    rows, scans, lazy = phrase_rows(3), [], []
    real, taken = DataFrame.mapInPandas, DataFrame.toLocalIterator

    def scan(self, f, *a, **k):
        scans.extend(["text"] if "text" in self.columns else [])
        return real(self, f, *a, **k)

    def take(self, *a, **k):
        lazy.append(self._jdf.queryExecution().executedPlan().toString())
        return taken(self, *a, **k)

    monkeypatch.setattr(DataFrame, "mapInPandas", scan)
    monkeypatch.setattr(DataFrame, "toLocalIterator", take)
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5).collect()}
    assert got == brute_phrases(rows, 5, 5, 2000)
    assert len(scans) == 2 and lazy and not any("MapInPandas" in plan or "Exchange" in plan for plan in lazy)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).count() == 0
    assert collocations.collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_counts_over_255_in_a_block_and_products_over_64_bits(spark):
    cells = np.repeat(np.array([3, 3 + (1 << 16), 9, 70_000], np.uint32), [1000, 255, 256, 1])
    total = Counter()
    for block, data in collocations._pack(cells, 1):
        at, n = collocations._unpack(data)
        for i, k in zip(at, n):
            total[(block - 1) // 2 * (1 << 16) + int(i)] += int(k)
    assert total == {3: 1000, 3 + (1 << 16): 255, 9: 256, 70_000: 1}
    big = spark.range(1).select(F.lit(1000).cast("decimal(4,0)").alias("k"), *[F.lit(9 * 10**14).cast("decimal(15,0)").alias(c) for c in "a"], F.lit(9 * 10**17).cast("decimal(18,0)").alias("n"))
    assert big.selectExpr("(k * a * n) div (n * cast(a as decimal(18,0)))").first()[0] == 1000


# 12


def test_gradients_of_the_network_are_right():
    rng = np.random.default_rng(1)
    net = language.start(["a", "b", "c"], rng)
    for p in (net.table, *net.filters, *net.biases, net.out, net.out_bias):
        p[...] = rng.normal(0, 0.3, p.shape)
    net = language.Network(net.langs, *[[q.astype(np.float64) for q in p] if isinstance(p, list) else p.astype(np.float64) for p in (net.table, net.filters, net.biases, net.out, net.out_bias)])
    x, y = rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint8), rng.integers(0, 3, 6)
    weight = rng.random(6)
    _, grads = language.gradients(net, x, y, weight)
    for p, g in zip(net.parameters(), grads):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(gf))[:5]:
            old, h = flat[i], 1e-6
            flat[i] = old + h
            up = language.gradients(net, x, y, weight)[0]
            flat[i] = old - h
            down = language.gradients(net, x, y, weight)[0]
            flat[i] = old
            assert abs((up - down) / (2 * h) - gf[i]) < 1e-4 * max(1, abs(gf[i]))


def test_windows_hold_every_run_of_bytes():
    k = max(language.WIDTHS)
    for n in (0, 1, 3, language.WINDOW, language.WINDOW + 1, 3 * language.WINDOW + 7):
        data = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        seen = {w.tobytes()[i : i + k] for w in language.windows(data) for i in range(language.WINDOW - k + 1)}
        assert {data[i : i + k] for i in range(n - k + 1)} <= seen and len(language.windows(data)[0]) == language.WINDOW


SYLLABLES = {"xa": ["ka", "lo", "mi", "tu"], "yb": ["sch", "ein", "ung", "ver"], "zc": ["ção", "nha", "lhe", "éu"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages_of_held_out_rows(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(language, "MAX_TEXTS", 60)
    rows = [(i, speech(rng, lang, rng.choice([3, 30, 300])), lang) for i, lang in enumerate(rng.choice(sorted(SYLLABLES)) for _ in range(400))]
    other = [(1000, None, "xa"), (1001, "", "xa"), (1002, "123 --- 4.5", "yb"), (1003, speech(rng, "zc", 30), None), (None, speech(rng, "yb", 40), None), (1004, speech(rng, "xa", 60_000), None), (rows[0][0], rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows + other, "doc_id long, text string, lang string").select("*", F.lit(1).alias("i"), F.lit(2).alias("h"), F.lit(3).alias("count"), F.lit(4).alias("score"))
    net = language.train(df)
    assert net.langs == sorted(SYLLABLES)
    got = language.identify(df, net).collect()
    assert len(got) == len(rows) + len(other) and all(0 <= r["score"] <= 1 for r in got)
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i] == lang for i, lang in held) >= 0.97 * len(held)
    assert [found[i] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "zc", "yb", "xa"]
    # What is held out changes nothing: other texts and labels there give the same network.
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    changed = df.withColumn("lang", F.when(out, F.lit("qq")).otherwise(F.col("lang"))).withColumn("text", F.when(out, F.lit("other words")).otherwise(F.col("text")))
    again = language.train(changed)
    assert again.langs == net.langs and all((a == b).all() for a, b in zip(net.parameters(), again.parameters()))


def test_languages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.train(none) is None and language.identify(none, None).count() == 0
    few = spark.createDataFrame([(1, "words", None), (2, None, "xa")], "doc_id long, text string, lang string")
    assert language.train(few) is None
    assert {tuple(r) for r in language.identify(few, None).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}


# 13


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    c = [q for _, q in starts]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        c = [[sum(q[d] for (_, q), a in zip(kept, at) if a == j) // at.count(j) for d in range(dims)] if j in at else x for j, x in enumerate(c)]
    found = [(i, *near(q)) for i, q in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


@pytest.mark.parametrize("hot", [200, 3])
def test_clusters_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(centroids, "HOT_PART", hot)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(80)]
    rows += [(100 + i, rows[5][1]) for i in range(60)]  # one vector of many rows
    rows += [(7, rows[9][1]), (7, [0.0] * 4), (None, [1.0] * 4), (300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (304, [1.0] * 3), (305, []), (306, [1e4, -1e4, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("q", "n", "cluster", "distance", "_id")])
    for k, rounds in ((5, 3), (16, 1), (500, 2)):
        got = Counter(map(tuple, centroids.clusters(df.repartition(4), k=k, rounds=rounds, dims=4).collect()))
        assert got == brute_clusters(rows, k, rounds, 4)
    assert centroids.clusters(df.limit(0), dims=4).count() == 0
    assert centroids.clusters(df.where("vec_id = 300"), dims=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        centroids.clusters(spark.createDataFrame([(1, [1e8] * 4)], "vec_id long, embedding array<double>"), dims=4).count()
