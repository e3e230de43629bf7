"""Each stage of corpus_pipeline, run() and some queries against plain Python versions, on small tables with awkward rows."""

import base64
import gc
import hashlib
import math
import random
import re
import weakref
from collections import Counter
from itertools import combinations

import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from notegraph.llm import line_dedup, near_dedup, queries, sharding, tokenizer, toxicity

from test_llm import awkward, brute_components, brute_fingerprint, prose, signed

#: Names that clash with those inside the operators.
CLASH = ("id", "x", "n", "pos", "hash", "u", "v", "key", "gone", "rep", "positive", "toxic", "component_id", "ids", "n_tokens", "decoded", "f0", "words", "lines")
BAD = ["vileword", "slurword", "hateword", "filthword", "scumword"]


def corpus(seed=3):
    """(doc_id, text, lang, source, n_chars): awkward rows, toxic ones, near copies, a long line shared between other neighbours, blank lines round a repeat."""
    rng = random.Random(seed)
    rows = awkward(n=30)
    for i in range(100, 160):
        rows.append((i, prose(rng, 20) + " " + " ".join(rng.choice(BAD) for _ in range(6)) + " " + prose(rng, 10)))
    for i in range(200, 300):
        rows.append((i, prose(rng, rng.randrange(8, 60))))
    base = prose(rng, 100).split(" ")
    for i in range(300, 306):
        rows.append((i, " ".join([*base[: len(base) - 3 * (i - 300)], *prose(rng, 3 * (i - 300) + 1).split(" ")])))
    long = prose(rng, 55)
    rows += [(400 + i, "\n".join([prose(rng, 9), long, "", prose(rng, 9)])) for i in range(4)] + [(410, "\n \n" + long + "\n"), (411, long)]
    return [(i, t, [None, "en", "de"][(i or 0) % 3], [None, "a", "a", "b"][(i or 0) % 4], None if t is None else len(t)) for i, t in rows]


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE).select("*", *[F.lit("c").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    table(spark, corpus()).repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 160)) for i in range(100, 290)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(df):
    """Rows without the clashing columns, which must be as they were."""
    out = df.collect()
    assert all(r[c] == "c" for r in out for c in CLASH)
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in out)


# The stages in plain Python: rows to rows.


def clean_rows(rows, weights, bias):
    def score(text):
        z = bias + sum(weights.get(f, 0.0) for w in set(re.findall(r"\w+", (text or "").lower())) for f in toxicity.features(w))
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    return [r for r in rows if score(r[1]) < 0.5]


def deduped_lines(rows):
    text_hash = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))
    texts = {(-(1 << 63) if r[0] is None else r[0], text_hash(r[1] or "")): r[1] or "" for r in rows}
    seen, gone = set(), {}
    for key in sorted(texts):
        lines = [(k, s) for k, s in enumerate(texts[key].split("\n")) if s.strip()]
        parts = [lines[p : p + 2] for p in range(len(lines) - 1)] or ([lines] if lines else [])
        for kind, run in [*((len(p), p) for p in parts), *((50, [x]) for x in lines if len(x[1].split()) >= line_dedup.LONG)]:
            gram = (kind, tuple(s for _, s in run))
            if gram in seen:
                gone.setdefault(key, set()).update(k for k, _ in run)
            seen.add(gram)
    out = []
    for i, t, lang, source, n in rows:
        lost = gone.get((-(1 << 63) if i is None else i, text_hash(t or "")))
        if lost:
            t = "\n".join(s for k, s in enumerate(t.split("\n")) if k not in lost)
            n = len(t)
            if not t.strip():
                continue
        out.append((i, t, lang, source, n))
    return out


def deduped_near(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    nodes = sorted({(r[0], lower(r[1])) for r in rows if r[0] is not None})
    sets = []
    for _, t in nodes:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(nodes)))  # nodes are ordered by id, so the least node has the least id
    for a, b in combinations(range(len(nodes)), 2):
        both = len(sets[a] | sets[b])
        if (not both or len(sets[a] & sets[b]) >= 0.8 * both) and root[a] != root[b]:
            least, other = sorted((root[a], root[b]))
            root = [least if r == other else r for r in root]
    first = {node: nodes[root[k]][0] for k, node in enumerate(nodes)}
    return [r for r in rows if r[0] is None or first[(r[0], lower(r[1]))] == r[0]]


def mixed(rows):
    def chain(seed, *values):  # a null leaves the hash as it is
        for v in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(v, seed=seed)
        return signed(seed)

    cells, of = Counter(), []
    for i, t, lang, source, _ in rows:
        ws = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        best = max(ws, key=lambda w: (len(w), w.encode()), default=None)
        cell = (source or "(none)", lang or "(none)", "t-" if best is None else f"t{chain(42, best.encode()) % 8}")
        cells[cell] += max(1, len(ws))
        of.append(cell)
    every = sum(cells.values())
    weight = {c: float(n) for c, n in cells.items()}
    for _ in range(30):
        for m in range(3):
            found, now = Counter(), Counter()
            for c, n in cells.items():
                found[c[m]] += n
                now[c[m]] += weight[c]
            raw = {x: (n / every) ** 0.7 for x, n in found.items()}
            weight = {c: w * raw[c[m]] / sum(raw.values()) * every / now[c[m]] for c, w in weight.items()}
    rate = {c: weight[c] / n for c, n in cells.items()}
    most = max(rate.values(), default=1.0)
    draw = lambda r: chain(42, (17).to_bytes(4, "little"), None if r[0] is None else r[0].to_bytes(8, "little"), None if r[1] is None else r[1].encode()) % (1 << 53) / (1 << 53)
    return [r for r, c in zip(rows, of) if draw(r) < rate[c] / most]


def encoded(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.ranks().splitlines())}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Counter((i, lang, source, len(ids := e.encode_ordinary(t or "")), ",".join(map(str, ids)), True) for i, t, lang, source, _ in rows)


def test_toxicity_stage(spark, folder):
    docs = table(spark, corpus())
    weights, bias = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = plain(corpus_pipeline.drop_toxic(spark, docs, folder))
    assert got == Counter(clean_rows(corpus(), weights, bias))
    assert not any(r[0] and 100 <= r[0] < 160 for r in got)
    assert sum(got.values()) >= 0.9 * (len(corpus()) - 60)  # the 44 positives share their vocabulary with clean texts: 12 of 156 clean ones go too
    assert corpus_pipeline.drop_toxic(spark, docs.where("false"), folder).count() == 0


def test_line_stage(spark, folder):
    got = plain(corpus_pipeline.dedup_lines(spark, table(spark, corpus()), folder))
    assert got == Counter(deduped_lines(corpus()))
    ids = {r[0] for r in got}
    assert 400 in ids and not {410, 411} & ids  # nothing but blank lines is left of these
    assert corpus_pipeline.dedup_lines(spark, table(spark, []), folder).count() == 0


def test_near_stage(spark, folder):
    got = plain(corpus_pipeline.dedup_near(spark, table(spark, corpus()), folder))
    assert got == Counter(deduped_near(corpus()))
    assert corpus_pipeline.dedup_near(spark, table(spark, []), folder).count() == 0


def test_mixing_stage(spark, folder):
    got = plain(corpus_pipeline.mix_sources(spark, table(spark, corpus()), folder))
    assert got == Counter(mixed(corpus())) and 0 < sum(got.values()) < len(corpus())
    assert corpus_pipeline.mix_sources(spark, table(spark, []), folder).count() == 0


def test_encoding_stage(spark, folder):
    out = corpus_pipeline.encode(spark, table(spark, corpus()), folder).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], r["ids"], r["round_trip"]) for r in out) == encoded(corpus())
    assert corpus_pipeline.encode(spark, table(spark, []), folder).count() == 0


def test_run(spark, folder):
    """The stages one after another, each on what the one before kept."""
    weights, bias = toxicity.train(table(spark, corpus()), spark.read.parquet(f"{folder}/labels.parquet"))
    want = encoded(mixed(deduped_near(deduped_lines(clean_rows(corpus(), weights, bias)))))
    out = queries.pipeline(spark, folder).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], r["ids"], r["round_trip"]) for r in out) == want


def test_fingerprint_query(spark, tmp_path):
    """op2 with likenesses and classes."""
    rows = {i: t or "" for i, t in awkward() if i is not None and i not in (902, 903)}
    path = f"{tmp_path}/data"
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    ids = sorted(rows)
    fp = {i: int(brute_fingerprint(rows[i]), 16) for i in ids}
    first = {}
    for i in ids:
        first.setdefault(fp[i], i)
    classes = brute_components({i: f for f, i in first.items()}, 2)
    want = set()
    for k, i in enumerate(ids):
        t, j = rows[i], ids[(k + 1) % len(ids)]
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[j][:half]
        e = int(brute_fingerprint(edited), 16)
        near = lambda a, b: 1 - (a ^ b).bit_count() / 128
        want.add((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fp[i]:032x}", f"{e:032x}", near(fp[i], e), near(fp[i], fp[j]), classes[first[fp[i]]]))
    assert set(map(tuple, queries.op2_document_fingerprints(spark, path).collect())) == want


def test_sharding_query(spark, tmp_path):
    """op8: the slot by XXH64 of the id's digits, its owner by taking turns over whole preference lists."""
    path = f"{tmp_path}/data"
    rows = [(i, "s") for i in [*range(-50, 400), 2**62, None]]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{path}/documents.parquet")

    def mix(s, seed):
        h = 0xCBF29CE484222325 ^ seed
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
        return h ^ h >> 33

    p = sharding.SLOTS
    orders = [iter([(mix(s, 1) + k * (mix(s, 2) % (p - 1) + 1)) % p for k in range(p)]) for s in queries.SHARDS]
    owner = {}
    while len(owner) < p:
        for s, order in zip(queries.SHARDS, orders):
            if len(owner) < p:
                owner[next(x for x in order if x not in owner)] = s
    slot = lambda i: signed(xxhash.xxh64_intdigest(b"" if i is None else str(i).encode(), seed=42)) % p
    got = {(r["doc_id"], r["slot"], r["shard"]) for r in queries.op8_sharding(spark, path).collect()}
    assert got == {(i, slot(i), owner[slot(i)]) for i, _ in rows}


def test_the_vocabulary_goes_when_another_operators_task_runs_in_its_worker():
    """Workers outlive stages: what the tokenizer remembers there must not count against later stages."""
    held = weakref.ref(tokenizer.vocabulary(queries.ranks(), public_tokenizers.PATTERN))
    gc.collect()
    assert held() is not None
    out = pd.concat(near_dedup._own(iter([pd.DataFrame({"_text": ["a b c d e f", ""]})])))
    gc.collect()
    assert held() is None and len(out) == 2
    assert tokenizer.vocabulary(queries.ranks(), public_tokenizers.PATTERN) is tokenizer.vocabulary(queries.ranks(), public_tokenizers.PATTERN)
