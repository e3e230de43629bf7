"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, collocations, fingerprints, language, line_dedup, mixing, near_dedup, secrets, sharding, simhash, suffix_dedup, tokenizer, topk, toxicity
from .common import cut, new_path, read, small_batches

#: The shards of op8.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The ledger is kept where the session names a folder for it; else each run has one of its own.
    ledger = spark.conf.get("spark.notegraph.ledger", None) or new_path(spark, "ledger")
    findings = secrets.scan_stored(read(spark, sf_dir, "documents").select("doc_id", "text"), ledger)
    kinds = [r.kind for r in secrets.RULES]
    spans = {k: F.coalesce(F.try_element_at("kinds", F.lit(k)), F.array().cast("array<struct<start:int,end:int>>")) for k in kinds}

    def named(i: int, k: str) -> Column:
        return F.transform(spans[k], lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"), F.lit(k).alias("kind")))

    every = F.concat(*[named(i, k) for i, k in enumerate(kinds)])
    text = F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = findings.select("doc_id", *[F.size(spans[k]).cast("long").alias(f"n_{k}") for k in kinds], text.alias("spans"))
    return out.select("doc_id", *[f"n_{k}" for k in kinds], F.sha2("spans", 256).alias("base_sha256"), "spans")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    edits = cut(fingerprints.edited_texts(docs).withColumn("edited_sha256", F.sha2("edited", 256)), "edited")
    d = docs.where("doc_id is not null").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    fp = ["f0", "f1"]
    own = fingerprints.fingerprints(d, ["doc_id", "sha"], F.coalesce("text", F.lit("")))
    own = own.groupBy("doc_id").agg(F.min(F.struct("sha", *fp)).alias("s")).select("doc_id", *[f"s.{f}" for f in fp])
    own = cut(fingerprints.near_classes(own, fp, "doc_id", radius=2), "own")
    edited = fingerprints.fingerprints(edits, ["id"], F.col("edited")).select("id", *[F.col(f).alias(f"e_{f}") for f in fp])
    narrow = edits.select("id", "next_id", "n_chars", "edited_sha256").join(edited, "id")
    after = own.select(F.col("doc_id").alias("next_id"), *[F.col(f).alias(f"n_{f}") for f in fp])
    rows = own.join(narrow, own["doc_id"] == narrow["id"]).join(after, "next_id")
    a, e, n = ([F.col(f"{p}{f}") for f in fp] for p in ("", "e_", "n_"))
    return rows.select("doc_id", "n_chars", "edited_sha256", simhash.hex_of(*a).alias("fingerprint"), simhash.hex_of(*e).alias("edited_fingerprint"), simhash.likeness(a, e).alias("near_edited"), simhash.likeness(a, n).alias("near_next"), "class_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = line_dedup.delete_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, spans in zip(pdf["id"], pdf["text"], pdf["spans"]):
            data = text.encode("utf-8")
            runs = suffix_dedup.merged(spans, len(data))
            sha, at = hashlib.sha256(), 0
            for a, b in runs:
                sha.update(data[at:a])
                at = b
            sha.update(data[at:])
            out.append((doc, len(data), sum(b - a for a, b in runs), len(runs), sha.hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = suffix_dedup.with_spans(read(spark, sf_dir, "documents").select("doc_id", "text"), length=400, first_stays=False)
    return rows.mapInPandas(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    groups = near_dedup.simhash_groups(docs)
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("f0")).alias("fingerprint"), "component_id")


def op6_mixture_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.where("_kept").select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_p").alias("probability"))


def ranks() -> bytes:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = tokenizer.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks(), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id"), SHARDS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    weights, bias = toxicity.train(docs, labels)
    scored = toxicity.score(docs, weights, bias)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_mixture_sampling": op6_mixture_sampling,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_exact_topk": op10_exact_topk,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_language_id": op12_language_id,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": pipeline,
}


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    """DuckDB: kind's spans as a list of structs, from the pieces between matches."""
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1), lambda i: {{
        'start': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i-1], lambda x: length(x))), 0),
        'k': length(regexp_extract_all(t, '{p}', {group})[i]), 'n': length(regexp_extract_all(t, '{p}', 0)[i])}}), lambda s: s.k >= {least})"""


_LISTS = ", ".join(f"{_sql_spans(r.kind, r.pattern, r.group, r.least)} AS s_{r.kind}" for r in secrets.RULES)
_ALL = " || ".join(f"list_transform(s_{r.kind}, lambda s: {{'start': s.start, 'i': {i}, 'e': s.start + s.n, 'kind': '{r.kind}'}})" for i, r in enumerate(secrets.RULES))

def _sql_lloyd(k: int, rounds: int, dims: int) -> str:
    """DuckDB: each round's centroids from the ones before, in wide form by position, then the last assignment."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS INTEGER) AS cluster, q AS c FROM (SELECT * FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), q LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, q, cluster, d FROM (SELECT vec_id, q, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d, v.rowid_ FROM (SELECT *, row_number() OVER () AS rowid_ FROM v) v, c{i})
  QUALIFY row_number() OVER (PARTITION BY rowid_ ORDER BY d, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT cluster, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) r(i) GROUP BY cluster, i) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLES: dict[str, str] = {
    "op1_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {_LISTS} FROM d),
j AS (SELECT *, coalesce(array_to_string(list_transform(list_sort({_ALL}), lambda s: s.kind || ':' || CAST(CAST(s.start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s.e AS BIGINT) AS VARCHAR)), ','), '') AS spans FROM f)
SELECT doc_id, CAST(len(s_assign) AS BIGINT) AS n_assign, CAST(len(s_access) AS BIGINT) AS n_access, CAST(len(s_hex) AS BIGINT) AS n_hex, sha256(spans) AS base_sha256, spans FROM j""",
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, t, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
s AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM e WHERE regexp_matches(line, '\\S')),
g AS (SELECT doc_id, p, i, lead(i) OVER w AS j, line, lead(line) OVER w AS next_line, n, len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) AS words FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
m AS (SELECT doc_id, p, line || chr(10) || next_line AS gram, 2 AS kind, [i, j] AS places FROM g WHERE next_line IS NOT NULL
  UNION ALL SELECT doc_id, p, line, 1, [i] FROM g WHERE n = 1 UNION ALL SELECT doc_id, p, line, 50, [i] FROM g WHERE words >= 50),
r AS (SELECT doc_id, places, row_number() OVER (PARTITION BY kind, gram ORDER BY doc_id, p) AS k FROM m),
d AS (SELECT DISTINCT doc_id, unnest(places) AS i FROM r WHERE k > 1),
k AS (SELECT e.doc_id, string_agg(CASE WHEN d.i IS NULL THEN line END, chr(10) ORDER BY e.i) AS kept, count(*) AS n_lines, count(d.i) AS n_removed FROM e LEFT JOIN d ON d.doc_id = e.doc_id AND d.i = e.i GROUP BY e.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k""",
    "op10_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_phrase_collocations": """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS k FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n.n, (CAST(1000 AS HUGEINT) * c.a * CAST(n.n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.k + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM (SELECT lang, a, string_split(phrase, ' ') AS w, unnest(range(2, f.k)) AS k FROM f WHERE f.k > 2)),
m AS (SELECT lang, phrase, max(a) AS most FROM i GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000""",
    "op13_centroid_clustering": _sql_lloyd(16, 3, 64),
}
