"""Registered queries over the data tables, and DuckDB SQL with the same rows.

Operators over pages run on a vault made of `documents` by integer arithmetic; the Spark query parses its texts, while the
SQL derives the result from the arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..operators import communities as C
from ..operators import dashboard, fixes, layout, links, metrics, rules
from ..operators import vectors as V
from ..session import work_dir
from ..sources import notes, vault
from ..streaming import upkeep
from . import bases, views

FLAGSHIP = "vec_topk_similar"
AS_OF = "2024-01-31"
#: Pages of an Arrow batch at most.
ROWS = 1_000


def _target(x: str) -> str:
    """A page's number; none links to every fortieth, so that there are orphans."""
    return f"({x}) % n - CASE WHEN ({x}) % n % 40 = 9 THEN 1 ELSE 0 END"


#: Plain SQL for both engines: the numbers that a page is made of.
NUMBERS = f"""
SELECT id, n, concat('D', id) AS name, folder,
  CASE WHEN folder = '' THEN 'meta' WHEN id % 11 = 0 THEN 'idea' WHEN folder = 'ideas' THEN 'idea' WHEN folder = 'entities' THEN 'entity'
       WHEN folder = 'questions' THEN 'question' WHEN folder = 'domains' THEN 'domain' ELSE 'mind' END AS kind,
  {_target('3 * id + 1')} AS b1, {_target('id + 17')} AS b2, {_target('7 * id + 3')} AS r1, {_target('13 * id + 5')} AS r2,
  (12 * id) % (n - n % 6) + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS dm,
  CASE WHEN id % 8 = 0 THEN 'odd' WHEN id % 8 = 1 THEN 'evaluation' WHEN folder = 'minds' THEN 'draft' ELSE 'ready' END AS status,
  concat('2024-01-', CASE WHEN id % 28 < 9 THEN '0' ELSE '' END, 1 + id % 28) AS updated,
  concat(CASE WHEN folder = '' THEN '' ELSE concat(folder, '/') END, 'D', id, '.md') AS path
FROM (SELECT doc_id AS id, (SELECT count(*) FROM {{documents}}) AS n,
  CASE doc_id % 6 WHEN 0 THEN 'domains' WHEN 1 THEN 'ideas' WHEN 2 THEN 'entities' WHEN 3 THEN 'questions' WHEN 4 THEN 'minds' ELSE '' END AS folder FROM {{documents}}) x"""

TEXTS = (
    """
SELECT path, concat('---', chr(10), 'type: ', kind, chr(10),
  CASE WHEN id % 7 = 0 THEN '' ELSE concat('summary: "About D', id, '"', chr(10)) END,
  'status: ', status, chr(10),
  CASE WHEN id % 4 = 0 THEN concat('tags: [a, b]', chr(10)) ELSE concat('tags:', chr(10), '  - a', chr(10)) END,
  CASE WHEN id % 13 = 0 THEN '' ELSE concat('updated: ', updated, chr(10)) END,
  'domain:', chr(10), '  - "[[D', dm, ']]"', chr(10),
  'related:', chr(10), '  - "[[D', r1, ']]"', chr(10), '  - "[[D', r2, '|other]]"', chr(10),
  'sources:', chr(10), '  - "[[raw/S', id, '.md]]"', chr(10), '---', chr(10),
  'Page D', id, ' sees [[D', b1, ']] and [[wiki/ideas/D', b2, '|x]], ![[D1]] and `[[D2]]`.', chr(10),
  '```', chr(10), '[[D3]]', chr(10), '```', chr(10),
  CASE WHEN id % 5 = 0 THEN concat('Gone [[D', n + id, '#part]].', chr(10)) ELSE '' END,
  CASE WHEN id % 9 = 0 THEN concat('See [[raw/S', id, ']].', chr(10)) ELSE '' END) AS text
FROM ("""
    + NUMBERS
    + ") y"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_V = "WITH v AS (" + NUMBERS.format(documents="documents") + "), "
_ALL_LINKS = "l AS (SELECT id, n, folder, kind, b1 AS d, 'body' AS o FROM v UNION ALL SELECT id, n, folder, kind, b2, 'body' FROM v UNION ALL SELECT id, n, folder, kind, n + id, 'body' FROM v WHERE id % 5 = 0 UNION ALL SELECT id, n, folder, kind, r1, 'related' FROM v UNION ALL SELECT id, n, folder, kind, r2, 'related' FROM v UNION ALL SELECT id, n, folder, kind, dm, 'domain' FROM v)"
_LINT = _V + _ALL_LINKS + ", e AS (SELECT DISTINCT id AS s, d FROM l)"
_SCORE = "folder <> '' AND kind NOT IN ('meta', 'domain')"
_EDGE = _V + _ALL_LINKS + f", nodes AS (SELECT * FROM v WHERE {_SCORE}), e AS (SELECT DISTINCT l.id AS s, l.d FROM l JOIN nodes a ON a.id = l.id JOIN nodes b ON b.id = l.d WHERE l.id <> l.d)"
_MAP = _V + _ALL_LINKS + ", e AS (SELECT DISTINCT l.id AS s, l.d FROM l JOIN v b ON b.id = l.d WHERE l.folder <> '' AND b.folder <> '' AND o <> 'domain')"
_UND = _MAP + ", u AS (SELECT DISTINCT least(s, d) AS a, greatest(s, d) AS b FROM e WHERE s <> d), p AS (SELECT id, id % 7 AS c FROM v), w AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u), z AS (SELECT x, y, p.c AS cx, q.c AS cy FROM w JOIN p ON p.id = x JOIN p q ON q.id = y)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet")


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    """The made vault, parsed. A parsed header is some dozens of Python objects, so Arrow batches are small; operators leave the session alone."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, ROWS) if rows > 0 else ROWS))
    return vault.parsed(spark.sql(TEXTS.format(documents="{docs}"), docs=_read(spark, sf, "documents")))


def index_of(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("vec"), "label")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_PAIRS = f"WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) "


@query("vec_topk_similar", f"SELECT b.vec_id AS name, round({_COS}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY {_COS} DESC, b.vec_id LIMIT 10")
def _(spark, sf):
    idx = index_of(spark, sf)
    q = idx.where("name = 0").first()
    return V.top_k(idx, list(q["vec"]), 10, exclude=0).withColumn("sim", F.round("sim", 6))


@query("vec_topk_filtered", f"SELECT b.vec_id AS name, round({_COS}, 6) AS sim, CAST(b.label AS VARCHAR) AS folder FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 AND b.label > 3 ORDER BY {_COS} DESC, b.vec_id LIMIT 10")
def _(spark, sf):
    idx = index_of(spark, sf)
    q = idx.where("name = 0").first()
    cat = idx.select("name", F.when(F.col("label") > 3, F.col("label").cast("string")).otherwise("meta").alias("folder"))
    ranked = idx.where("name <> 0").select("name", V.cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in q["vec"]])).alias("sim"))
    return V.filtered(ranked, cat, 10).select("name", F.round("sim", 6).alias("sim"), "folder")


@query("vec_pair_stats", _PAIRS + "SELECT count(*) AS pairs, round(min(sim), 6) AS min, round(quantile_cont(sim, 0.25), 6) AS p25, round(quantile_cont(sim, 0.5), 6) AS p50, round(quantile_cont(sim, 0.75), 6) AS p75, round(quantile_cont(sim, 0.95), 6) AS p95, round(quantile_cont(sim, 0.99), 6) AS p99, round(max(sim), 6) AS max FROM s")
def _(spark, sf):
    out = V.pair_stats(index_of(spark, sf))
    return out.select("pairs", *[F.round(c, 6).alias(c) for c in out.columns if c != "pairs"])


@query("vec_tightest_pair", _PAIRS + "SELECT a, b, round(sim, 6) AS sim FROM s ORDER BY s.sim DESC, a, b LIMIT 1")
def _(spark, sf):
    return V.closest(index_of(spark, sf)).withColumn("sim", F.round("sim", 6))


@query("vec_isolation", _PAIRS + "SELECT name, round(greatest(max(sim), 0), 6) AS nearest FROM (SELECT a AS name, sim FROM s UNION ALL SELECT b, sim FROM s) GROUP BY name")
def _(spark, sf):
    return V.nearest(index_of(spark, sf)).withColumn("nearest", F.round("nearest", 6))


@query("vec_group_cohesion", _PAIRS + "SELECT la AS label, round(avg(sim), 6) AS cohesion, (SELECT count(*) FROM embeddings e WHERE e.label = la) AS members FROM s WHERE la = lb GROUP BY la")
def _(spark, sf):
    return V.cohesion(index_of(spark, sf), "label", zero_fill=False).withColumn("cohesion", F.round("cohesion", 6))


@query("vec_centroid", "SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def _(spark, sf):
    return V.centroids(index_of(spark, sf), "label").withColumn("mean", F.round("mean", 6))


_TWO = "(SELECT vec_id AS name, (7 * vec_id + 3) % (SELECT count(*) FROM embeddings) AS o FROM embeddings UNION SELECT vec_id, (13 * vec_id + 5) % (SELECT count(*) FROM embeddings) FROM embeddings)"


def _two(spark, sf) -> DataFrame:
    return spark.sql("SELECT vec_id AS name, (7 * vec_id + 3) % (SELECT count(*) FROM {e}) AS o FROM {e} UNION SELECT vec_id, (13 * vec_id + 5) % (SELECT count(*) FROM {e}) FROM {e}", e=_read(spark, sf, "embeddings").select("vec_id"))


@query("vec_similar_unlinked", _PAIRS + f"SELECT a, b, round(sim, 6) AS sim FROM s WHERE sim > (SELECT quantile_cont(sim, 0.95) FROM s) AND NOT EXISTS (SELECT 1 FROM {_TWO} t WHERE (t.name = a AND t.o = b) OR (t.name = b AND t.o = a))")
def _(spark, sf):
    idx = index_of(spark, sf)
    return V.similar_unlinked(idx, _two(spark, sf).select(F.col("name").alias("src"), F.col("o").alias("dst")), idx, 0.95, 0.0).select("a", "b", F.round("sim", 6).alias("sim"))


@query("vec_contradiction_candidates", _PAIRS + "SELECT a, b, round(sim, 3) AS similarity FROM s WHERE sim > greatest((SELECT quantile_cont(sim, 0.75) FROM s), 0.3)")
def _(spark, sf):
    idx = index_of(spark, sf)
    return V.contradiction_candidates(idx, idx, 0.75, 0.3)


@query("vec_centroid_drift", f"WITH c AS (SELECT t.name, i, avg(CAST(e.embedding[i] AS DOUBLE)) AS m FROM {_TWO} t JOIN embeddings e ON e.vec_id = t.o, range(1, 65) r(i) GROUP BY t.name, i), k AS (SELECT name, list(m ORDER BY i) AS m FROM c GROUP BY name), d AS (SELECT name, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), m) AS drift FROM k JOIN embeddings ON vec_id = name) SELECT name, round(drift, 6) AS drift, round((SELECT greatest(avg(drift) + 1.5 * stddev_pop(drift), 0.1) FROM d), 6) AS threshold FROM d WHERE drift > (SELECT greatest(avg(drift) + 1.5 * stddev_pop(drift), 0.1) FROM d)")
def _(spark, sf):
    idx = index_of(spark, sf)
    return V.drift(idx, _two(spark, sf).withColumnRenamed("o", "source"), idx).select("name", F.round("drift", 6).alias("drift"), F.round("threshold", 6).alias("threshold"))


@query("vec_projection2d")
def _(spark, sf):
    return V.fit_to_canvas(V.projection_2d(index_of(spark, sf)))


@query("vec_index_changes", "SELECT doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'insert' WHEN doc_id % 7 = 0 THEN 'update' ELSE 'keep' END AS action FROM documents UNION ALL SELECT -1 - doc_id, 'delete' FROM documents WHERE doc_id % 9 = 0")
def _(spark, sf):
    d = _read(spark, sf, "documents").select(F.col("doc_id").alias("name"), M.content_hash(F.col("text")).alias("hash"))
    old = d.where("name % 5 <> 0").withColumn("hash", F.when(F.col("name") % 7 == 0, "old").otherwise(F.col("hash")))
    return V.index_changes(old.unionByName(d.where("name % 9 = 0").withColumn("name", -1 - F.col("name"))), d)


# Text


_STOP = ", ".join(f"'{w}'" for w in metrics.STOPWORDS)
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(text, '```[\s\S]*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g'), '!?\[[^\]]*\]\([^)]*\)', ' ', 'g')"


@query("text_wordcount_top", rf"WITH t AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9_-]{{2,}}') AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t), k AS (SELECT CASE WHEN length(w) <= 5 AND w = upper(w) THEN w ELSE lower(w) END AS word, doc_id, i FROM u) SELECT word, count(*) AS n FROM k WHERE lower(word) NOT IN ({_STOP}) GROUP BY word ORDER BY n DESC, min(doc_id * 1000000000 + i) LIMIT 60")
def _(spark, sf):
    return metrics.word_counts(_read(spark, sf, "documents"), "doc_id", "text", list(metrics.STOPWORDS), 60)


@query("text_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", M.content_hash(F.col("text")).alias("hash"))


@query("text_abbr", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name, '\\s+'), lambda w: w <> ''), lambda w: upper(w[1])), '') AS abbr FROM part")
def _(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", M.abbreviation(F.col("p_name")).alias("abbr"))


@query("text_safe_stem", "SELECT p_partkey, trim(regexp_replace(p_type || ' ' || p_name, '[^a-zA-Z0-9_-]', '-', 'g'), '-') AS stem FROM part")
def _(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", M.safe_stem(F.concat_ws(" ", "p_type", "p_name")).alias("stem"))


# Pages


@query("md_frontmatter", _V.rstrip(", ") + " SELECT name, kind AS type, status, CASE WHEN id % 7 = 0 THEN NULL ELSE 'About D' || id END AS summary, CASE WHEN id % 4 = 0 THEN 'a,b' ELSE 'a' END AS tags, CASE WHEN id % 4 = 0 THEN 'tags' ELSE '' END AS inline_lists, CASE WHEN id % 13 = 0 THEN NULL ELSE updated END AS updated FROM v")
def _(spark, sf):
    s = lambda k: F.try_element_at("fm_scalars", F.lit(k)).alias(k)
    return pages_of(spark, sf).select("name", s("type"), s("status"), s("summary"), F.array_join(F.try_element_at("fm_lists", F.lit("tags")), ",").alias("tags"), F.array_join("inline_lists", ",").alias("inline_lists"), s("updated"))


@query("md_wikilinks_lint", _V + _ALL_LINKS + " SELECT 'D' || id AS src, 'D' || d AS dst, o AS origin FROM l UNION ALL SELECT name, 'raw/S' || id, 'body' FROM v WHERE id % 9 = 0")
def _(spark, sf):
    return links.raw_links(pages_of(spark, sf))


@query("md_wikilinks_dash", _V + _ALL_LINKS + " SELECT 'D' || id AS src, 'D' || d AS dst, o AS origin FROM l UNION ALL SELECT name, 'S' || id, 'body' FROM v WHERE id % 9 = 0 UNION ALL SELECT name, 'S' || id, 'sources' FROM v")
def _(spark, sf):
    return links.raw_links(pages_of(spark, sf), "dash")


@query("md_rename", _V.rstrip(", ") + " SELECT path, CASE WHEN path = 'ideas/D7.md' THEN 1 ELSE 0 END AS moved, CAST((b1 = 7)::INT + (r1 = 7)::INT + (r2 = 7)::INT + (dm = 7)::INT AS BIGINT) AS n_links FROM v WHERE b1 = 7 OR r1 = 7 OR r2 = 7 OR dm = 7 OR path = 'ideas/D7.md'")
def _(spark, sf):
    t = pages_of(spark, sf).select(F.concat(F.lit("wiki/"), "path").alias("path"), "text")
    r = fixes.renamed(t, "wiki/ideas/D7.md", "wiki/ideas/Seven.md")
    return r.select(F.substring("path", 6, 100).alias("path"), (F.col("path") != F.col("new_path")).cast("int").alias("moved"), F.size(F.regexp_extract_all("new_text", F.lit(r"\[\[Seven[\]|#]"), F.lit(0))).cast("long").alias("n_links"))


@query("md_canonical_fix", _V.rstrip(", ") + " SELECT path AS \"where\", '[[wiki/ideas/D' || b2 || '|x]]' AS link, '[[D' || b2 || '|x]]' AS fix FROM v WHERE kind <> 'meta'")
def _(spark, sf):
    return rules.non_canonical_wikilink(pages_of(spark, sf)).select("where", "link", "fix")


@query("graph_edges_lint", _LINT + " SELECT 'D' || s AS src, 'D' || d AS dst FROM e")
def _(spark, sf):
    return links.graph(pages_of(spark, sf), "lint")


@query("graph_edges_dash", _LINT + " SELECT 'D' || s AS src, 'D' || d AS dst FROM e WHERE s <> d AND d IN (SELECT id FROM v)")
def _(spark, sf):
    return links.graph(pages_of(spark, sf), "dash")


@query("graph_edges_edge", _EDGE + " SELECT 'D' || s AS src, 'D' || d AS dst FROM e")
def _(spark, sf):
    return links.graph(pages_of(spark, sf), "edge")


@query("graph_edges_map", _MAP + " SELECT 'D' || s AS src, 'D' || d AS dst FROM e")
def _(spark, sf):
    return links.graph(pages_of(spark, sf), "map")


@query("graph_degree", _EDGE + " SELECT name, (SELECT count(*) FROM e WHERE s = id) AS out_degree, (SELECT count(*) FROM e WHERE d = id) AS in_degree FROM nodes")
def _(spark, sf):
    p = pages_of(spark, sf)
    return links.degrees(links.graph(p, "edge"), vault.scoreable(p))


@query("graph_orphans", _MAP + " SELECT name FROM v WHERE folder <> '' AND kind <> 'meta' AND id NOT IN (SELECT d FROM e)")
def _(spark, sf):
    return links.orphans(pages_of(spark, sf), "map")


_INBOUND = ", g AS (SELECT d AS x, count(*) AS k FROM e GROUP BY d)"


@query("graph_most_connected", _MAP + _INBOUND + " SELECT 'D' || x AS name, k AS inbound FROM g WHERE k = (SELECT max(k) FROM g)")
def _(spark, sf):
    return links.most_connected(links.graph(pages_of(spark, sf), "map"))


@query("graph_most_connected_first", _LINT.replace("SELECT DISTINCT id AS s, d FROM l", "SELECT DISTINCT id AS s, d FROM l WHERE id <> d AND d IN (SELECT id FROM v)") + _INBOUND + " SELECT name, k AS inbound FROM g JOIN v ON id = x WHERE kind IN ('idea', 'entity', 'question', 'domain', 'mind') ORDER BY k DESC, path LIMIT 1")
def _(spark, sf):
    p = pages_of(spark, sf)
    return links.most_connected(links.graph(p, "dash"), p.where(F.col("has_fm") & F.col("page_type").isin(*metrics.KINDS)))


@query("graph_frontier", _EDGE + f", f AS (SELECT name, id, CASE WHEN id % 13 = 0 THEN 10000 ELSE date_diff('day', CAST(updated AS DATE), DATE '{AS_OF}') END AS days, (SELECT count(*) FROM e WHERE s = id) AS o, (SELECT count(*) FROM e WHERE d = id) AS i FROM nodes) SELECT name, round((o - i) * exp(-days / 30.0), 4) AS score, o AS out_degree, i AS in_degree FROM f WHERE round((o - i) * exp(-days / 30.0), 4) > 0 ORDER BY 2 DESC, 1 LIMIT 50")
def _(spark, sf):
    return links.frontier(pages_of(spark, sf), AS_OF, 50).drop("days")


def _map_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = pages_of(spark, sf)
    return links.undirected(links.graph(p, "map")), p.select("name", (F.substring("name", 2, 20).cast("long") % 7).alias("community"))


@query("graph_modularity", _UND + ", c AS (SELECT cx, sum(CASE WHEN cx = cy THEN 0.5 ELSE 0 END) AS l, count(*) AS k FROM z GROUP BY cx) SELECT round(sum(l / ((SELECT count(*) FROM z) / 2.0) - (k * 1.0 / (SELECT count(*) FROM z)) * (k * 1.0 / (SELECT count(*) FROM z))), 6) AS q FROM c")
def _(spark, sf):
    e, p = _map_graph(spark, sf)
    return C.modularity(e, p).select(F.round("q", 6).alias("q"))


@query("graph_participation", _UND + ", k AS (SELECT x, cy, count(*) AS k FROM z GROUP BY x, cy) SELECT 'D' || x AS name, round(1 - sum(k * k) * 1.0 / (sum(k) * sum(k)), 6) AS participation, CAST(sum(k) AS BIGINT) AS degree, count(*) AS communities FROM k GROUP BY x")
def _(spark, sf):
    return C.participation(*_map_graph(spark, sf)).withColumn("participation", F.round("participation", 6))


@query("graph_communities", _UND + " SELECT c AS community, count(*) AS size, (SELECT count(*) FROM z WHERE cx = c AND cy = c) / 2 AS inner_edges FROM p GROUP BY c".replace("/ 2 AS", "// 2 AS"))
def _(spark, sf):
    return C.community_sizes(*_map_graph(spark, sf)).select("community", "size", F.col("inner").alias("inner_edges"))


@query("graph_sankey", _V.rstrip(", ") + " SELECT 'D' || dm AS domain, id % 7 AS community, count(*) AS flow FROM v GROUP BY dm, id % 7")
def _(spark, sf):
    p = pages_of(spark, sf)
    return C.sankey(metrics.primary_domain(p), _map_graph(spark, sf)[1])


@query("graph_louvain")
def _(spark, sf):
    return C.louvain(_map_graph(spark, sf)[0])


# Rules

_PATH = '"where"'
_RULE_SQL = {
    "status-not-in-enum": f"SELECT path AS {_PATH}, status AS value, CASE WHEN kind = 'mind' THEN 'draft' ELSE 'in-progress' END AS fix FROM v WHERE kind <> 'entity' AND (status = 'odd' OR (kind = 'mind' AND status NOT IN ('draft')) OR (kind <> 'mind' AND status = 'draft'))",
    "inline-tags": f"SELECT path AS {_PATH} FROM v WHERE id % 4 = 0",
    "raw-link-with-extension": f"SELECT path AS {_PATH}, '[[raw/S' || id || '.md]]' AS link FROM v",
    "raw-ref-in-body": f"SELECT path AS {_PATH}, CAST(CASE WHEN id % 5 = 0 THEN 6 ELSE 5 END AS INTEGER) AS line, '[[raw/S' || id || ']]' AS link FROM v WHERE id % 9 = 0 AND kind <> 'meta'",
    "dead-link": f"SELECT path AS {_PATH}, '[[D' || (n + id) || ']]' AS what, 'line 5' AS context FROM v WHERE id % 5 = 0 AND kind <> 'meta'",
    "orphan": f", i AS (SELECT b1 AS d FROM v UNION SELECT b2 FROM v UNION SELECT r1 FROM v UNION SELECT r2 FROM v UNION SELECT dm FROM v) SELECT path AS {_PATH} FROM v WHERE folder <> '' AND kind <> 'meta' AND id NOT IN (SELECT d FROM i)",
    "asymmetric-related": ", r AS (SELECT id AS a, r1 AS b FROM v UNION SELECT id, r2 FROM v) SELECT x.path AS page_a, y.path AS page_b, x.kind AS page_a_type, y.kind AS page_b_type FROM r JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE a <> b AND x.kind <> 'mind' AND y.kind <> 'mind' AND NOT EXISTS (SELECT 1 FROM r q WHERE q.a = r.b AND q.b = r.a)",
    "dangling-domain-ref": f"SELECT path AS {_PATH}, 'D' || dm AS missing_domain FROM v WHERE dm % 6 <> 0",
    "missing-summary": f"SELECT path AS {_PATH}, kind AS page_type FROM v WHERE id % 7 = 0 AND folder <> ''",
    "non-canonical-wikilink": f"SELECT path AS {_PATH}, '[[wiki/ideas/D' || b2 || '|x]]' AS link, 'line 1' AS context, '[[D' || b2 || '|x]]' AS fix FROM v WHERE kind <> 'meta'",
    "folder-type-mismatch": f"SELECT path AS {_PATH}, kind AS current_type, CASE folder WHEN 'ideas' THEN 'idea' WHEN 'entities' THEN 'entity' WHEN 'questions' THEN 'question' WHEN 'domains' THEN 'domain' ELSE 'mind' END AS expected_type FROM v WHERE folder <> '' AND id % 11 = 0 AND folder <> 'ideas'",
}


def _rule(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: rules.REGISTRY[kind](pages_of(spark, sf)).drop("type")


for _kind, _sql in _RULE_SQL.items():
    query("lint_" + _kind.replace("-", "_"), _V.rstrip(", ") + (" " if _sql.startswith("SELECT") else "") + _sql)(_rule(_kind))


@query("lint_all", _V.rstrip(", ") + " " + " UNION ALL ".join(f"SELECT '{k}' AS type, count(*) AS n FROM ({_V.rstrip(', ')}{' ' if s.startswith('SELECT') else ''}{s}) HAVING count(*) > 0" for k, s in _RULE_SQL.items()))
def _(spark, sf):
    return rules.run_rules(pages_of(spark, sf).persist()).groupBy("type").agg(F.count("*").alias("n"))


@query("lint_quick_scope", _V.rstrip(", ") + f" SELECT path AS {_PATH}, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS run FROM v WHERE id % 4 = 0")
def _(spark, sf):
    p = pages_of(spark, sf)
    current = p.select(F.col("path").alias("page"), F.sha2("text", 256).alias("hash"))
    stored = current.where(F.regexp_extract("page", r"D(\d+)", 1).cast("long") % 3 != 0)
    issues = rules.inline_tags(p)
    return rules.quick_scope(issues.withColumn("run", F.lit("old")), issues.withColumn("run", F.lit("new")), rules.touched(current, stored)).select("where", "run")


@query("fix_text", _V.rstrip(", ") + " SELECT path, CASE WHEN kind <> 'entity' AND (status = 'odd' OR (kind = 'mind' AND status <> 'draft') OR (kind <> 'mind' AND status = 'draft')) THEN CASE WHEN kind = 'mind' THEN 'draft' ELSE 'in-progress' END ELSE status END AS status, 0 AS n_inline, 'raw/S' || id AS source, CASE folder WHEN 'ideas' THEN 'idea' WHEN 'entities' THEN 'entity' WHEN 'questions' THEN 'question' WHEN 'domains' THEN 'domain' WHEN 'minds' THEN 'mind' ELSE kind END AS type FROM v")
def _(spark, sf):
    p = pages_of(spark, sf).persist()
    fixed = fixes.apply_fixes(p, rules.run_rules(p)).select("path", F.col("new_text").alias("text"))
    q = vault.parsed(fixed)
    s = lambda k: F.try_element_at("fm_scalars", F.lit(k)).alias(k)
    return q.select("path", s("status"), F.size("inline_lists").alias("n_inline"), F.regexp_extract(F.try_element_at("fm_lists", F.lit("sources"))[0], r"\[\[([^\]]+)\]\]", 1).alias("source"), s("type"))


# Distributions and history


@query("dist_types", _V.rstrip(", ") + ", w AS (SELECT * FROM v WHERE kind <> 'meta') SELECT 'type' AS measure, kind AS key, count(*) AS n FROM w GROUP BY kind UNION ALL SELECT 'domain', 'D' || dm, count(*) FROM w GROUP BY dm UNION ALL SELECT 'provenance', 'manual', count(*) FROM w UNION ALL SELECT 'status', status, count(*) FROM w GROUP BY status")
def _(spark, sf):
    return metrics.distributions(pages_of(spark, sf))


@query("dist_domains", _V.rstrip(", ") + " SELECT 'D' || dm AS domain, count(*) AS n FROM v WHERE folder <> '' AND kind <> 'meta' GROUP BY dm")
def _(spark, sf):
    return metrics.domain_counts(pages_of(spark, sf))


@query("treemap", "SELECT p_brand AS domain, p_type AS type, count(*) AS n FROM part GROUP BY 1, 2 UNION ALL SELECT p_brand, NULL, count(*) FROM part GROUP BY 1")
def _(spark, sf):
    return metrics.treemap(_read(spark, sf, "part"), "p_brand", "p_type")


_DAYS = "d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS pages, sum(user_id % 50) AS wikilinks, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1)"


def _days(spark, sf) -> DataFrame:
    return _read(spark, sf, "events").groupBy(F.to_date("ts").alias("ts")).agg(F.count("*").alias("pages"), F.sum(F.col("user_id") % 50).alias("wikilinks"))


@query("hist_delta", f"WITH {_DAYS} SELECT CAST(day AS VARCHAR) AS day, pages, CAST(wikilinks AS BIGINT) AS wikilinks, pages - lag(pages) OVER (ORDER BY day) AS delta_pages, CAST(wikilinks - lag(wikilinks) OVER (ORDER BY day) AS BIGINT) AS delta_wikilinks FROM d")
def _(spark, sf):
    return metrics.with_delta(_days(spark, sf), ["pages", "wikilinks"]).select(F.col("ts").cast("string").alias("day"), "pages", "wikilinks", "delta_pages", "delta_wikilinks")


@query("hist_minute_dedup", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('minute', ts), event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, sf):
    return metrics.last_per_minute(_read(spark, sf, "events"), ["ts", "event_id"], ["event_type"]).select("event_id", "event_type")


@query("hist_24h", "SELECT coalesce(round(sum(value), 4), 0) AS value, count(*) AS entries FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR")
def _(spark, sf):
    return metrics.last_day(_read(spark, sf, "events"), "2024-01-15 12:00:00", ["value"]).withColumn("value", F.round("value", 4))


@query("hist_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def _(spark, sf):
    return metrics.in_range(_read(spark, sf, "events"), "2024-01-31 00:00:00", 7).select("event_id")


@query("hist_retention", f"WITH {_DAYS} SELECT CAST(day AS VARCHAR) AS day, pages FROM d ORDER BY day DESC LIMIT 10")
def _(spark, sf):
    return metrics.retained(_days(spark, sf), 10).select(F.col("ts").cast("string").alias("day"), "pages")


@query("hist_pivot", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def _(spark, sf):
    e = _read(spark, sf, "events").groupBy(F.to_date("ts").alias("ts"), "event_type").agg(F.count("*").alias("n"))
    m = e.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("types"))
    return metrics.series(m, "types", ["click", "purchase"]).select(F.col("ts").cast("string").alias("day"), "click", "purchase")


_HEALTH = """, g AS (SELECT s, d FROM e WHERE s <> d AND d IN (SELECT id FROM v)), u AS (SELECT DISTINCT least(s, d) AS a, greatest(s, d) AS b FROM g),
z AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u), t AS (SELECT count(*) * 1.0 AS m FROM z),
k AS (SELECT x % 7 AS c, count(*) AS k, sum(CASE WHEN x % 7 = y % 7 THEN 1 ELSE 0 END) AS l FROM z GROUP BY 1),
m AS (SELECT count(*) * 1.0 AS p, (SELECT count(*) FROM g) AS w, count(*) FILTER (id NOT IN (SELECT d FROM g)) AS o, count(*) FILTER (status = 'ready') AS r,
  (SELECT sum(l / m - (k / m) * (k / m)) FROM k, t) AS q FROM v WHERE kind <> 'meta'),
s AS (SELECT greatest(0.0, least(100.0, 100 - o / p * 1000)) AS orphan_score, greatest(0.0, least(100.0, 100 - abs(w / p - 7) * 14)) AS density_score,
  CASE WHEN q = 0 THEN 50.0 ELSE greatest(0.0, least(100.0, q / 0.7 * 100)) END AS q_score, r / p * 100 AS ready_score, 100.0 AS domain_score FROM m),
f AS (SELECT *, CAST(round_even(0.25 * orphan_score + 0.15 * density_score + 0.25 * q_score + 0.2 * ready_score + 0.15 * domain_score, 0) AS INTEGER) AS total FROM s)
SELECT round(CAST(orphan_score AS DOUBLE), 6) AS orphan_score, round(CAST(density_score AS DOUBLE), 6) AS density_score, round(CAST(q_score AS DOUBLE), 6) AS q_score, round(CAST(ready_score AS DOUBLE), 6) AS ready_score,
  CAST(domain_score AS DOUBLE) AS domain_score, total, CASE WHEN total >= 80 THEN 'good' WHEN total >= 60 THEN 'warn' ELSE 'bad' END AS grade FROM f"""


@query("health", _LINT + _HEALTH)
def _(spark, sf):
    p = pages_of(spark, sf)
    m = metrics.health(metrics.vault_metrics(p, _map_graph(spark, sf)[1]))
    return m.select(*[F.round(f"{k}_score", 6).alias(f"{k}_score") for k in ("orphan", "density", "q", "ready", "domain")], "total", "grade")


# Views


@query("view_domain_pages", _V.rstrip(", ") + " SELECT name, kind AS type, status FROM v WHERE folder NOT IN ('', 'domains') AND (b1 = 12 OR b2 = 12 OR r1 = 12 OR r2 = 12 OR dm = 12)")
def _(spark, sf):
    return views.domain_view(pages_of(spark, sf), "D12").select("name", "type", "status")


_UPDATED = "CASE WHEN id % 13 = 0 THEN NULL ELSE updated END AS updated"


@query("view_needs_development", _V.rstrip(", ") + f" SELECT name, kind AS type, status, {_UPDATED} FROM v WHERE folder <> '' AND status IN ('evaluation', 'in-progress')")
def _(spark, sf):
    return next(v for v in views.GLOBAL_VIEWS if v.name == "needs_development").build(views.rows_of(pages_of(spark, sf)))


@query("view_recent_activity", _V.rstrip(", ") + f" SELECT name, kind AS type, status, '[[D' || dm || ']]' AS domain, {_UPDATED}, CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(date_diff('day', CAST(updated AS DATE), DATE '{AS_OF}') AS DOUBLE) END AS age_days FROM v WHERE folder <> ''")
def _(spark, sf):
    p = pages_of(spark, sf).withColumn("mtime", F.try_to_timestamp(F.try_element_at("fm_scalars", F.lit("updated"))))
    return next(v for v in views.GLOBAL_VIEWS if v.name == "recent_activity").build(views.rows_of(p, AS_OF))


@query("md_index_summaries", _V.rstrip(", ") + f" SELECT name, CASE WHEN id % 7 = 0 THEN '{views.INDEX_MISSING}' ELSE 'About D' || id END AS summary FROM v WHERE folder NOT IN ('', 'minds')")
def _(spark, sf):
    return views.index_summaries(views.index_page(pages_of(spark, sf), AS_OF).withColumn("path", F.lit("index.md")))


def _base_view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A view of the file of global views, as it is written and read back."""

    def run(spark, sf):
        base = bases.parse(bases.text_of(bases.GLOBAL, bases.LABELS)) if bases.yaml else bases.GLOBAL
        p = pages_of(spark, sf).withColumn("mtime", F.try_to_timestamp(F.try_element_at("fm_scalars", F.lit("updated"))))
        out = bases.build(base, next(v for v in base.views if v.name == name), bases.rows(p, AS_OF))
        return out.withColumn("tags", F.array_join("tags", ",")) if "tags" in out.columns else out

    return run


_BASE_DOMAIN, _NONE = "'[[D' || dm || ']]' AS domain", "CAST(NULL AS VARCHAR)"
_AGE_SQL = f"CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(date_diff('day', CAST(updated AS DATE), DATE '{AS_OF}') AS DOUBLE) END AS age_days"
for _name, _columns, _where in (
    ("Recent Activity", f"kind AS type, status, {_BASE_DOMAIN}, {_UPDATED}, {_AGE_SQL}", "folder <> ''"),
    ("Ideas", f"status, {_BASE_DOMAIN}, CASE WHEN id % 4 = 0 THEN 'a,b' ELSE 'a' END AS tags, {_UPDATED}", "folder = 'ideas'"),
    ("Entities", f"{_NONE} AS entity_type, status, {_BASE_DOMAIN}, {_UPDATED}", "folder = 'entities'"),
    ("Questions", f"status, {_NONE} AS answer_quality, {_UPDATED}", "folder = 'questions'"),
    ("Domains", _UPDATED, "folder = 'domains'"),
    ("Minds", f"status, {_NONE} AS seed, {_UPDATED}", "folder = 'minds'"),
    ("Needs Development", f"kind AS type, status, {_UPDATED}", "folder <> '' AND status IN ('evaluation', 'in-progress')"),
):
    query("base_" + _name.lower().replace(" ", "_"), _V.rstrip(", ") + f" SELECT name, {_columns} FROM v WHERE {_where}")(_base_view(_name))


@query("lint_invalid_fields", _V.rstrip(", ") + f", x AS (SELECT path AS {_PATH}, unnest(list_filter(['summary', 'updated', 'domain', 'related', 'sources'], lambda f: NOT (f = 'summary' AND id % 7 = 0) AND NOT (f = 'updated' AND id % 13 = 0))) AS field FROM v WHERE kind = 'idea') SELECT {_PATH}, 'extra' AS subtype, field FROM x UNION ALL SELECT path, 'missing', 'created' FROM v WHERE kind = 'idea'")
def _(spark, sf):
    t = spark.createDataFrame([("idea", f, f"{f}:") for f in ("type", "status", "tags", "created", "provenance")], "type string, field string, entry string")
    return rules.invalid_fields(pages_of(spark, sf), t).select("where", "subtype", "field")


@query("lint_binary_sources", f"SELECT 'raw/a/F' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.PDF' ELSE '.docx' END AS {_PATH}, 'raw/formats/F' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.PDF' ELSE '.docx' END AS suggested FROM part WHERE p_partkey % 3 <> 2")
def _(spark, sf):
    k = F.col("p_partkey")
    paths = _read(spark, sf, "part").select(F.concat(F.when(k % 6 == 5, "formats/F").otherwise("a/F"), k.cast("string"), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".docx").when(k % 6 == 5, ".pdf").otherwise(".md")).alias("path"))
    return rules.binary_outside_formats(paths).select("where", "suggested")


_DASH = _LINT + ", g AS (SELECT s, d FROM e WHERE s <> d AND d IN (SELECT id FROM v)), u AS (SELECT DISTINCT least(s, d) AS a, greatest(s, d) AS b FROM g), z AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u)"


@query("dash_metrics", _DASH + """, k AS (SELECT x, y % 7 AS c, count(*) AS k FROM z GROUP BY ALL), r AS (SELECT x, 1 - sum(k * k) * 1.0 / (sum(k) * sum(k)) AS p, count(*) AS spans, sum(k) AS degree FROM k GROUP BY x HAVING 1 - sum(k * k) * 1.0 / (sum(k) * sum(k)) > 0.3),
t AS (SELECT x % 7 AS c, count(*) * 1.0 AS d, sum(CASE WHEN x % 7 = y % 7 THEN 1 ELSE 0 END) AS i FROM z GROUP BY 1), m AS (SELECT count(*) * 1.0 AS m FROM z),
i AS (SELECT v.name, v.path, count(*) AS inbound FROM g JOIN v ON id = d WHERE kind <> 'meta' GROUP BY ALL)
SELECT (SELECT count(*) FROM v WHERE kind <> 'meta') AS pages, (SELECT count(*) FROM g) AS wikilinks, (SELECT count(*) FROM v WHERE kind <> 'meta' AND id NOT IN (SELECT d FROM g)) AS orphans,
(SELECT count(*) FROM (SELECT id % 7 FROM v GROUP BY 1 HAVING count(*) >= 3)) AS communities, (SELECT count(*) FROM r) AS bridges, round((SELECT sum(i / m - (d / m) * (d / m)) FROM t, m), 4) AS q,
(SELECT name FROM i ORDER BY inbound DESC, path LIMIT 1) AS most_connected, (SELECT max(inbound) FROM i) AS inbound, (SELECT 'D' || x FROM r ORDER BY round(p, 3) DESC, degree DESC, 'D' || x LIMIT 1) AS top_bridge, (SELECT count(*) FROM v WHERE kind = 'idea') AS ideas, (SELECT count(*) FROM v WHERE kind <> 'meta' AND status = 'ready') AS ready""")
def _(spark, sf):
    m = dashboard.all_metrics(pages_of(spark, sf), part=_map_graph(spark, sf)[1])
    return m.select("pages", "wikilinks", "orphans", "communities", "bridges", "q", F.col("most_connected.name").alias("most_connected"), F.col("most_connected.inbound").alias("inbound"), F.col("top_bridge.name").alias("top_bridge"), F.col("types")["idea"].alias("ideas"), "ready")


@query("vec_knn", f"SELECT name, other, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM (SELECT a.vec_id AS name, b.vec_id AS other, {_COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10")
def _(spark, sf):
    return layout.knn(index_of(spark, sf), 10).withColumn("sim", F.round("sim", 6))


@query("vec_neighbour_map", "SELECT count(*) AS names, true AS keeps_more FROM embeddings")
def _(spark, sf):
    idx = index_of(spark, sf)
    near = layout.knn(idx, 15).persist()
    at = layout.neighbour_map(idx, near=near)
    kept = layout.kept_neighbours(idx, at, near=near).select(F.col("kept").alias("a"))
    plain = layout.kept_neighbours(idx, V.projection_2d(idx), near=near).select(F.col("kept").alias("b"))
    return at.agg(F.count("*").alias("names")).join(kept).join(plain).select("names", (F.col("a") > 1.2 * F.col("b")).alias("keeps_more"))


@query("graph_louvain_rounds", _UND + " SELECT count(DISTINCT x) AS nodes, count(*) // 2 AS links, true AS near_one_task FROM z")
def _(spark, sf):
    e = _map_graph(spark, sf)[0].persist()

    def of_one_task() -> float:
        part = C.louvain(e).persist()  # both ends of links ask for it
        q = C.modularity(e, part).first()["q"]
        part.unpersist()
        return q

    n = e.count()
    with ThreadPoolExecutor(1) as pool:  # one core is enough for one task; the rounds have the others
        one = pool.submit(of_one_task)
        part = C.louvain_rounds(e, rounds=12)
        q, one = C.modularity(e, part).first()["q"], one.result()
    return part.agg(F.count("*").alias("nodes")).select("nodes", F.lit(n).alias("links"), F.lit(q > one - 0.02).alias("near_one_task"))


@query("notes_round_trip", _V.rstrip(", ") + " SELECT path, kind AS type FROM v WHERE id % 10 <> 3 UNION ALL SELECT path, 'question' FROM v WHERE id % 30 = 3")
def _(spark, sf):
    """Pages are written as files, some replaced and some deleted, then read in parts and parsed."""
    notes.register(spark)
    folder = work_dir(spark)
    p = pages_of(spark, sf).select("path", "text")
    p.write.format("notes").mode("append").save(folder)
    n = F.regexp_extract("path", r"D(\d+)", 1).cast("long")
    edits = p.where(n % 10 == 3).select("path", F.when(n % 30 == 3, F.lit("---\ntype: question\n---\n")).alias("text"))
    edits.write.format("notes").mode("append").save(folder)
    return vault.parsed(spark.read.format("notes").load(folder).select("path", "text")).select("path", F.col("page_type").alias("type"))


_EDITED = _V + _ALL_LINKS + """, k AS (SELECT * FROM v WHERE id % 50 <> 7), m AS (SELECT id, d FROM l WHERE id % 50 <> 7 AND id % 10 <> 3 UNION SELECT id, 1 FROM k WHERE id % 10 = 3 UNION SELECT id, id + 1 FROM k WHERE id % 10 = 3),
x AS (SELECT id, d FROM m), o AS (SELECT id AS s, count(*) AS c FROM x GROUP BY id), i AS (SELECT d, count(*) AS c FROM x GROUP BY d)
SELECT 'degree' AS what, 'D' || coalesce(s, d) AS subject, CAST(NULL AS VARCHAR) AS detail, coalesce(o.c, 0) AS outgoing, coalesce(i.c, 0) AS incoming FROM o FULL JOIN i ON o.s = i.d
UNION ALL SELECT 'dead-link', path, '[[D' || d || ']]', NULL, NULL FROM x JOIN k USING (id) WHERE (kind <> 'meta' OR id % 10 = 3) AND d NOT IN (SELECT id FROM k)
UNION ALL SELECT 'orphan', path, NULL, NULL, NULL FROM k WHERE folder <> '' AND (kind <> 'meta' OR id % 10 = 3) AND id NOT IN (SELECT d FROM x)"""


@query("inc_upkeep", _EDITED)
def _(spark, sf):
    """Links and issues of the vault, kept up through edits of every tenth page and deletions of every fiftieth."""
    folder = work_dir(spark)
    p = pages_of(spark, sf).select("path", "text")
    upkeep.apply(upkeep.State(spark, folder), p)
    n = F.regexp_extract("path", r"D(\d+)", 1).cast("long")
    edit = F.concat(F.lit("---\ntype: idea\n---\n[[D1]] [[D"), (n + 1).cast("string"), F.lit("]]\n"))
    state = upkeep.State(spark, folder)
    upkeep.apply(state, p.where((n % 10 == 3) | (n % 50 == 7)).select("path", F.when(n % 10 == 3, edit).alias("text")))
    none = F.lit(None).cast("long")
    degrees = state.read("degrees").select(F.lit("degree").alias("what"), F.col("name").alias("subject"), F.lit(None).cast("string").alias("detail"), F.col("out_degree").alias("outgoing"), F.col("in_degree").alias("incoming"))
    issues = upkeep.open_issues(state).where("type in ('dead-link', 'orphan')").select(F.col("type").alias("what"), F.col("where").alias("subject"), F.col("what").alias("detail"), none.alias("outgoing"), none.alias("incoming"))
    return degrees.unionByName(issues)
