"""The whole row of metrics of a vault, and the payload of its dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import communities as C
from . import links, metrics
from . import vectors as V

#: Members of a community that counts, and participation above which a page is a bridge.
LEAST_MEMBERS, BRIDGE = 3, 0.3


def _row(df: DataFrame, **columns: Column) -> DataFrame:
    """One row of aggregates, also of no rows."""
    return df.agg(*[c.alias(k) for k, c in columns.items()])


def _first(df: DataFrame, name: str, *fields: Column) -> DataFrame:
    """One row with the only row of df as a struct; null without one."""
    return df.select(F.struct(*fields).alias(name)).agg(F.first(name).alias(name))


def topology(pages: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """One row: q, communities of three members or more, bridges (participation over 0.3) and the top one (name, participation, spans).

    part (name, community) of the dashboard's graph; by default its Louvain communities by rounds of joins. For fewer than two links or four pages q
    and the top bridge are null and the counts 0. Ties of bridges go to the first name.
    """
    both = links.undirected(links.graph(pages, "dash")).persist()
    part = C.louvain_rounds(both) if part is None else part
    guard = both.agg((F.count("*") >= 2).alias("_m")).join(F.broadcast(pages.agg((F.count_distinct("name") >= 4).alias("_k"))))
    large = part.groupBy("community").agg(F.count("*").alias("n"))
    p = C.participation(both, part).where(F.col("participation") > BRIDGE)
    top = p.orderBy(F.desc(F.round("participation", 3)), F.desc("degree"), "name").limit(1)
    row = C.modularity(both, part).select(F.round("q", 4).alias("q"))
    for more in (_row(large, communities=F.count_if(F.col("n") >= LEAST_MEMBERS)), _row(p, bridges=F.count("*")), _first(top, "top_bridge", F.col("name"), F.round("participation", 3).alias("participation"), F.col("communities").alias("spans")), guard):
        row = row.join(F.broadcast(more))
    ok = F.col("_m") & F.col("_k")
    return row.select(*[F.when(ok, F.col(c)).alias(c) for c in ("q", "top_bridge")], *[F.when(ok, F.col(c)).otherwise(0).alias(c) for c in ("communities", "bridges")])


def similarities(pages: DataFrame, index: DataFrame) -> DataFrame:
    """One row: sim_p50, sim_p75, sim_p95 of all pairs, closest (a, b, sim), isolated (name, nearest) and cohesion by primary domain. Nulls and no domains for fewer than two vectors."""
    stats = V.pair_stats(index).select("pairs", *[F.when(F.col("pairs") > 0, F.col(c)).alias(f"sim_{c}") for c in ("p50", "p75", "p95")])
    near = V.nearest(index).orderBy("nearest", "name").limit(1)
    by = V.cohesion(index.join(metrics.primary_domain(pages).where("domain is not null"), "name"), "domain")
    row = stats
    for more in (_first(V.closest(index), "closest", F.col("a"), F.col("b"), F.col("sim")), _first(near, "isolated", F.col("name"), F.col("nearest")), _row(by, cohesion=F.map_from_entries(F.collect_list(F.struct("domain", "cohesion"))))):
        row = row.join(F.broadcast(more))
    return row.drop("pairs")


def all_metrics(pages: DataFrame, index: DataFrame | None = None, part: DataFrame | None = None) -> DataFrame:
    """One row: vault_metrics, topology, the distributions as maps (types, domains_dist, provenance, statuses), the most linked page, and similarities of an index (name, vec) of pages."""
    d = metrics.distributions(pages)
    kinds = {"types": "type", "domains_dist": "domain", "provenance": "provenance", "statuses": "status"}
    maps = _row(d, **{k: F.map_from_entries(F.collect_list(F.when(F.col("measure") == m, F.struct("key", "n")))) for k, m in kinds.items()})
    content = pages.where(F.col("has_fm") & F.col("page_type").isin(*metrics.KINDS))
    top = links.most_connected(links.graph(pages, "dash"), content)
    row = metrics.vault_metrics(pages).drop("q")
    for more in (topology(pages, part), maps, _first(top, "most_connected", F.col("name"), F.col("inbound"))):
        row = row.join(F.broadcast(more))
    if index is not None:
        return row.join(F.broadcast(similarities(pages, index)))
    none = {"sim_p50": "double", "sim_p75": "double", "sim_p95": "double", "closest": "struct<a:string,b:string,sim:double>", "isolated": "struct<name:string,nearest:double>", "cohesion": "map<string,double>"}
    return row.withColumns({k: F.lit(None).cast(t) for k, t in none.items()}).withColumn("cohesion", F.create_map().cast("map<string,double>"))


# Names and labels of the parts of a vault's health, and the payload's keys of its snapshot.
HEALTH_ROWS = (("orphans", "Сироты", "orphan"), ("density", "Плотность", "density"), ("modular", "Q (Louvain)", "q"), ("ready", "Зрелых", "ready"), ("domain", "Классифицир.", "domain"))
HEAVY = "sankey array<struct<source:string,target:string,value:long>>, treemap array<struct<domain:string,type:string,n:long>>, insights map<string,string>, umap_iframe string, graph_iframe string, snapshot_date string"


def heavy_snapshot(sankey: DataFrame, treemap: DataFrame, previous: DataFrame, generated: str, umap: str | None, graph: str | None) -> DataFrame:
    """One row of the heavy snapshot: flows (domain, community, flow) and tree (domain, type, n) as lists in order, the maps' files, and the insights of the snapshot before, which only their author changes."""
    flows = sankey.agg(F.sort_array(F.collect_list(F.struct((-F.col("flow")).alias("o"), F.col("domain").alias("source"), F.concat(F.lit("c"), F.col("community").cast("string")).alias("target"), F.col("flow").alias("value")))).alias("f"))
    tree = treemap.agg(F.sort_array(F.collect_list(F.struct("domain", (-F.col("n")).alias("o"), "type", "n"))).alias("t"))
    old = previous.agg(F.first("insights", ignorenulls=True).alias("i"))
    row = flows.join(F.broadcast(tree)).join(F.broadcast(old))
    return row.select(
        F.lit(generated).alias("generated"), F.lit(generated[:10]).alias("snapshot_date"), F.lit(umap).cast("string").alias("umap_iframe"), F.lit(graph).cast("string").alias("graph_iframe"),
        F.transform("f", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["value"].alias("value"))).alias("sankey"),
        F.transform("t", lambda x: F.struct(x["domain"].alias("domain"), x["type"].alias("type"), x["n"].alias("n"))).alias("treemap"), F.coalesce("i", F.create_map().cast("map<string,string>")).alias("insights"),
    )


def read_heavy(texts: DataFrame) -> DataFrame:
    """One row (HEAVY) of a snapshot's text (text): empty lists and nulls where there is no file, a broken one, or a key is missing."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in texts.sparkSession.createDataFrame([], HEAVY).schema])
    row = texts.select(F.from_json("text", schema).alias("h")).agg(F.first("h", ignorenulls=True).alias("h"))
    empty = {"sankey": F.array(), "treemap": F.array(), "insights": F.create_map()}
    return row.select(*[F.coalesce(F.col(f"h.{f.name}"), empty[f.name].cast(f.dataType)).alias(f.name) if f.name in empty else F.col(f"h.{f.name}").alias(f.name) for f in schema])


def health_of(m: DataFrame) -> DataFrame:
    """One row, health: total and its rows (key, label, score, detail); no rows for a vault without pages. m: a row of all_metrics."""
    h = metrics.health(m)
    p = F.greatest(F.col("pages"), F.lit(1))
    percent = lambda c: F.concat(F.bround(c * 100).cast("long").cast("string"), F.lit("%"))
    detail = {
        "orphans": F.concat_ws(" / ", F.col("orphans").cast("string"), F.col("pages").cast("string")),
        "density": F.format_string("%.2f", F.col("wikilinks").cast("double") / p),
        "modular": F.when(F.coalesce("q", F.lit(0.0)) != 0, F.format_string("%.3f", F.col("q"))).otherwise(metrics.NOTHING),
        "ready": percent(F.col("ready") / p),
        "domain": percent((F.col("content") - F.col("unassigned")) / F.greatest(F.col("content"), F.lit(1))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.bround(F.col(f"{s}_score")).cast("long").alias("score"), detail[k].alias("detail")) for k, label, s in HEALTH_ROWS])
    none = F.array().cast("array<struct<key:string,label:string,score:bigint,detail:string>>")
    return h.select(F.struct(F.col("total"), F.when(F.col("pages") > 0, rows).otherwise(none).alias("rows")).alias("health"))


def payload(m: DataFrame, history: DataFrame, words: DataFrame, heavy: DataFrame, latest: DataFrame, now: str, vault_name: str) -> DataFrame:
    """One row, json: all that the dashboard shows. m: a row of all_metrics; history of entries; words (word, n); heavy: a row of read_heavy; latest: a row of vault.latest_snapshots, for
    the maps where the snapshot names none. Entries are in order of time, words by count; page lists stay out. `</` is escaped, so that it can stand in a script element."""
    entries = metrics.for_display(history)
    earlier = lambda a, b: F.when(a["ts"] < b["ts"], -1).when(a["ts"] > b["ts"], 1).otherwise(0)  # noqa: E731  maps have no order of their own
    listed = entries.agg(F.array_sort(F.collect_list(F.struct(*entries.columns)), earlier).alias("history"))
    cloud = words.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "word", "n"))).alias("w")).select(F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"))).alias("wordcloud"))
    c = metrics.cards(m, history, now)
    cards = c.agg(F.map_from_entries(F.collect_list(F.struct("card", F.struct("value", "delta", "kind")))).alias("cards"))
    scan = latest.select(F.struct(F.col("date"), F.col("umap"), F.col("graph")).alias("s"))
    row = m.select("provenance", "statuses")
    for more in (listed, cloud, cards, health_of(m), heavy, scan):
        row = row.join(F.broadcast(more))
    has = F.col("umap_iframe").isNotNull()
    fields = [
        F.lit(now).alias("now"), F.lit(vault_name).alias("vault_name"), "history", "provenance", "statuses", "wordcloud", "sankey", "treemap", "insights",
        F.when(has, F.col("snapshot_date")).otherwise(F.col("s.date")).alias("latest_snapshot_date"), F.coalesce("umap_iframe", "s.umap").alias("umap_iframe"),
        F.when(has, F.col("graph_iframe")).otherwise(F.col("s.graph")).alias("graph_iframe"), "cards", "health",
    ]
    return row.select(F.replace(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/")).alias("json"))
