"""Link graphs in four profiles, degrees, orphans and the frontier score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..sources import vault


def _list(field: str) -> Column:
    return F.try_element_at("fm_lists", F.lit(field))


def raw_links(pages: DataFrame, profile: str = "lint") -> DataFrame:
    """(src, dst, origin) for each link of a page in order of appearance; origin: body, related, domain or sources."""
    body = M.wikilinks(F.col("body"), profile)
    fields = ("related", "domain", "sources") if profile == "dash" else ("related", "domain")
    read = M.first_links if profile == "dash" else M.list_links
    tagged = [_tagged(o, c) for o, c in [("body", body), *((f, read(_list(f))) for f in fields)]]
    return pages.select(F.col("name").alias("src"), F.inline(F.concat(*tagged))).select("src", "dst", "origin")


def _tagged(origin: str, links: Column) -> Column:
    return F.transform(links, lambda x: F.struct(F.lit(origin).alias("origin"), x.alias("dst")))


def graph(pages: DataFrame, profile: str = "lint") -> DataFrame:
    """Distinct edges (src, dst).

    lint: all pages, no raw targets, red and self links kept. dash: red and self links dropped. edge: pages that can be
    scored, red and self links dropped. map: content pages; body and related only, red links dropped, self links kept.
    """
    links = raw_links(vault.content_pages(pages) if profile == "map" else vault.scoreable(pages) if profile == "edge" else pages, "dash" if profile == "dash" else "lint")
    links = links.where(~F.col("dst").startswith("raw/") & (F.col("dst") != ""))
    if profile == "map":
        links = links.where("origin <> 'domain'")
    edges = links.select("src", "dst").distinct()
    if profile == "lint":
        return edges
    nodes = {"dash": pages, "edge": vault.scoreable(pages), "map": vault.content_pages(pages)}[profile].select(F.col("name").alias("dst")).distinct()
    edges = edges.join(nodes, "dst", "left_semi").select("src", "dst")
    return edges if profile == "map" else edges.where("src <> dst")


def inbound(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges to existing pages."""
    return edges.join(pages.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, out_degree, in_degree) of every node: one pass over both ends of the edges, summed before the shuffle."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    sums = ends.groupBy("name").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return nodes.select("name").distinct().join(sums, "name", "left").select("name", F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"))


def orphans(pages: DataFrame, profile: str = "lint", exclude_root: bool = False) -> DataFrame:
    """Names of pages that nothing links to. lint: neither meta, root nor deprecated; dash: content types; map: content pages.

    exclude_root: links from root pages, such as an index of everything, don't count.
    """
    edges = inbound(graph(pages, profile), pages) if profile == "lint" else graph(pages, profile)
    if exclude_root:
        edges = edges.join(pages.where("folder = ''").select(F.col("name").alias("src")), "src", "left_anti")
    t = F.coalesce(F.col("page_type"), F.lit(""))
    if profile == "lint":
        of = pages.where((t != "meta") & (F.col("folder") != "") & ~F.coalesce(F.try_element_at("fm_scalars", F.lit("status")) == "deprecated", F.lit(False)))
    else:
        of = pages.where(t.isin(*vault.FOLDER_TYPES.values())) if profile == "dash" else vault.content_pages(pages)
    return of.select("name").distinct().join(edges.select(F.col("dst").alias("name")).distinct(), "name", "left_anti")


def most_connected(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(name, inbound) of the pages that most others link to, none if nothing is linked: all of them, or, of pages, the first in order of paths.

    edges: distinct, such as those of the map's graph; for the first, pages of a content type and the dashboard's graph.
    """
    counts = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("inbound"))
    if pages is not None:
        return counts.join(pages.groupBy("name").agg(F.min("path_parts").alias("first")), "name").orderBy(F.desc("inbound"), "first").limit(1).select("name", "inbound")
    return counts.join(F.broadcast(counts.agg(F.max("inbound").alias("inbound"))), "inbound").select("name", "inbound")


def neighbourhood(edges: DataFrame, name: str) -> DataFrame:
    """Names within one link of a page, itself included."""
    near = edges.where((F.col("src") == name) | (F.col("dst") == name))
    return near.select(F.explode(F.array("src", "dst")).alias("name")).union(near.sparkSession.range(1).select(F.lit(name))).distinct()


def frontier(pages: DataFrame, as_of: str, top: int | None = 10, include_zero: bool = False) -> DataFrame:
    """(name, score, out_degree, in_degree, days) by (out - in) * exp(-age / 30), the highest first, ties by name."""
    of = vault.scoreable(pages)
    s = lambda k: F.nullif(F.try_element_at("fm_scalars", F.lit(k)), F.lit(""))
    age = of.select("name", M.days_since(F.coalesce(s("updated"), s("created")), as_of).alias("days"))
    d = degrees(graph(pages, "edge"), of).join(age, "name")
    d = d.withColumn("score", F.round((F.col("out_degree") - F.col("in_degree")) * M.recency(F.col("days")), 4))
    d = (d if include_zero else d.where("score > 0")).select("name", "score", "out_degree", "in_degree", "days").orderBy(F.desc("score"), "name")
    return d.limit(top) if top else d


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
