"""Saved views as filters, groups and orders over pages; index and dashboard payloads."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..operators import links as L
from ..sources import vault


@dataclass(frozen=True)
class ViewSpec:
    """A declarative view: SQL conditions that must all hold, formulas, columns, and an order."""

    name: str
    filters: tuple[str, ...] = ()
    formulas: dict[str, str] = field(default_factory=dict)
    columns: tuple[str, ...] = ("name", "type", "status", "tags", "updated")
    group_by: str | None = None
    sort: tuple[str, ...] = ()

    def build(self, rows: DataFrame) -> DataFrame:
        for f in self.filters:
            rows = rows.where(f)
        rows = rows.withColumns({k: F.expr(v) for k, v in self.formulas.items()}) if self.formulas else rows
        order = [*([self.group_by] if self.group_by else []), *self.sort]
        rows = rows.select(*dict.fromkeys([*self.columns, *([self.group_by] if self.group_by else [])]), *[s.split()[0] for s in self.sort if s.split()[0] not in self.columns])
        return rows.orderBy(*[F.desc(s.split()[0]) if s.endswith(" desc") else F.col(s.split()[0]) for s in order]) if order else rows


# The global views.
AGE = {"age_days": "round((unix_timestamp(as_of) - unix_timestamp(mtime)) / 86400)"}
GLOBAL_VIEWS = (
    ViewSpec("recent_activity", formulas=AGE, columns=("name", "type", "status", "domain", "updated", "age_days"), sort=("domain desc",)),
    ViewSpec("ideas", ("folder = 'ideas'",), columns=("name", "status", "domain", "tags", "updated")),
    ViewSpec("entities", ("folder = 'entities'",), columns=("name", "entity_type", "status", "domain", "updated"), group_by="entity_type"),
    ViewSpec("questions", ("folder = 'questions'",), columns=("name", "status", "answer_quality", "updated")),
    ViewSpec("domains", ("folder = 'domains'",), columns=("name", "updated")),
    ViewSpec("minds", ("folder = 'minds'",), columns=("name", "status", "seed", "updated")),
    ViewSpec("needs_development", ("status in ('evaluation', 'in-progress')",), columns=("name", "type", "status", "updated")),
)


def rows_of(pages: DataFrame, as_of: str | None = None) -> DataFrame:
    """Pages of the content folders with header fields as columns; domain: the list's items joined. as_of and mtime, where pages have it, give ages."""
    s = lambda k: F.try_element_at("fm_scalars", F.lit(k)).alias(k)
    lists = lambda k: F.try_element_at("fm_lists", F.lit(k))
    mtime = F.col("mtime") if "mtime" in pages.columns else F.lit(None)
    fields = [s(k) for k in ("status", "updated", "entity_type", "summary", "answer_quality", "seed")]
    return pages.where(F.col("folder").isin(*vault.FOLDER_TYPES)).select("name", "folder", "path", F.col("page_type").alias("type"), *fields, lists("tags").alias("tags"), F.array_join(lists("domain"), ", ").alias("domain"), mtime.cast("timestamp").alias("mtime"), F.lit(as_of).cast("timestamp").alias("as_of"))


def register(pages: DataFrame) -> list[str]:
    """A temporary view for each global view, and `pages` itself: the SQL surface."""
    pages.createOrReplaceTempView("pages")
    rows = rows_of(pages)
    for v in GLOBAL_VIEWS:
        v.build(rows).createOrReplaceTempView(v.name)
    return ["pages", *[v.name for v in GLOBAL_VIEWS]]


def domain_view(pages: DataFrame, domain: str) -> DataFrame:
    """Pages with a link to a domain, domains and meta left out, by type."""
    linked = L.raw_links(pages).where(F.col("dst") == domain).select(F.col("src").alias("name")).distinct()
    return ViewSpec("domain", ("folder <> 'domains'",), group_by="type", sort=("name",)).build(rows_of(pages).join(linked, "name", "left_semi"))


# Sections in order with their folders, the table's head, and what stands for nothing.
INDEX_SECTIONS = (("Ideas", "ideas"), ("Entities", "entities"), ("Domains", "domains"), ("Questions", "questions"), ("Minds", "minds"))
INDEX_HEAD, INDEX_EMPTY, INDEX_MISSING = "| Страница | Суть |\n|---|---|\n", "\n_Пусто._\n", "_(нет summary в frontmatter)_"


def index_page(pages: DataFrame, as_of: str, preamble: str = "# Index\n\nUpdated {as_of}\n") -> DataFrame:
    """One row, text: a table of names and summaries for each section, names in order; empty sections stand, too."""
    of = pages.where(F.col("folder").isin(*vault.FOLDER_TYPES) & (F.size("path_parts") == 2))
    s = M.single_field(F.col("text"), "summary")
    line = F.concat(F.lit("| [["), F.col("name"), F.lit("]] | "), F.when(s != "", s).otherwise(INDEX_MISSING), F.lit(" |\n"))
    rows = of.agg(*[F.sort_array(F.collect_list(F.when(F.col("folder") == f, F.struct("name", line.alias("line"))))).alias(f) for _, f in INDEX_SECTIONS])
    block = lambda title, f: F.concat(F.lit(f"\n## {title}\n\n{INDEX_HEAD}"), F.when(F.size(f) > 0, F.array_join(F.col(f)["line"], "")).otherwise(INDEX_EMPTY))
    return rows.select(F.concat(F.lit(preamble.format(as_of=as_of)), *[block(t, f) for t, f in INDEX_SECTIONS]).alias("text"))


def write_text(text: str, path: str, replace: bool = True) -> bool:
    """Write a local file if it isn't there, or, with replace, if its text is another; whether it was written."""
    p = Path(path)
    if p.exists() and (not replace or p.read_text() == text):
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return True


def view_files(pages: DataFrame) -> DataFrame:
    """(file, spec): a file for each domain page, and one for the global views, with what ViewSpec needs as JSON."""
    json_of = lambda v: json.dumps({"name": v.name, "filters": v.filters, "formulas": v.formulas, "columns": v.columns, "group_by": v.group_by, "sort": v.sort}, ensure_ascii=False)
    of = pages.where((F.col("folder") == "domains") & (F.size("path_parts") == 2))
    named = F.to_json(F.struct(F.concat(F.lit("All "), M.abbreviation(F.col("name")), F.lit(" pages")).alias("name"), F.col("name").alias("links_to"), F.array(F.lit("folder <> 'domains'")).alias("filters"), F.lit("type").alias("group_by")))
    every = pages.sparkSession.range(1).select(F.lit("dashboard").alias("file"), F.lit("[" + ", ".join(map(json_of, GLOBAL_VIEWS)) + "]").alias("spec"))
    return of.select(F.col("name").alias("file"), named.alias("spec")).unionByName(every)


def write_views(pages: DataFrame, folder: str) -> list[str]:
    """Write files of views that aren't there yet, and never over one; the names written."""
    return sorted(r["file"] for r in view_files(pages).toLocalIterator() if write_text(r["spec"], f"{folder}/{r['file']}.json", replace=False))


def index_summaries(index_text: DataFrame) -> DataFrame:
    """(name, summary) read back from an index's tables (path, text) under the four headings that are read; the last row of a name wins."""
    from pyspark.sql import Window

    lines = index_text.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    h = F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1)
    lines = lines.withColumn("section", F.last(F.when(h != "", h), ignorenulls=True).over(Window.partitionBy("path").orderBy("pos")))
    cells = F.split(F.replace("line", F.lit("\\|"), F.lit("\u0001")), r"\|")
    rows = lines.where(F.col("section").isin("Ideas", "Entities", "Questions", "Domains") & F.col("line").startswith("|")).select("pos", F.regexp_extract(F.get(cells, F.lit(1)), M.WIKILINK, 1).alias("name"), F.replace(M.strip(F.get(cells, F.lit(2))), F.lit("\u0001"), F.lit("|")).alias("summary"))
    return rows.where("name <> ''").groupBy("name").agg(F.max_by("summary", "pos").alias("summary"))


def map_elements(nodes: DataFrame, edges: DataFrame, part: DataFrame) -> DataFrame:
    """(kind, json) of communities, nodes and edges for a graph view. nodes: (name, page_type, color, size)."""
    data = lambda *c: F.to_json(F.struct(F.struct(*c).alias("data")))
    groups = part.select("community").distinct().select(F.lit("community").alias("kind"), data(F.concat(F.lit("c"), "community").alias("id")).alias("json"))
    placed = nodes.join(part, "name", "left").select(F.lit("node").alias("kind"), data(F.col("name").alias("id"), F.concat(F.lit("c"), "community").alias("parent"), "page_type", "color", "size").alias("json"))
    return groups.unionByName(placed).unionByName(edges.select(F.lit("edge").alias("kind"), data(F.col("a").alias("source"), F.col("b").alias("target")).alias("json")))


def safe_json(payload: Column) -> Column:
    """JSON that can stand in a script element."""
    return F.replace(F.to_json(payload), F.lit("</"), F.lit("<\\/"))
