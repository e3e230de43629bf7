"""Saved-view files: filters, formulas, groups and orders as YAML, read into conditions over rows of pages, and written from such views."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..operators import links as L
from ..sources import notes, vault

try:  # files are YAML; without its reader they can be written, not read
    import yaml
except ImportError:
    yaml = None

#: A condition: text, or ("and" | "or" | "not", conditions).
Condition = str | tuple[str, list]


@dataclass
class BaseView:
    """One view of a file: its kind, filter, group (property, descending), columns and sort."""

    name: str
    kind: str = "table"
    filters: Condition | None = None
    group: tuple[str, bool] | None = None
    columns: list[str] = field(default_factory=list)
    sort: list[tuple[str, bool]] = field(default_factory=list)


@dataclass
class Base:
    views: list[BaseView]
    filters: Condition | None = None
    formulas: dict[str, str] = field(default_factory=dict)


def _tree(node) -> Condition | None:
    """A condition of what YAML gives: a text, a list (all of it), or and, or, not with lists; several keys must all hold."""
    if node is None or isinstance(node, str):
        return node
    if isinstance(node, list):
        return ("and", [_tree(x) for x in node])
    if isinstance(node, dict) and node and set(node) <= {"and", "or", "not"}:
        parts = [(k, [_tree(x) for x in (v if isinstance(v, list) else [v])]) for k, v in node.items()]
        return parts[0] if len(parts) == 1 else ("and", parts)
    raise ValueError(f"not a filter: {node!r}")


def parse(text: str) -> Base:
    """A file's views. What is no view file is a ValueError."""
    if yaml is None:
        raise RuntimeError("reading view files needs PyYAML")
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError("not YAML") from e
    if not isinstance(doc, dict) or not isinstance(doc.get("views"), list):
        raise ValueError("no views")
    down = lambda x: str(x.get("direction", "ASC")).upper() == "DESC"
    views = []
    for v in doc["views"]:
        g = v.get("groupBy")
        views.append(BaseView(v.get("name", ""), v.get("type", "table"), _tree(v.get("filters")), (g["property"], down(g)) if g else None, list(v.get("order") or []), [(s["property"], down(s)) for s in v.get("sort") or []]))
    return Base(views, _tree(doc.get("filters")), dict(doc.get("formulas") or {}))


_CALL = re.compile(r'^file\.(inFolder|hasLink|hasTag)\(\s*("(?:[^"\\]|\\.)*")\s*\)$')
_COMPARED = re.compile(r'^([A-Za-z_][\w.]*)\s*(==|!=|>=|<=|>|<)\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?)$')
_AGE = re.compile(r"^\(now\(\)\s*-\s*file\.(mtime)\)\.days(?:\.round\((\d+)\))?$")
#: Names of file properties, by columns of rows().
_FILE = {"file.name": "name", "file.path": "path", "file.folder": "folder", "file.mtime": "mtime"}


def _property(name: str) -> Column:
    if name == "file.ext":
        return F.regexp_extract("path", r"\.([^./]+)$", 1)
    return F.col(_FILE.get(name, name.removeprefix("note.").removeprefix("formula.")))


def condition(c: Condition) -> Column:
    """A filter as a column; a comparison with a property that a page lacks doesn't hold. A text of no known form is a ValueError."""
    if isinstance(c, tuple):
        parts = [condition(x) for x in c[1]]
        if c[0] == "not":
            parts = [~p for p in parts]
        out = F.lit(c[0] != "or")
        for p in parts:
            out = (out | p) if c[0] == "or" else (out & p)
        return out
    text = c.strip()
    if m := _CALL.match(text):
        value = json.loads(m[2])
        if m[1] == "inFolder":
            return F.concat(F.lit("wiki/"), "path").startswith(value.rstrip("/") + "/")
        return F.array_contains("links" if m[1] == "hasLink" else F.coalesce("tags", F.array().cast("array<string>")), value.removeprefix("#") if m[1] == "hasTag" else value)
    if m := _COMPARED.match(text):
        a, b = _property(m[1]), F.lit(json.loads(m[3]))
        held = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[m[2]]
        return F.coalesce(held, F.lit(m[2] == "!="))
    raise ValueError(f"not a condition: {text!r}")


def formula(text: str) -> Column:
    """A formula as a column; ages in days are the ones known."""
    if m := _AGE.match(text.strip()):
        days = (F.unix_timestamp("as_of") - F.unix_timestamp(m[1])) / 86400
        return F.round(days, int(m[2])) if m[2] else days
    raise ValueError(f"not a formula: {text!r}")


def rows(pages: DataFrame, as_of: str | None = None) -> DataFrame:
    """Pages with what conditions name: header fields as columns (tags a list, domain its items joined), links by name, path and mtime, and as_of."""
    s = lambda k: F.try_element_at("fm_scalars", F.lit(k)).alias(k)
    lists = lambda k: F.try_element_at("fm_lists", F.lit(k))
    mtime = (F.col("mtime") if "mtime" in pages.columns else F.lit(None)).cast("timestamp").alias("mtime")
    keyed = L.raw_links(pages.withColumn("name", F.col("path"))).groupBy(F.col("src").alias("path")).agg(F.collect_set("dst").alias("links"))
    fields = [s(k) for k in ("status", "updated", "created", "entity_type", "summary", "answer_quality", "seed", "provenance")]
    out = pages.select("name", "path", "folder", F.col("page_type").alias("type"), *fields, lists("tags").alias("tags"), F.array_join(lists("domain"), ", ").alias("domain"), mtime, F.lit(as_of).cast("timestamp").alias("as_of"))
    return out.join(keyed, "path", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def build(base: Base, view: BaseView, of: DataFrame) -> DataFrame:
    """A view's rows: the file's filter and its own, columns in order (file.name is name, formulas by their names), by group and sort."""
    for c in (base.filters, view.filters):
        if c is not None:
            of = of.where(condition(c))
    of = of.withColumns({k: formula(v) for k, v in base.formulas.items()})
    order = ([view.group] if view.group else []) + view.sort
    names = {c: c.rsplit(".", 1)[-1] for c in [*view.columns, *([view.group[0]] if view.group else [])]}
    hidden = {f"_o{i}": _property(p) for i, (p, _) in enumerate(order)}
    out = of.select(*[_property(c).alias(n) for c, n in names.items()], *[c.alias(k) for k, c in hidden.items()])
    out = out.orderBy(*[F.desc(k) if desc else F.asc(k) for k, (_, desc) in zip(hidden, order)], "name") if order and "name" in names.values() else out
    return out.drop(*hidden)


# Writing


def _lines(c: Condition, depth: int) -> list[str]:
    pad = "  " * depth
    if isinstance(c, str):
        return [f"{pad}- {c}"]
    inner = [line for x in c[1] for line in _lines(x, depth + 2)]
    return [f"{pad}- {c[0]}:", *inner]


def text_of(base: Base, labels: dict[str, str] | None = None) -> str:
    """A file of these views; labels: shown names of properties. parse() gives the views back."""
    out: list[str] = []

    def filters(c: Condition | None, depth: int) -> None:
        if c is not None:
            kind, parts = c if isinstance(c, tuple) else ("and", [c])
            out.append("  " * depth + "filters:")
            out.append("  " * (depth + 1) + f"{kind}:")
            for p in parts:
                out.extend(_lines(p, depth + 2))

    filters(base.filters, 0)
    if base.formulas:
        out.append("formulas:")
        out.extend(f"  {k}: {v}" for k, v in base.formulas.items())
    if labels:
        out.append("properties:")
        for k, v in labels.items():
            out += [f"  {k}:", f"    displayName: {v}"]
    out.append("views:")
    for v in base.views:
        out += [f"  - type: {v.kind}", f"    name: {v.name}"]
        filters(v.filters, 2)
        if v.group:
            out += ["    groupBy:", f"      property: {v.group[0]}", f"      direction: {'DESC' if v.group[1] else 'ASC'}"]
        out += ["    order:", *[f"      - {c}" for c in v.columns]]
        if v.sort:
            out.append("    sort:")
            for p, desc in v.sort:
                out += [f"      - property: {p}", f"        direction: {'DESC' if desc else 'ASC'}"]
    return "\n".join(out) + "\n"


def _in(*folders: str) -> list[Condition]:
    return [f'file.inFolder("wiki/{f}")' for f in folders]


# The seven views over all pages, their order and columns, and what a domain's file has.
AGE = "formula.age_days"
GLOBAL = Base(
    [
        BaseView("Recent Activity", columns=["file.name", "type", "status", "domain", "updated", AGE], sort=[("domain", True)]),
        BaseView("Ideas", filters=("and", _in("ideas")), columns=["file.name", "status", "domain", "tags", "updated"]),
        BaseView("Entities", filters=("and", _in("entities")), group=("entity_type", False), columns=["file.name", "entity_type", "status", "domain", "updated"]),
        BaseView("Questions", "list", ("and", _in("questions")), columns=["file.name", "status", "answer_quality", "updated"]),
        BaseView("Domains", "list", ("and", _in("domains")), columns=["file.name", "updated"]),
        BaseView("Minds", "list", ("and", _in("minds")), columns=["file.name", "status", "seed", "updated"]),
        BaseView("Needs Development", "list", ("and", [("or", ['status == "evaluation"', 'status == "in-progress"'])]), columns=["file.name", "type", "status", "updated"]),
    ],
    ("and", ['file.ext == "md"', ("or", _in("ideas", "entities", "questions", "domains", "minds"))]),
    {"age_days": "(now() - file.mtime).days.round(0)"},
)
LABELS = {"type": "Type", "status": "Status", "updated": "Updated", "domain": "Domain", "tags": "Tags", AGE: "Возраст (дней)"}
DOMAIN_COLUMNS = ["file.name", "type", "status", "tags", "updated"]


def domain_base(name: str, abbreviation: str) -> Base:
    linked = f"file.hasLink({json.dumps(name, ensure_ascii=False)})"
    out = ("and", ['file.inFolder("wiki/")', linked, ("not", ['file.inFolder("wiki/domains/")', 'file.inFolder("wiki/meta/")'])])
    return Base([BaseView(f"Все {abbreviation}-страницы", group=("type", False), columns=DOMAIN_COLUMNS)], out)


def files(pages: DataFrame) -> DataFrame:
    """(path, text) of the file of each domain page, and of the global one. A vault's domains are few to many; each is a row that a task makes."""
    of = pages.where((F.col("folder") == "domains") & (F.size("path_parts") == 2)).select("name", M.abbreviation(F.col("name")).alias("abbr"))

    def made(batches):
        for pdf in batches:
            pdf["text"] = [text_of(domain_base(n, a)) for n, a in zip(pdf["name"], pdf["abbr"])]
            pdf["path"] = pdf["name"] + ".base"
            yield pdf[["path", "text"]]

    every = pages.sparkSession.createDataFrame([("dashboard.base", text_of(GLOBAL, LABELS))], "path string, text string")
    return of.mapInPandas(made, "path string, text string").unionByName(every)


def write_missing(pages: DataFrame, folder: str) -> list[str]:
    """Write the files that aren't in folder yet, all or none of them, and never over one; the names written."""
    spark: SparkSession = pages.sparkSession
    there = vault.names_in(folder)
    new = files(pages).join(spark.createDataFrame([(n,) for n in there], "path string"), "path", "left_anti").persist()
    try:
        names = sorted(r["path"] for r in new.select("path").toLocalIterator())
        if names:
            notes.register(spark)
            new.write.format("notes").mode("append").save(folder)
        return names
    finally:
        new.unpersist()
