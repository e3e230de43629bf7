"""Upkeep of links, degrees and issues by changes: what an edit touches is read and written again, nothing else.

The state is a folder of tables, each in parts by the hash of a page's name (of a link's target, for the tables that are looked up
backwards). A change of some pages reads the parts of these pages, of what they link to or did, and of what links to them where
their existence changed. Parts are written as new versions; the manifest names the newest version of each part and is appended
last, so that a run that fails leaves the state of the run before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as M
from ..operators import fixes, rules
from ..operators import links as L
from ..session import children
from ..sources import vault

#: Parts of each table, unless a state is made with another number; it stays with the folder.
BUCKETS = 32
#: Changed files that are read by name; beyond that the whole folder is read once.
BY_NAME = 10_000

_FACTS = "name string, path string, path_parts array<string>, folder string, page_type string, status string, mtime timestamp, length long, hash string"
_MANIFEST = "version long, `table` string, part int, there boolean, buckets int"
TABLES = {
    "facts": (_FACTS, "name"),
    "links": ("name string, path string, dst string, origin string", "name"),
    "back": ("name string, path string, dst string, origin string", "dst"),
    "aims": ("name string, path string, target string, context string", "name"),
    "aimed": ("name string, path string, target string, context string", "target"),
    "degrees": ("name string, out_degree long, in_degree long", "name"),
}
_ISSUES: dict[bool, T.StructType] = {}
#: Rules that look at a page alone; the others follow from the tables.
GRAPH_RULES = ("dead-link", "orphan", "asymmetric-related", "dangling-domain-ref")
LOCAL_RULES = tuple(k for k in ("status-not-in-enum", "invalid-fields", *list(rules.REGISTRY)[1:]) if k not in GRAPH_RULES)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


class State:
    """The newest parts of a state folder, and the writer of the next version. A frame that was read stays right, as parts are never overwritten."""

    def __init__(self, spark: SparkSession, folder: str, templates: DataFrame | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.templates, self.buckets = spark, folder.rstrip("/"), templates, buckets
        if (templates is None) not in _ISSUES:
            none = vault.parsed(spark.createDataFrame([], "path string, text string"))
            found = rules.run_rules(none, templates=templates).schema
            _ISSUES[templates is None] = T.StructType([T.StructField("owner", T.StringType()), *[T.StructField(f.name, f.dataType) for f in found]])
        self.tables = TABLES | {"issues": (_ISSUES[templates is None], "owner")}
        self.parts: dict[tuple[str, int], int] = {}
        self.version = 0
        if children(spark, f"{self.folder}/manifest"):
            rows = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
            for r in rows.groupBy("table", "part").agg(F.max(F.struct("version", "there", "buckets")).alias("m")).collect():  # a row for each part
                self.version, self.buckets = max(self.version, r["m"]["version"]), r["m"]["buckets"]
                self.parts[r["table"], r["part"]] = r["m"]["version"] if r["m"]["there"] else 0
        self.written: list[tuple[str, int, bool]] = []
        self.scanned: dict[str, set[int]] = {}

    def read(self, table: str, parts: set[int] | None = None, now: bool = True) -> DataFrame:
        """The rows of some parts (default: of all). now: with what this run has written; else as the last run left it."""
        schema = self.tables[table][0]
        known = self.parts if now else self.before
        of = sorted(b for t, b in known if t == table and known[t, b] and (parts is None or b in parts))
        self.scanned.setdefault(table, set()).update(of)
        paths = [f"{self.folder}/{table}/{known[table, b]}/b={b}" for b in of]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> None:
        self.before, self.written, self.scanned = dict(self.parts), [], {}

    def write(self, table: str, rows: DataFrame, parts: set[int]) -> None:
        """The next version of these parts, which hold all of rows."""
        schema, key = self.tables[table]
        path = f"{self.folder}/{table}/{self.version + 1}"
        columns = rows.columns if table == "issues" else [f.split()[0] for f in schema.split(", ")]
        rows.select(*columns, self.bucket(key).alias("b")).repartition("b").write.mode("overwrite").partitionBy("b").parquet(path)
        there = {int(x.removeprefix("b=")) for x in children(self.spark, path) if x.startswith("b=")}
        for b in parts:
            self.parts[table, b] = self.version + 1 if b in there else 0
            self.written.append((table, b, b in there))

    def commit(self) -> None:
        self.version += 1
        rows = self.spark.createDataFrame([(self.version, t, b, there, self.buckets) for t, b, there in self.written], _MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def of(self, names: DataFrame, column: str = "name", known: set[int] = frozenset()) -> set[int]:
        """The parts of names; a row for each at most reaches the driver. known: parts that are among them anyhow; if these are all, no name is read."""
        if len(known) == self.buckets:
            return set(known)
        return known | {r[0] for r in names.select(self.bucket(column)).distinct().collect()}


def facts_of(pages: DataFrame) -> DataFrame:
    extra = {"mtime": "timestamp", "length": "long"}
    have = [F.col(c).cast(t).alias(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]
    return pages.select("name", "path", "path_parts", "folder", "page_type", F.try_element_at("fm_scalars", F.lit("status")).alias("status"), *have, F.sha2("text", 256).alias("hash"))


def _links_of(pages: DataFrame) -> DataFrame:
    """(name, path, dst, origin), repeats and raw targets included."""
    keyed = L.raw_links(pages.withColumn("name", F.struct("name", "path")))
    return keyed.select("src.name", "src.path", "dst", "origin")


def _edges(links: DataFrame) -> DataFrame:
    return links.where(~F.col("dst").startswith("raw/") & (F.col("dst") != "")).select("name", "dst").distinct()


def apply(state: State, changes: DataFrame) -> dict:
    """Bring a state up to changes (path, text, and mtime and length where known): a null text deletes a page. Gives version, pages touched and the parts read of each table.

    Equal to the state of a full run over all pages: every rule is evaluated again for the changed pages, dead links and
    dangling domains also for pages that link to a name that came or went, orphans for every page that gained or lost a link,
    one-sided relations for every pair with a changed page. Several changes of a path must be one row. No changes: nothing is written.
    """
    spark = state.spark
    if not changes.limit(1).count():
        return {"version": state.version, "touched": 0, "parts": {}}
    state.begin()
    changes = changes.persist()
    pages = vault.parsed(changes.where("text is not null")).persist()
    try:
        return _apply(spark, state, changes.select("path", stem(F.col("path")).alias("name")), pages)
    finally:
        pages.unpersist()
        changes.unpersist()


def _apply(spark: SparkSession, state: State, touched: DataFrame, pages: DataFrame) -> dict:
    paths, names = touched.select("path").distinct(), touched.select("name").distinct()
    own = state.of(names)

    def without(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
        return df.join(keys, on, "left_anti")

    # Tables by page: the touched pages' rows are replaced.
    fresh = {"facts": facts_of(pages), "links": _links_of(pages), "aims": rules.link_aims(pages).withColumn("name", stem(F.col("path"))).select("name", "path", "target", F.col("origin").alias("context"))}
    for table, rows in fresh.items():
        state.write(table, without(state.read(table, own, now=False), paths, "path").unionByName(rows), own)
    # Tables by target: parts that the touched pages reach now, or did.
    for table, by, key in (("back", "links", "dst"), ("aimed", "aims", "target")):
        ends = state.read(by, own, now=False).unionByName(state.read(by, own)).join(paths, "path", "left_semi").select(key)
        parts = state.of(ends, key)
        new = state.read(by, own).join(paths, "path", "left_semi")
        state.write(table, without(state.read(table, parts, now=False), paths, "path").unionByName(new), parts)
    # Degrees: edges of the touched names that came or went.
    old_edges, new_edges = (_edges(state.read("links", own, now=now).join(names, "name", "left_semi")) for now in (False, True))
    gained = new_edges.join(old_edges, ["name", "dst"], "left_anti").withColumn("d", F.lit(1))
    lost = old_edges.join(new_edges, ["name", "dst"], "left_anti").withColumn("d", F.lit(-1))
    moved = gained.unionByName(lost).persist()
    ends = names.unionByName(moved.select(F.col("dst").alias("name"))).distinct()
    near = state.of(ends, known=own)
    step = moved.select(F.inline(F.array(F.struct(F.col("name"), F.col("d").alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("name"), F.lit(0).alias("o"), F.col("d").alias("i")))))
    step = step.unionByName(state.read("degrees", near, now=False).select("name", F.col("out_degree").alias("o"), F.col("in_degree").alias("i")))
    degrees = step.groupBy("name").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).where("out_degree > 0 or in_degree > 0")
    state.write("degrees", degrees, near)
    # Names that came or went, as pages and as domains.
    was, is_ = state.read("facts", own, now=False).join(names, "name", "left_semi"), state.read("facts", own).join(names, "name", "left_semi")

    def flipped(cond: str) -> DataFrame:
        a, b = was.where(cond).select("name").distinct(), is_.where(cond).select("name").distinct()
        return a.join(b, "name", "left_anti").unionByName(b.join(a, "name", "left_anti"))

    came_or_went, domains = flipped("true").persist(), flipped("folder = 'domains'").persist()
    to_check = state.read("aimed", own).join(came_or_went.select(F.col("name").alias("target")), "target", "left_semi").unionByName(state.read("aims", own).join(paths, "path", "left_semi")).distinct()
    domain_refs = state.read("back", own).where("origin = 'domain'").join(domains.select(F.col("name").alias("dst")), "dst", "left_semi")
    domain_refs = without(domain_refs, paths, "path").unionByName(state.read("links", own).where("origin = 'domain'").join(paths, "path", "left_semi"))
    domain_refs = domain_refs.where(~F.col("dst").startswith("raw/"))
    pairs = [state.read("links", own, now=now).join(names, "name", "left_semi").select(F.col("name").alias("a"), F.col("dst").alias("b"), "origin") for now in (False, True)]
    pairs += [state.read("back", own, now=now).join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("name").alias("a"), F.col("dst").alias("b"), "origin") for now in (False, True)]
    related = [p.where("origin = 'related' and a <> b").select("a", "b").distinct() for p in pairs]
    now_related = related[1].unionByName(related[3]).distinct().persist()
    # What is no longer known to hold, by the page that it is about.
    owners = [names, to_check.select("name"), domain_refs.select("name"), ends, *[r.select(F.col("a").alias("name")) for r in related]]
    parts = state.of(reduce(DataFrame.unionByName, owners), known=own)
    issues = state.read("issues", parts, now=False)
    issues = without(issues, paths.select(F.col("path").alias("where")), "where")
    gone = came_or_went.select(F.lit("dead-link").alias("type"), F.concat(F.lit("[["), F.col("name"), F.lit("]]")).alias("what"))
    issues = without(issues, gone, ["type", "what"])
    issues = without(issues, domains.select(F.lit("dangling-domain-ref").alias("type"), F.col("name").alias("missing_domain")), ["type", "missing_domain"])
    issues = without(issues, ends.select(F.lit("orphan").alias("type"), F.col("name").alias("owner")), ["type", "owner"])
    for side in ("page_a", "page_b"):
        issues = issues.withColumn("_side", F.coalesce(stem(F.col(side)), F.lit("/"))).join(names.select(F.col("name").alias("_side")), "_side", "left_anti").drop("_side")
    # What holds now.
    seq = {k: i for i, k in enumerate(_order(state))}
    found = [rules.run_rules(pages, only=k, templates=state.templates).withColumn("owner", stem(F.col("where"))) for k in LOCAL_RULES if k in seq]
    every = own if len(own) == state.buckets else set()  # a change of all parts reads all; which of them don't matter isn't looked for
    near_targets = state.of(to_check.select("target").unionByName(domain_refs.select(F.col("dst").alias("target"))), "target", known=every)
    known = state.read("facts", near_targets)
    dead = to_check.join(known.select(F.col("name").alias("target")).distinct(), "target", "left_anti")
    found.append(dead.select(F.lit("dead-link").alias("type"), F.col("path").alias("where"), F.concat(F.lit("[["), "target", F.lit("]]")).alias("what"), "context", F.col("name").alias("owner")))
    dangling = domain_refs.join(known.where("folder = 'domains'").select(F.col("name").alias("dst")).distinct(), "dst", "left_anti")
    found.append(dangling.select(F.lit("dangling-domain-ref").alias("type"), F.col("path").alias("where"), F.col("dst").alias("missing_domain"), F.col("name").alias("owner")))
    around = state.read("facts", near).join(ends, "name", "left_semi")
    t, deprecated = F.coalesce("page_type", F.lit("")), F.coalesce(F.col("status") == "deprecated", F.lit(False))
    lonely = around.where((t != "meta") & (F.col("folder") != "") & ~deprecated).select("name").distinct().join(state.read("degrees", near).where("in_degree > 0").select("name"), "name", "left_anti")
    found.append(around.join(lonely, "name", "left_semi").select(F.lit("orphan").alias("type"), F.col("path").alias("where"), F.col("name").alias("owner")))
    others = state.of(now_related.select(F.explode(F.array("a", "b")).alias("name")), known=every)
    newest = state.read("facts", others).groupBy("name").agg(F.max_by(F.struct("path", F.col("page_type").alias("t")), "path_parts").alias("p")).select("name", "p.path", "p.t")
    rel = now_related
    for k in "ab":
        rel = rel.join(newest.select(F.col("name").alias(k), F.col("path").alias(f"page_{k}"), F.col("t").alias(f"page_{k}_type")), k)
    open_ = rel.where("coalesce(page_a_type, '') <> 'mind' and coalesce(page_b_type, '') <> 'mind'").join(rel.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    found.append(open_.select(F.lit("asymmetric-related").alias("type"), "page_a", "page_b", "page_a_type", "page_b_type", F.col("a").alias("owner")))
    new = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [issues.limit(0), *found])
    order = F.create_map(*[F.lit(x) for kv in seq.items() for x in kv])
    state.write("issues", issues.unionByName(new.withColumn("rule_seq", order[F.col("type")]).select(*issues.columns)), parts)
    n = paths.count()
    for df in (moved, came_or_went, domains, now_related):
        df.unpersist()
    state.commit()
    return {"version": state.version, "touched": n, "parts": {k: len(v) for k, v in state.scanned.items()}}


def _order(state: State) -> list[str]:
    """The rules as run_rules numbers them."""
    keys = list(rules.REGISTRY)
    return keys if state.templates is None else [keys[0], "invalid-fields", *keys[1:]]


def open_issues(state: State) -> DataFrame:
    return state.read("issues").drop("owner")


def detect(state: State, wiki: str, thorough: bool = False) -> DataFrame:
    """changes since the last run: of a listing's files those that are new or have another time or size, with texts, and stored pages that are gone, with nulls.

    No text of the others is read. thorough: all texts are, and compared by hashes; for edits that keep a file's size and time.
    """
    spark = state.spark
    stored = state.read("facts").select("path", F.col("mtime").alias("_mtime"), F.col("length").alias("_length"), "hash")
    listed = vault.pages_only(vault.files(spark, wiki, "*.md", content=False, length=True))
    gone = stored.join(listed, "path", "left_anti").select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("long").alias("length"))
    if thorough:
        texts = vault.pages_only(vault.files(spark, wiki, "*.md", length=True)).join(stored, "path", "left")
        return texts.where(F.col("hash").isNull() | (F.sha2(M.unix_lines(F.col("text")), 256) != F.col("hash"))).select("path", "text", "mtime", "length").unionByName(gone)
    other = listed.join(stored, "path", "left").where(F.col("hash").isNull() | ~F.col("mtime").eqNullSafe(F.col("_mtime")) | ~F.col("length").eqNullSafe(F.col("_length"))).select("path")
    few = other.limit(BY_NAME + 1)
    named = [r["path"] for r in few.collect()]  # bounded by BY_NAME
    if len(named) <= BY_NAME:
        if not named:
            return gone
        texts = vault.files(spark, wiki, "*.md", length=True, only=named)
    else:
        texts = vault.files(spark, wiki, "*.md", length=True).join(other, "path", "left_semi")
    return texts.select("path", "text", "mtime", "length").unionByName(gone)


def settle(spark: SparkSession, wiki: str, folder: str, templates: DataFrame | None = None, thorough: bool = False) -> dict:
    """Detect and apply changes, mend what has a fix, write the mended pages, and apply these again; what stays open is then right for the new texts.

    Only pages with a fixable issue are read for the fixes. Gives the runs' numbers and the (path, fix) pairs that were applied.
    """
    state = State(spark, folder, templates)
    first = apply(state, detect(state, wiki, thorough))
    issues = open_issues(state)
    fixable = [r[0] for r in issues.where(F.col("type").isin(*fixes.HANDLERS)).select("where").distinct().limit(BY_NAME).collect()]
    if not fixable:
        return {"first": first, "second": None, "applied": []}
    texts = vault.files(spark, wiki, "*.md", only=sorted(fixable))
    mended = fixes.apply_fixes(vault.parsed(texts), issues).where("new_text <> text").persist()
    applied = [(r["path"], k) for r in mended.select("path", "applied").orderBy("path").toLocalIterator() for k in r["applied"]]
    vault.write_changed(mended, wiki)
    mended.unpersist()
    second = apply(state, detect(state, wiki, thorough=False)) if applied else None
    return {"first": first, "second": second, "applied": applied}
