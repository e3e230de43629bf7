"""Pages, sources, states and files as DataFrames, and the sinks that write them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as M
from ..functions.header import entries
from ..session import Tables

# Folders and names that scans leave out, and file kinds.
SKIPPED_FOLDERS = ("lint-reports", "snapshots", "kn-maps")
SKIPPED_META = r"^meta/(lint-report-|knowledge-map-|snapshot-)"
ROOT_PAGES = ("index", "log", "cache", "summary")
FOLDER_TYPES = {"ideas": "idea", "entities": "entity", "questions": "question", "domains": "domain", "minds": "mind"}
BINARY = (".pdf", ".docx", ".doc", ".mp3", ".wav", ".m4a", ".ogg", ".flac", ".mp4", ".mov", ".avi", ".mkv", ".webm", ".pptx", ".ppt", ".xlsx", ".xls")

EMBED_RECORD = T.StructType([T.StructField("hash", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])


def parsed(texts: DataFrame) -> DataFrame:
    """texts (path, text) as pages: folder, name, body, header fields and page_type. path is relative, such as ideas/X.md."""
    t = texts.withColumn("text", M.unix_lines(F.col("text"))).withColumn("path_parts", F.split("path", "/"))
    t = t.withColumns({"has_fm": M.has_header(F.col("text")), "fm_raw": M.header(F.col("text")), "body": M.body(F.col("text"))})
    t = t.withColumn("folder", F.when(F.size("path_parts") > 1, F.get("path_parts", F.lit(0))).otherwise("")).withColumn("name", F.regexp_replace(F.element_at("path_parts", -1), r"\.md$", ""))
    t = t.withColumn("_f", M.header_fields("fm_raw"))
    out = t.select("path", "path_parts", "folder", "name", "text", "body", "has_fm", "fm_raw", *[F.col(f"_f.{k}").alias(f"fm_{k}" if k != "inline_lists" else k) for k in ("scalars", "lists", "keys", "inline_lists")], *[c for c in texts.columns if c not in ("path", "text")])
    return out.withColumn("page_type", F.try_element_at("fm_scalars", F.lit("type"))).withColumn("fm_end_line", F.when(F.col("has_fm"), F.size(F.split("fm_raw", "\n")) + 2))


def files(spark: SparkSession, root: str, glob: str = "*", content: bool = True, length: bool = False, only: list[str] | None = None) -> DataFrame:
    """(path relative to root, mtime, text) of all files below root, or of some paths; without content no bytes are read. length: their sizes, too.

    An empty file has no row here, as Spark's file sources leave those out; the format `notes` has one.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    df = reader.option("recursiveFileLookup", "true").load(root) if only is None else reader.load([f"{root.rstrip('/')}/{p}" for p in only])
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^\\Q" + base + "\\E/", "")
    return df.select(path.alias("path"), F.col("modificationTime").alias("mtime"), *(["length"] if length else []), *([F.decode("content", "UTF-8").alias("text")] if content else []))


def pages_only(listing: DataFrame) -> DataFrame:
    """A wiki's listing less generated reports."""
    return listing.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))).where(~F.col("path").rlike(SKIPPED_META))


def read_pages(spark: SparkSession, wiki: str) -> DataFrame:
    """All pages of a wiki but generated reports, parsed."""
    return parsed(pages_only(files(spark, wiki, "*.md")))


def read_raw(spark: SparkSession, raw: str) -> DataFrame:
    """(path, text) of the sources, without formats/ and meta/."""
    return files(spark, raw, "*.md").where(~F.split("path", "/")[0].isin("formats", "meta"))


def catalog(pages: DataFrame) -> DataFrame:
    """name to (path, folder); the last path wins where names repeat."""
    return pages.groupBy("name").agg(F.max_by(F.struct("path", "folder"), "path_parts").alias("p")).select("name", "p.path", "p.folder")


def scoreable(pages: DataFrame) -> DataFrame:
    """Pages that the frontier scores: no meta or domain type, no root page, nothing below a folder of reports."""
    t = F.coalesce(F.col("page_type"), F.lit(""))
    parents = F.slice("path_parts", F.lit(1), F.size("path_parts") - 1)
    return pages.where(~t.isin("meta", "domain") & ~F.col("name").isin(*ROOT_PAGES) & ~F.arrays_overlap(parents, F.array(*map(F.lit, ("meta", *SKIPPED_FOLDERS)))))


def content_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.coalesce("page_type", F.lit("")) != "meta") & ~F.col("folder").isin("", "meta"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(name, hash, vec, model) of an index file; records without a vector are left out, a broken file gives no rows."""
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("items", T.MapType(T.StringType(), EMBED_RECORD))])
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    return df.select("model", F.explode("items").alias("name", "r")).select("name", "r.hash", "r.vec", "model").where("vec is not null")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History entries; blank and broken lines are left out."""
    schema = "ts string, `trigger` string, pages long, wikilinks long, orphans long, Q double, communities long, bridges long, sim_p50 double, sim_p75 double, sim_p95 double, types map<string,long>, domains map<string,long>, cohesion map<string,double>, pages_list array<string>, delta struct<pages_added:array<string>,pages_removed:array<string>,wikilinks:long,orphans:long,Q:double>, _corrupt_record string"
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.where("_corrupt_record is null and ts is not null").drop("_corrupt_record")


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """(type, field, entry) of the few template files, from any path that Spark can read; a file without a header gives none."""
    few = files(spark, folder, "*.md").select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("type"), M.header(M.unix_lines(F.col("text"))).alias("raw")).where("raw <> ''")
    rows = [(r["type"], field, entry.rstrip()) for r in few.collect() for field, entry in dict(entries(r["raw"])).items() if field]
    return spark.createDataFrame(rows, "type string, field string, entry string")


def read_any_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(name, vec) of an index in any of its shapes: records by name, below `items` or at the top, each a vector or an object with one;
    or a list of objects with path, key or name, and vec or vector. name is the stem of a key. What has no name or vector is left out."""
    vec = T.ArrayType(T.DoubleType())
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    items = F.coalesce(F.get_json_object("t", "$.items"), F.col("t"))
    one = text.select(items.alias("j"))
    record = T.StructType().add("path", "string").add("key", "string").add("name", "string").add("vec", vec).add("vector", vec)
    listed = one.where(F.col("j").rlike(r"^\s*\[")).select(F.explode(F.from_json("j", T.ArrayType(T.StringType()))).alias("e")).select(F.from_json("e", record).alias("r"))
    listed = listed.select(F.coalesce(*[F.nullif(f"r.{k}", F.lit("")) for k in ("path", "key", "name")]).alias("key"), F.coalesce("r.vec", "r.vector").alias("vec"))
    keyed = one.where(F.col("j").rlike(r"^\s*\{")).select(F.explode(F.from_json("j", T.MapType(T.StringType(), T.StringType()))).alias("key", "v"))
    inner = F.when(F.col("v").rlike(r"^\s*\{"), F.get_json_object("v", "$.vec")).when(F.col("v").rlike(r"^\s*\["), F.col("v"))
    both = listed.unionByName(keyed.select("key", F.from_json(inner, vec).alias("vec"))).where("key is not null and size(vec) > 0")
    return both.select(F.regexp_replace(F.element_at(F.split("key", "/"), -1), r"(?<=.)\.[^.]*$", "").alias("name"), "vec")


def latest_snapshots(listing: DataFrame) -> DataFrame:
    """One row (date, umap, graph): the newest dated maps by name among files (path); of one date the last name. Nulls without any."""
    name = F.element_at(F.split("path", "/"), -1)

    def newest(kinds: str) -> Column:
        date = F.regexp_extract(name, rf"^(?:{kinds})-(\d{{4}}-\d{{2}}-\d{{2}})\.html$", 1)
        return F.max(F.when(date != "", F.struct(date.alias("date"), name.alias("file"))))

    out = listing.agg(newest("snapshot|knowledge-map").alias("u"), newest("snapshot-graph|wiki-graph").alias("g"))
    return out.select(F.col("u.date").alias("date"), F.col("u.file").alias("umap"), F.col("g.file").alias("graph"))


def last_operation(log: Column) -> Column:
    """The operation of the first dated heading of a log, lower-cased; null without one."""
    return F.nullif(F.lower(F.regexp_extract(log, r"(?m)^##\s+\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2})?\s*[—\-–]\s*([\w/]+)", 1)), F.lit(""))


def write_changed(df: DataFrame, wiki: str) -> list[str]:
    """Write new_text of rows where it differs from text to wiki/path, all or none of them; paths written. Tasks write; the paths of a run's changes reach the driver."""
    from . import notes

    tables = Tables(df.sparkSession)
    changed = tables.write(df.where("new_text <> text").select("path", F.col("new_text").alias("text")))  # as it was read, before a page changes
    out = sorted(r["path"] for r in changed.select("path").toLocalIterator())
    if out:
        notes.register(df.sparkSession)
        changed.write.format("notes").mode("append").save(wiki)
    tables.drop_all()
    return out


def names_in(folder: str) -> list[str]:
    """Names of the files directly in a folder; none where it isn't there."""
    from . import journal

    fs, base = journal.store(folder)
    if fs.get_file_info(base).type.name != "Directory":
        return []
    return sorted(i.base_name for i in fs.get_file_info(journal.afs.FileSelector(base)) if i.type.name == "File")


def write_version(df: DataFrame, folder: str, version: str) -> str:
    """Write a new version beside the old ones, so that a plan which reads the old one stays right."""
    path = f"{folder.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path
