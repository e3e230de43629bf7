"""The embedding indexes of pages and sources, brought up together: both are written as a new version, then one pointer is moved."""

from __future__ import annotations

import json

from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..operators import vectors as V
from . import journal

KINDS = ("wiki", "raw")
INDEX = "name string, hash string, vec array<double>, model string"


def current(folder: str) -> dict:
    """The pointer: version (0 before the first), model and counts."""
    fs, base = journal.store(folder)
    if fs.get_file_info(f"{base}/current.json").type != afs.FileType.File:
        return {"version": 0, "model": None, "counts": {k: 0 for k in KINDS}}
    with fs.open_input_stream(f"{base}/current.json") as f:
        return json.loads(f.read())


def read_index(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(name, hash, vec, model) of the current version; empty before the first."""
    version = current(folder)["version"]
    return spark.read.schema(INDEX).parquet(f"{folder}/{version:08d}/{kind}") if version else spark.createDataFrame([], INDEX)


def texts_of(pages: DataFrame) -> DataFrame:
    """(name, hash, text) of pages or sources (path, text): the body's hash, so that a new header embeds nothing anew."""
    return pages.select(F.regexp_replace("path", r"\.md$", "").alias("name"), M.content_hash(F.col("text")).alias("hash"), "text")


def update(spark: SparkSession, folder: str, wiki: DataFrame, raw: DataFrame, embed, model: str, keep: int = 2) -> dict:
    """Bring both indexes up to the texts (name, hash, text); embed: a column function of texts. Gives version, and each index's counts of actions.

    New and changed texts are embedded, those of another model all anew; stale names go; a side without texts is an empty index. Both new versions are
    written whole before the pointer moves: a provider that fails, or a stop before that, leaves both as they were. If nothing
    changed, nothing is written. Versions but the newest `keep` are deleted.
    """
    before = current(folder)
    sides = {"wiki": wiki, "raw": raw}
    actions, changed = {}, before["version"] == 0 or before["model"] != model
    for kind in KINDS:
        old = read_index(spark, folder, kind)
        same = old.where(F.col("model") == model) if before["model"] == model else old.limit(0)
        counted = {r["action"]: r["count"] for r in V.index_changes(same, sides[kind]).groupBy("action").count().collect()}
        actions[kind] = counted
        changed = changed or any(k != "keep" for k in counted)
    if not changed:
        return {"version": before["version"], "actions": actions, "written": False}
    version, counts = before["version"] + 1, {}
    for kind in KINDS:
        nxt = V.update_index(read_index(spark, folder, kind), sides[kind], embed, model)
        path = f"{folder}/{version:08d}/{kind}"
        nxt.select("name", "hash", F.col("vec").cast("array<double>").alias("vec"), "model").sort("name").write.mode("overwrite").parquet(path)
        counts[kind] = spark.read.schema(INDEX).parquet(path).where("vec is not null").count()
        texts = sides[kind].count()
        if counts[kind] != texts:
            raise RuntimeError(f"{texts - counts[kind]} texts of {kind} have no vector")
    fs, base = journal.store(folder)
    with fs.open_output_stream(f"{base}/current.draft") as f:
        f.write(json.dumps({"version": version, "model": model, "counts": counts}).encode())
    fs.move(f"{base}/current.draft", f"{base}/current.json")
    for info in fs.get_file_info(afs.FileSelector(base)):
        if info.base_name.isdigit() and int(info.base_name) <= version - keep:
            fs.delete_dir(info.path)
    return {"version": version, "actions": actions, "written": True}


def search(spark: SparkSession, folder: str, kind: str, text: str, embed, k: int = 10, exclude: str | None = None) -> DataFrame:
    """(name, sim): the k nearest to a text, which is embedded as the index was."""
    query = spark.range(1).select(F.lit(text).alias("text")).select(embed(F.col("text")).alias("vec")).first()["vec"]
    return V.top_k(read_index(spark, folder, kind), list(query), k, exclude)
