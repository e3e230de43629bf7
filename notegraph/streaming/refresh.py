"""Incremental refresh: a listing of the wiki is compared with the state of the last run; new, edited and deleted pages are found by their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..operators import rules
from ..session import children, delete
from ..sources import vault


def wiki_hash(pages: DataFrame) -> DataFrame:
    """One row, hash: SHA-256 of all paths and texts, each with a line feed after it, by path. It gathers all texts; refresh compares page hashes instead."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda p: F.concat(p["path"], F.lit("\n"), p["text"], F.lit("\n")))
    return pages.agg(F.sha2(F.array_join(each, ""), 256).alias("hash"))


def page_hashes(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("path").alias("page"), F.sha2("text", 256).alias("hash"), M.content_hash(F.col("text")).alias("body_hash"))


def runs(spark: SparkSession, state: str) -> DataFrame:
    """(version, at, files_checked, n_touched, n_deleted, n_open) of finished runs; none at first. A run's row is written last, so one that fails leaves nothing."""
    schema = "version long, at timestamp, files_checked long, n_touched long, n_deleted long, n_open long"
    return spark.read.schema(schema).parquet(f"{state}/runs") if children(spark, f"{state}/runs") else spark.createDataFrame([], schema)


def _last(spark: SparkSession, state: str) -> tuple[int, int]:
    r = runs(spark, state).agg(F.max(F.struct("version", "n_open")).alias("r")).first()["r"]
    return (r["version"], r["n_open"]) if r else (0, 0)


def latest_hashes(spark: SparkSession, state: str) -> DataFrame:
    """(page, hash, body_hash) after the last run."""
    version = _last(spark, state)[0]
    return spark.read.parquet(f"{state}/hashes/{version}") if version else spark.createDataFrame([], "page string, hash string, body_hash string")


def open_issues(spark: SparkSession, state: str) -> DataFrame | None:
    """The issues after the last run; None before the first."""
    version = _last(spark, state)[0]
    return spark.read.parquet(f"{state}/issues/{version}") if version else None


def refresh(spark: SparkSession, wiki: str, state: str, full: bool = False, templates: DataFrame | None = None) -> dict:
    """Run all rules and write the next state: hashes, issues, and a row of `runs`.

    quick: nothing is done if no page is new, edited or deleted and no issue is open; else new issues that involve such pages are kept, and old ones that
    don't. full: all issues anew. Gives version, touched and deleted pages' numbers, open issues, and whether the run was skipped.
    """
    version, n_open = _last(spark, state)
    pages = vault.read_pages(spark, wiki).persist()
    try:
        now, stored = page_hashes(pages), latest_hashes(spark, state)
        touched = rules.touched(now.select("page", "hash"), stored.select("page", "hash"))
        deleted = stored.select("page").join(now.select("page"), "page", "left_anti")
        n_touched, n_deleted = touched.count(), deleted.count()
        if not full and version and not (n_touched or n_deleted or n_open):
            return {"version": version, "touched": 0, "deleted": 0, "open": 0, "skipped": True}
        issues, old = rules.run_rules(pages, templates=templates), open_issues(spark, state)
        if not full and old is not None:
            issues = rules.quick_scope(old, issues, touched.unionByName(deleted))
        now.write.mode("overwrite").parquet(f"{state}/hashes/{version + 1}")
        issues.write.mode("overwrite").parquet(f"{state}/issues/{version + 1}")
        n_issues = spark.read.parquet(f"{state}/issues/{version + 1}").count()
        done = pages.agg(F.lit(version + 1).cast("long").alias("version"), F.current_timestamp().alias("at"), F.count("*").alias("files_checked"), F.lit(n_touched).cast("long").alias("n_touched"), F.lit(n_deleted).cast("long").alias("n_deleted"), F.lit(n_issues).cast("long").alias("n_open"))
        done.write.mode("append").parquet(f"{state}/runs")
        for table in ("hashes", "issues"):  # a reader of the run before may still be at work
            for old in children(spark, f"{state}/{table}"):
                if int(old) < version:
                    delete(spark, f"{state}/{table}/{old}")
        return {"version": version + 1, "touched": n_touched, "deleted": n_deleted, "open": n_issues, "skipped": False}
    finally:
        pages.unpersist()


def follow(spark: SparkSession, wiki: str, state: str, seconds: int = 60):
    """A stream that refreshes every so many seconds: each micro-batch compares the listing, so edits and deletions count as well as new files."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: refresh(spark, wiki, state) and None).option("checkpointLocation", f"{state}/ticks").trigger(processingTime=f"{seconds} seconds").start()
