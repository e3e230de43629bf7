"""The history of metrics as a log: batches by day, the last entry of a minute counts, small batches are merged, old days go.

Layout: `day=<date>/batch=<number>` as written, `day=<date>/upto=<number>` as merged. A merged part replaces all batches of its day up to its
number from the moment that it is whole, whether they are deleted yet or not, so a reader never sees rows twice or misses any.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..session import children, delete

#: Batches of a day from which it is merged.
MERGE_AT = 8


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """(day, path, number) of the parts that count."""
    out = []
    for day in children(spark, folder):
        if not re.fullmatch(r"day=\d{4}-\d{2}-\d{2}", day):
            continue
        names = [n for n in children(spark, f"{folder}/{day}") if re.fullmatch(r"(batch|upto)=\d+", n) and "_SUCCESS" in children(spark, f"{folder}/{day}/{n}")]
        merged = max((int(n[5:]) for n in names if n.startswith("upto=")), default=-1)
        if merged >= 0:
            out.append((day[4:], f"{folder}/{day}/upto={merged}", merged))
        out += [(day[4:], f"{folder}/{day}/{n}", int(n[6:])) for n in names if n.startswith("batch=") and int(n[6:]) > merged]
    return out


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    schema = f"{metrics.FULL_HISTORY}, seq long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, keep: int | None = 365, since: str | None = None) -> DataFrame:
    """Entries, of a minute the one of the last batch; the newest `keep`, or all. since: a date; older days are not read."""
    rows = _read(spark, [p for day, p, _ in _parts(spark, folder) if since is None or day >= since])
    rows = metrics.last_per_minute(rows.withColumn("_ts", F.col("ts")).withColumn("ts", F.to_timestamp("ts")), ["seq"]).withColumn("ts", F.col("_ts")).drop("_ts", "seq")
    return rows if keep is None else metrics.retained(rows, keep)


def append(entries: DataFrame, folder: str, batch: int) -> None:
    """Write entries (metrics.HISTORY or FULL_HISTORY) as a batch. The same batch again replaces what it wrote, so a rerun changes nothing; a later batch wins within a minute."""
    spark = entries.sparkSession
    rows = entries.withColumn("seq", F.lit(batch).cast("long")).withColumn("day", F.to_date(F.to_timestamp("ts")).cast("string")).persist()
    try:
        for (day,) in rows.select("day").distinct().collect():  # an entry or few
            if any(d == day and p.rsplit("/", 1)[-1].startswith("upto=") and n >= batch for d, p, n in _parts(spark, folder)):
                continue  # merged already
            rows.where(F.col("day") == day).drop("day").coalesce(1).write.mode("overwrite").parquet(f"{folder}/day={day}/batch={batch}")
    finally:
        rows.unpersist()


def record(row: DataFrame, folder: str, now: str, trigger: str, batch: int) -> bool:
    """Add the entry of a row of metrics, if it differs from the entry before, or is the first; whether it was added."""
    spark = row.sparkSession
    last = read(spark, folder, keep=1)
    entry = metrics.history_entry(row, last, now, trigger)
    added = metrics.worth_keeping(entry)
    if not added.limit(1).count():
        return False
    append(added, folder, batch)
    return True


def merge(spark: SparkSession, folder: str, least: int = MERGE_AT) -> list[str]:
    """Merge days of `least` parts or more, the last entry of a minute only, and delete what was merged; the days."""
    done = []
    parts = _parts(spark, folder)
    for day in sorted({d for d, _, _ in parts}):
        own = [(p, n) for d, p, n in parts if d == day]
        if len(own) < max(least, 2):
            continue
        upto = max(n for _, n in own)
        rows = _read(spark, [p for p, _ in own]).withColumn("_ts", F.col("ts")).withColumn("ts", F.to_timestamp("ts"))
        rows = metrics.last_per_minute(rows, ["seq"]).withColumn("ts", F.col("_ts")).drop("_ts")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/day={day}/upto={upto}")
        done.append(day)
    _tidy(spark, folder)
    return done


def _tidy(spark: SparkSession, folder: str) -> None:
    """Delete parts that a merged one replaces, those that a run which failed has left too."""
    live = {p for _, p, _ in _parts(spark, folder)}
    for day in children(spark, folder):
        if day.startswith("day="):
            merged = max((int(p.rpartition("=")[2]) for p in live if p.startswith(f"{folder}/{day}/upto=")), default=-1)
            for n in children(spark, f"{folder}/{day}"):
                if re.fullmatch(r"(batch|upto)=\d+", n) and f"{folder}/{day}/{n}" not in live and int(n.rpartition("=")[2]) <= merged:
                    delete(spark, f"{folder}/{day}/{n}")


def expire(spark: SparkSession, folder: str, before: str) -> list[str]:
    """Delete whole days before a date; their names."""
    old = [d for d in children(spark, folder) if d.startswith("day=") and d[4:] < before]
    for d in old:
        delete(spark, f"{folder}/{d}")
    return [d[4:] for d in old]
