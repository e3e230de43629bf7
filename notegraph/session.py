"""Sessions and the settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "notegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf overrides, with dots as double underscores."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder on any file system that Spark reads; none where there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def work_dir(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, which driver and executors share; in local mode, where that is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/notegraph/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="notegraph-")


class Tables:
    """Tables of the steps of an iteration, written below one folder of work_dir: ends lineage, and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, work_dir(spark), 0
        self.at: dict[int, str] = {}
        self.held: list[DataFrame] = []

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        self.held.append(out)  # so that its id stays its own
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        delete(self.spark, self.at.pop(id(df)))

    def drop_all(self, *but: DataFrame) -> None:
        keep = {id(df) for df in but}
        for k in [k for k in self.at if k not in keep]:
            delete(self.spark, self.at.pop(k))
