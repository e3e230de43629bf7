"""Shared helpers: bounded Arrow batches, tables in the cluster's shared folder, and text units."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: What tasks leave in a Python worker for the next ones of the same operator.
HELD: dict = {}


def let_go() -> None:
    """Drop what another operator's tasks left in this worker. Workers outlive their stages, so it would count against the executor's memory in all later ones."""
    HELD.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; in local mode, where that is unset, an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="notegraph-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/notegraph/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: ends the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables. Only for those that all readers have read to the end, as what they made is written too."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, a narrow written table, to be broadcast if it has at most `rows` rows; beyond that a join shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as single texts can be long. Queries call this; operators leave the session alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def whole(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def shingles(df: DataFrame, words_col: str, k: int, out: str, first: str | None = None) -> DataFrame:
    """A row for each k-word shingle in struct `out` of fields w1..wk, repeats included; `first`: a column that is 1 in a text's first row, else 0.

    A text of fewer words gives one shingle of all its words (in w1, space-joined); one without words gives a null.
    The arrays are zipped and exploded, so everything stays in generated code.
    """
    w = F.col(words_col)
    n = F.size(w)
    fields = [f"w{i + 1}" for i in range(k)]
    zipped = F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.greatest(n - (k - 1), F.lit(0))).alias(f) for i, f in enumerate(fields)])
    short = F.array(F.struct(F.concat_ws(" ", w).alias("w1"), *[F.lit(None).cast("string").alias(f) for f in fields[1:]]))
    kind = f"array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    every = F.when(n >= k, zipped.cast(kind)).when(n > 0, short.cast(kind))
    if first is None:
        return df.withColumn(out, F.explode_outer(every))
    return df.select("*", F.posexplode_outer(every).alias(first, out)).withColumn(first, (F.coalesce(first, F.lit(0)) == 0).cast("int"))
