"""Secret scans over an incremental blob ledger, in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count, leftmost and not overlapping, if their group has least characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "1"


#: The base rules. In the last two a shorter run can't match, which is the same as dropping it.
RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)


#: Matches whose spans are gathered in one array, before the arrays are put together.
CHUNK = 256


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of code points: pieces between the matches and the matches add up to positions.

    Chunks of matches start at running sums; so m matches cost some m * CHUNK + (m / CHUNK)^2 steps, not m^2.
    """
    kind = "array<struct<start:int,end:int>>"
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.transform(found, F.length).alias("n"), F.transform(held, F.length).alias("k"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda j: F.slice(each, j * CHUNK + 1, F.lit(CHUNK)))

    def started(acc: Column, chunk: Column) -> Column:
        length = F.aggregate(chunk, F.lit(0), lambda a, x: a + x["gap"] + x["n"])
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), chunk.alias("each")))).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        more = F.when(x["k"] >= rule.least, F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), more.cast(kind).alias("out"))

    none = F.array().cast("array<struct<at:int,each:array<struct<gap:int,n:int,k:int>>>>")
    starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), started)["out"]
    spans = F.flatten(F.transform(starts, lambda c: F.aggregate(c["each"], F.struct(c["at"].alias("at"), F.array().cast(kind).alias("out")), step)["out"]))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(kind))


#: Columns of a ledger.
LEDGER = "blob string, kind string, version string, spans array<struct<start:int,end:int>>"


def scan(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings has a row for each row of versions: id, blob, kinds map<kind, spans>.

    Content is addressed by SHA-256 (a null text is empty). The ledger has (blob, kind, version, spans), also where
    nothing was found; only pairs of blob and rule version that it lacks are scanned, each blob in one of its rows,
    and findings are joined back to every row with that content. Repeated rows and null ids keep a row each.
    An empty table gives no rows; other columns of versions don't matter. A very long text is scanned as a whole in one task; see _spans for the cost of its matches.
    """
    new, paths = _unseen(versions, id_col, text_col, ledger, rules)
    new = cut(new, "ledger")
    every = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return _findings(paths, every, id_col, rules), every


def scan_stored(versions: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of scan(), with the ledger in the folder `path` (made if it isn't there): what it lacks is scanned and appended.

    A run that fails appends nothing, and is just run again. Two runs at once may append a pair twice, which changes no result.
    """
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    new, paths = _unseen(versions, id_col, text_col, spark.read.schema(LEDGER).parquet(path), rules)
    new.write.mode("append").parquet(path)
    return _findings(paths, spark.read.schema(LEDGER).parquet(path), id_col, rules)


def _unseen(versions: DataFrame, id_col: str, text_col: str, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows that the ledger lacks, (id, blob) of each row)."""
    v = versions.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).withColumn("blob", F.sha2("_text", 256))
    paths = cut(v.select("_id", "blob"), "paths")
    todo = paths.groupBy("blob").agg(F.min("_id").alias("_rep"))
    if ledger is None:
        todo = todo.withColumn("_kinds", F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules]))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("_seen"))
        lacks = F.array_except(F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules]), F.coalesce("_seen", F.array().cast("array<string>")))
        todo = todo.join(seen, "blob", "left").select("blob", "_rep", lacks.alias("_kinds")).where(F.size("_kinds") > 0)
    rows = v.alias("v").join(todo.alias("t"), F.col("v._id").eqNullSafe(F.col("t._rep")) & (F.col("v.blob") == F.col("t.blob"))).select("t.blob", "_text", "_kinds")
    kept = [F.when(F.array_contains("_kinds", f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("_text"), r).alias("spans"))) for r in rules]
    return rows.select("blob", F.array_compact(F.array(*kept)).alias("_f")).dropDuplicates(["blob"]).select("blob", F.inline("_f")), paths


def _findings(paths: DataFrame, ledger: DataFrame, id_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    current = F.concat_ws("@", "kind", "version").isin([f"{r.kind}@{r.version}" for r in rules])
    by_kind = [F.any_value(F.when(F.col("kind") == r.kind, F.col("spans")), ignoreNulls=True).alias(r.kind) for r in rules]
    one = F.map_from_arrays(F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.col(r.kind) for r in rules]))
    by_blob = ledger.where(current).groupBy("blob").agg(*by_kind).select("blob", one.alias("kinds"))
    by_blob = cut(by_blob, "by-blob")  # so that the join reads two plain sides, and a blob of very many paths can be split
    return paths.join(by_blob, "blob", "left").select(F.col("_id").alias(id_col), "blob", "kinds")
