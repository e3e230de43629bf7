"""Text fixes for issues, folded page by page in rule order, and renames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions.header import entries, unquoted
from ..sources import journal, vault

_HEADER = re.compile(r"\A---\s*\n(.*?)\n---\s*\n", re.S)


def _in_header(text: str, change: Callable[[str], str]) -> str:
    m = _HEADER.match(text)
    return text if not m else text[: m.start(1)] + change(m[1]) + text[m.end(1) :]


def _set(field: str, value: str):
    return lambda raw: re.sub(rf"(?m)^{field}:[ \t]*.*$", lambda _: f"{field}: {value}", raw, count=1)


def _block_tags(raw: str) -> str:
    def block(m: re.Match) -> str:
        tags = [unquoted(x.strip()) for x in m[1].split(",") if x.strip()]
        return "tags:" + "".join(f"\n  - {x}" for x in tags) if tags else "tags: []"

    return re.sub(r"(?m)^tags:[ \t]*\[(.*)\][ \t]*$", block, raw, count=1)


def _without(field: str):
    return lambda raw: "\n".join(lines for name, lines in entries(raw) if name != field)


def _with(entry: str | None):
    return lambda raw: raw if entry is None else raw.rstrip("\n") + "\n" + entry


def _body_without(text: str, link: str) -> str:
    """A text without a header stays."""
    m = _HEADER.match(text)
    return text[: m.end()] + text[m.end() :].replace(" " + link, "").replace(link, "") if m else text


#: (text, issue) to text; an issue of no kind here stays open.
HANDLERS: dict[str, Callable[[str, dict], str]] = {
    "status-not-in-enum": lambda t, i: _in_header(t, _set("status", i["fix"])),
    "folder-type-mismatch": lambda t, i: _in_header(t, _set("type", i["expected_type"])),
    "inline-tags": lambda t, i: _in_header(t, _block_tags),
    "non-canonical-wikilink": lambda t, i: t.replace(i["link"], i["fix"]),
    "raw-link-with-extension": lambda t, i: t.replace(i["link"], i["link"].replace(".md]]", "]]")),
    "raw-ref-in-body": lambda t, i: _body_without(t, i["link"]),
    "invalid-fields": lambda t, i: _in_header(t, _without(i["field"]) if i["subtype"] == "extra" else _with(i["entry"])),
}

_USED = ("type", "fix", "expected_type", "link", "field", "subtype", "entry")


def apply_fixes(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(path, text, new_text, applied): each page's fixes one after another, by rule and content, in Arrow batches."""
    have = [F.col(c) if c in issues.columns else F.lit(None).cast("string").alias(c) for c in _USED]
    by_page = issues.where(F.col("type").isin(*HANDLERS)).select(F.col("where").alias("path"), F.struct("rule_seq", *have).alias("i")).groupBy("path").agg(F.sort_array(F.collect_list("i")).alias("issues"))

    @F.pandas_udf("struct<new_text:string,applied:array<string>>")
    def fold(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, issues_ in zip(text, found):
            applied = []
            for i in issues_:
                changed = HANDLERS[i["type"]](t, i)
                if changed != t:
                    applied.append(i["type"])
                t = changed
            out.append((t, applied))
        return pd.DataFrame(out, columns=["new_text", "applied"])

    return pages.select("path", "text").join(by_page, "path").withColumn("f", fold("text", "issues")).select("path", "text", "f.new_text", "f.applied")


def renamed(texts: DataFrame, old: str, new: str, every: bool = False) -> DataFrame:
    """(path, new_path, text, new_text) of files that a rename changes, or of every file, with its other columns. old and new: paths below the same root; errors as ValueError."""
    if old.split("/")[0] != new.split("/")[0] or old.split("/")[0] not in ("wiki", "raw"):
        raise ValueError("both paths must be below wiki/, or both below raw/")
    name = lambda p: p.removesuffix(".md") if p.startswith("raw/") else p.rsplit("/", 1)[-1].removesuffix(".md")
    out = texts.withColumn("new_text", M.rename_links(F.col("text"), name(old), name(new))).withColumn("new_path", F.when(F.col("path") == old, new).otherwise(F.col("path")))
    return out if every else out.where("new_text <> text or new_path <> path").select("path", "new_path", "text", "new_text")


def rename_file(spark: SparkSession, root: str, old: str, new: str) -> list[str]:
    """Move a file root/old to root/new and rewrite links to it in all pages and sources; paths of changed files. Errors as ValueError.

    Texts are staged by tasks; then an intent names every new text and the move, so that a stop at any point is finished by the next run, or nothing has changed.
    """
    return rename_files(spark, root, {old: new})


def rename_files(spark: SparkSession, root: str, moves: dict[str, str]) -> list[str]:
    """As rename_file for some pairs in one plan and one intent."""
    journal.recover(root)
    fs, base = journal.store(root)
    there = lambda p: fs.get_file_info(f"{base}/{p}").type.name == "File"
    for old, new in moves.items():
        if not there(old):
            raise ValueError(f"{old} isn't there")
        if there(new) or list(moves.values()).count(new) > 1:
            raise ValueError(f"{new} is there already")
    parts = [vault.files(spark, f"{root}/{k}", "*.md").select(F.concat(F.lit(f"{k}/"), "path").alias("path"), "text") for k in ("wiki", "raw") if fs.get_file_info(f"{base}/{k}").type.name == "Directory"]
    texts = reduce(DataFrame.unionByName, parts)
    out = texts.withColumns({"first": F.col("text"), "to": F.col("path")})
    for old, new in moves.items():
        named = renamed(out.select("to", "text", "first").withColumnRenamed("to", "path"), old, new, every=True)
        out = named.select(F.col("new_path").alias("to"), F.col("new_text").alias("text"), "first")
    back = {v: k for k, v in moves.items()}
    changed = out.where((F.col("text") != F.col("first")) | F.col("to").isin(*moves.values()))
    change = journal.Journal(root)

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["to"], "staged": [change.stage(t.encode("utf-8")) for t in pdf["text"]]})

    try:
        puts = {r["path"]: r["staged"] for r in changed.select("to", "text").mapInPandas(stage, "path string, staged string").toLocalIterator()}
        for old, new in moves.items():
            if new not in puts:  # not a page: its bytes move as they are
                with fs.open_input_stream(f"{base}/{old}") as f:
                    puts[new] = change.stage(f.read())
    except Exception:
        change.abort()
        raise
    change.commit(puts, list(moves))
    return sorted({*puts, *(back[p] for p in puts if p in back)})


def move_binaries(spark: SparkSession, root: str, issues: DataFrame) -> list[str]:
    """Move the sources that binary-source-outside-formats names, all in one plan; those that moved. One whose new name is taken stays."""
    fs, base = journal.store(root)
    moves: dict[str, str] = {}
    for r in issues.where("type = 'binary-source-outside-formats'").select("where", "suggested").orderBy("where").toLocalIterator():
        taken = r["suggested"] in moves.values() or fs.get_file_info(f"{base}/{r['suggested']}").type.name != "NotFound"
        if not taken and fs.get_file_info(f"{base}/{r['where']}").type.name == "File":
            moves[r["where"]] = r["suggested"]
    if moves:
        rename_files(spark, root, moves)
    return list(moves)
