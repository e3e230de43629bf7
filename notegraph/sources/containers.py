"""What PDF and DOCX files hold, from their bytes: page counts and pictures, without outside programs."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of pictures that are listed.
PICTURES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")
#: Bytes to which a compressed part of a file may grow; beyond that the file counts as broken.
MOST = 64 << 20

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_SPACE = rb"[\x00\t\n\x0c\r ]*"


class Broken(ValueError):
    """A file that isn't what its name says."""


def _inflated(data: bytes) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, MOST)
    if d.unconsumed_tail:
        raise Broken("a compressed part is too large")
    return out


def _objects(data: bytes) -> dict[int, bytes]:
    """Number to body of the objects of a PDF, those in compressed object streams too; of a number that is there again the last one, as an update replaces it."""
    found: dict[int, bytes] = {}
    marks = list(_OBJECT.finditer(data))
    for m, nxt in zip(marks, [*marks[1:], None]):
        body = data[m.end() : nxt.start() if nxt else len(data)]
        head, _, rest = body.partition(b"stream")
        found[int(m[1])] = head
        if re.search(rb"/Type" + _SPACE + rb"/ObjStm", head):
            rest = rest[2:] if rest.startswith(b"\r\n") else rest[1:]
            raw = rest.partition(b"endstream")[0]
            try:
                inner = _inflated(raw) if b"/FlateDecode" in head else raw
                n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"N", b"First"))
            except (zlib.error, TypeError) as e:
                raise Broken("a stream of objects can't be read") from e
            numbers = [int(x) for x in inner[:first].split()[: 2 * n]]
            starts = numbers[1::2]
            for k, a, b in zip(numbers[::2], starts, [*starts[1:], len(inner) - first]):
                found[k] = inner[first + a : first + b]
    return found


def _reference(body: bytes, key: bytes) -> int | None:
    m = re.search(rb"/" + key + _SPACE + rb"(\d+)\s+\d+\s+R", body)
    return int(m[1]) if m else None


def pdf_pages(data: bytes) -> int:
    """The pages below the root of a PDF's page tree, by walking it; a node that is its own ancestor counts once. Broken where there is no tree."""
    if b"%PDF-" not in data[:1024]:
        raise Broken("no PDF header")
    objects = _objects(data)
    roots = [_reference(b, b"Pages") for b in objects.values() if re.search(rb"/Type" + _SPACE + rb"/Catalog\b", b)]
    root = next((r for r in reversed(roots) if r in objects), None)
    if root is None:
        raise Broken("encrypted objects" if b"/Encrypt" in data else "no page tree")
    n, seen, todo = 0, set(), [root]
    while todo:
        k = todo.pop()
        if k in seen or k not in objects:
            continue
        seen.add(k)
        kids = re.search(rb"/Kids" + _SPACE + rb"\[([^\]]*)\]", objects[k])
        if kids:
            todo += [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])]
        elif re.search(rb"/Type" + _SPACE + rb"/Page\b", objects[k]):
            n += 1
    return n


def docx_pictures(data: bytes) -> list[str]:
    """Names of the pictures of a DOCX archive, by its central directory, in order; no picture is unpacked."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
    except (zipfile.BadZipFile, ValueError) as e:
        raise Broken("no archive") from e
    if not any(n.startswith("word/") for n in names):
        raise Broken("an archive without a document")
    return sorted(n.rsplit("/", 1)[-1] for n in names if n.startswith("word/media/") and n.lower().endswith(PICTURES))


def _inspected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, data in zip(pdf["path"], pdf["content"]):
            pages, pictures, reason = None, None, None
            try:
                if path.lower().endswith(".pdf"):
                    pages = pdf_pages(bytes(data))
                else:
                    pictures = docx_pictures(bytes(data))
            except Broken as e:
                reason = str(e)
            out.append((path, pages, pictures, reason))
        yield pd.DataFrame(out, columns=["path", "pages", "pictures", "reason"]).astype({"pages": "Int64"})


def inspected(binaries: DataFrame) -> DataFrame:
    """(path, pages, pictures, reason) of (path, content) rows of PDF and DOCX files, others left out. A broken file has nulls and a reason."""
    some = binaries.where(F.lower("path").rlike(r"\.(pdf|docx)$"))
    return some.select("path", "content").mapInPandas(_inspected, "path string, pages long, pictures array<string>, reason string")


def read_containers(spark: SparkSession, root: str) -> DataFrame:
    """inspected() of all PDF and DOCX files below root, paths relative to it. Batches are small, as files are large."""
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF,docx,DOCX}").load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^\\Q" + base + "\\E/", "")
    return inspected(rows.select(path.alias("path"), "content"))
