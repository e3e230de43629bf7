"""The pages of a vault as a data source: `spark.read.format("notes")`, `readStream` and `write`.

Batch: (path, text, mtime, length, hash) of every page below the path. Stream: the same columns for pages that are new or have another
content, and rows with a null text for pages that are gone. Write: rows (path, text) as files, null texts as deletions, all or none of them.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import stat
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from . import journal
from .vault import SKIPPED_FOLDERS

SCHEMA = "path string, text string, mtime timestamp, length long, hash string"
_ARROW = pa.schema([("path", pa.string()), ("text", pa.string()), ("mtime", pa.timestamp("us", tz="UTC")), ("length", pa.int64()), ("hash", pa.string())])
#: Bytes of files of a partition, and of a batch of rows, unless one file is larger. Option `partitionBytes` sets the first.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 8 << 20
#: Pages whose paths a writing task holds before it writes them to a list, and pages that are packed together in a part.
RUN, PACKED = 50_000, 5_000
REPORTS = tuple(f"meta/{kind}-" for kind in ("lint-report", "knowledge-map", "snapshot"))


@dataclass(frozen=True)
class Entry:
    """A page in a listing; hash is None where no content has been read."""

    path: str
    length: int
    mtime_ns: int
    hash: str | None = None


@dataclass
class Part(InputPartition):
    """Entries are kept packed, as the driver holds all parts at once: some 20 bytes a page."""

    packed: list[bytes]
    gone: list[str]

    @property
    def entries(self) -> Iterator[Entry]:
        return (Entry(*e) for some in self.packed for e in json.loads(zlib.decompress(some)))


def _names(fs: afs.FileSystem, folder: str) -> tuple[list[str], set[str], Callable]:
    """Names in a folder in order, those of folders, and a function that gives a file's size and time, or None if it is gone. A local folder is read name by name, since the sizes and times of a large one are many objects."""
    if not isinstance(fs, afs.LocalFileSystem):
        of = {i.base_name: (i.type, i.size, i.mtime_ns or 0) for i in fs.get_file_info(afs.FileSelector(folder))}
        return sorted(of), {n for n, i in of.items() if i[0] == afs.FileType.Directory}, lambda name: of[name][1:] if of[name][0] == afs.FileType.File else None
    names, folders = [], set()
    with os.scandir(folder) as found:
        for e in found:
            names.append(e.name)
            if e.is_dir():
                folders.add(e.name)
    names.sort()

    def info(name: str) -> tuple[int, int] | None:
        try:
            s = os.stat(f"{folder}/{name}")
        except FileNotFoundError:
            return None
        return (s.st_size, s.st_mtime_ns) if stat.S_ISREG(s.st_mode) else None

    return names, folders, info


def walk(root: str, under: str = "") -> Iterator[Entry]:
    """Pages below root, in order; generated reports and hidden folders are left out. under: a folder below root. Only names of one folder and of those around it are held at once."""
    fs, base = journal.store(root)

    def hidden(name: str) -> bool:
        return name in SKIPPED_FOLDERS or name.startswith(".")

    def inside(folder: str) -> Iterator[Entry]:
        names, folders, info = _names(fs, f"{base}/{folder}".rstrip("/"))
        for name in names:
            path = f"{folder}/{name}" if folder else name
            if hidden(name) or path.startswith(REPORTS):
                continue
            if name in folders:
                yield from inside(path)
            elif name.endswith(".md") and (found := info(name)):
                yield Entry(path, *found)

    under = under.strip("/")
    if not any(map(hidden, filter(None, under.split("/")))) and fs.get_file_info(f"{base}/{under}".rstrip("/")).type == afs.FileType.Directory:
        yield from inside(under)


def listing(root: str, under: str = "") -> list[Entry]:
    """All that walk() gives."""
    return list(walk(root, under))


def parted(entries: Iterable[Entry], gone: list[str], most: int) -> list[Part]:
    """Parts of about `most` bytes; none for nothing."""
    parts, some, size = [Part([], [])], [], 0

    def pack() -> None:
        if some:
            parts[-1].packed.append(zlib.compress(json.dumps(some).encode()))
            some.clear()

    for e in entries:
        if size and size + e.length > most:
            pack()
            parts.append(Part([], []))
            size = 0
        some.append((e.path, e.length, e.mtime_ns, e.hash))
        size += e.length
        if len(some) >= PACKED:
            pack()
    pack()
    parts[0].gone.extend(gone)
    return [p for p in parts if p.packed or p.gone]


def _read(root: str, part: Part) -> Iterator[pa.RecordBatch]:
    """Rows of a part. A file that has gone since the listing has no row: the next listing tells."""
    fs, base = journal.store(root)
    rows, size = [[], [], [], [], []], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _ARROW.types)], schema=_ARROW)

    for path in part.gone:
        for c, v in zip(rows, (path, None, None, None, None)):
            c.append(v)
    for e in part.entries:
        try:
            with fs.open_input_stream(f"{base}/{e.path}") as f:
                data = f.read()
        except FileNotFoundError:
            continue
        when = datetime.datetime.fromtimestamp(e.mtime_ns / 1e9, datetime.UTC)
        for c, v in zip(rows, (e.path, data.decode("utf-8", "replace"), when, len(data), hashlib.sha256(data).hexdigest())):
            c.append(v)
        size += len(data)
        if size >= BATCH_BYTES:
            yield batch()
            rows, size = [[], [], [], [], []], 0
    if rows[0]:
        yield batch()


class NotesReader(DataSourceReader):
    """A part of the files for each task. Conditions on path are used to open fewer files."""

    def __init__(self, options):
        self.root, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.paths: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and tuple(f.attribute) == ("path",):
                if isinstance(f, StringStartsWith):
                    self.prefix = max(self.prefix, f.value, key=len)
                else:
                    some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.paths = some if self.paths is None else self.paths & some
            yield f  # Spark still applies each

    def partitions(self):
        journal.recover(self.root)
        under = self.prefix.rpartition("/")[0]
        found = (e for e in walk(self.root, under) if e.path.startswith(self.prefix) and (self.paths is None or e.path in self.paths))
        return parted(found, [], self.most) or [Part([], [])]

    def read(self, partition):
        return _read(self.root, partition)


class NotesStream(DataSourceStreamReader):
    """A stream whose offsets number listings of content hashes, kept in the folder of the option `listings`.

    A trigger lists the files; the content of one is read for its hash only if its size or time differs from the newest listing. A new listing is written,
    and so a new offset made, only if a hash differs or a page came or went. Rows between two offsets are the differences of their listings, so a
    restart gives those of the offsets in its checkpoint again. Listings before the last committed one are deleted.
    """

    def __init__(self, options):
        self.root, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.folder = options["listings"]

    def _file(self, n: int) -> str:
        return f"{journal.store(self.folder)[1]}/{n:012d}.json"

    def _numbers(self) -> list[int]:
        fs, base = journal.store(self.folder)
        if fs.get_file_info(base).type != afs.FileType.Directory:
            return []
        return sorted(int(i.base_name[:-5]) for i in fs.get_file_info(afs.FileSelector(base)) if i.base_name.endswith(".json"))

    def _load(self, n: int) -> dict[str, Entry]:
        if not n:
            return {}
        with journal.store(self.folder)[0].open_input_stream(self._file(n)) as f:
            return {p: Entry(p, *rest) for p, *rest in json.loads(f.read())}

    def initialOffset(self):
        return {"listing": 0}

    def latestOffset(self):
        journal.recover(self.root)
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        known = self._load(last)
        fs, base = journal.store(self.root)
        now = {}
        for e in listing(self.root):
            old = known.get(e.path)
            if old and (old.length, old.mtime_ns) == (e.length, e.mtime_ns):
                now[e.path] = old
                continue
            try:
                with fs.open_input_stream(f"{base}/{e.path}") as f:
                    now[e.path] = Entry(e.path, e.length, e.mtime_ns, hashlib.sha256(f.read()).hexdigest())
            except FileNotFoundError:
                continue
        if {p: e.hash for p, e in now.items()} != {p: e.hash for p, e in known.items()}:
            last += 1
            out, folder = journal.store(self.folder)
            out.create_dir(folder, recursive=True)
            with out.open_output_stream(self._file(last) + ".draft") as f:
                f.write(json.dumps([[e.path, e.length, e.mtime_ns, e.hash] for e in now.values()]).encode())
            out.move(self._file(last) + ".draft", self._file(last))
        return {"listing": last}

    def partitions(self, start, end):
        before, after = self._load(start["listing"]), self._load(end["listing"])
        changed = [e for p, e in after.items() if p not in before or before[p].hash != e.hash]
        return parted(changed, sorted(before.keys() - after.keys()), self.most)

    def read(self, partition):
        return _read(self.root, partition)

    def commit(self, end):
        fs, _ = journal.store(self.folder)
        for n in self._numbers():
            if n < end["listing"]:
                fs.delete_file(self._file(n))


@dataclass
class Staged(WriterCommitMessage):
    lists: list[str]


class NotesWriter(DataSourceWriter):
    """Tasks stage their pages; the driver moves them all to their places, or, if a task fails, none. Tasks write the steps to lists; their messages hold
    the names of these only, and the driver goes through the lists in order of paths.

    A null text deletes the page. A path twice, one outside of the root, or a null path is an error, and nothing is written. overwrite: pages that aren't written are deleted.
    """

    def __init__(self, options, schema, overwrite: bool):
        names = schema.fieldNames()
        if not {"path", "text"} <= set(names):
            raise ValueError(f"columns path and text are needed; there are {names}")
        self.root, self.overwrite, self.journal = options["path"], overwrite, journal.Journal(options["path"])

    def write(self, iterator) -> Staged:
        lists, steps = [], {}

        def close() -> None:
            lists.append(self.journal.note(sorted(steps.items(), key=lambda s: journal.in_order(s[0]))))
            steps.clear()

        for row in iterator:
            path = journal.checked(row["path"] or "")
            if path in steps:
                raise ValueError(f"{path} is written twice")
            steps[path] = None if row["text"] is None else self.journal.stage(row["text"].encode("utf-8"))
            if len(steps) >= RUN:
                close()
        if steps:
            close()
        return Staged(lists)

    def commit(self, messages) -> None:
        lists = [name for m in messages if m for name in m.lists]
        if lists or self.overwrite:
            try:
                self.journal.commit_lists(lists, (e.path for e in walk(self.root)) if self.overwrite else ())
            except ValueError:
                self.journal.abort()
                raise

    def abort(self, messages) -> None:
        self.journal.abort()


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return NotesReader(self.options)

    def streamReader(self, schema):
        return NotesStream(self.options)

    def writer(self, schema, overwrite):
        return NotesWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session; conditions on path reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Notes)
    return spark
