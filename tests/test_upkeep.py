"""Vaults that change: upkeep by changes against full runs, the data source, the journal, and page states in a stream."""

import os
import pickle
import random
import shutil
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import types as T

from notegraph.operators import fixes, links, rules
from notegraph.sources import journal, notes, vault
from notegraph.streaming import states, upkeep

FOLDERS = ["ideas", "entities", "questions", "domains", "minds", ""]


def text_of(rng, n):
    """A page with links to some of n names, few of them to pages that aren't there, and things that rules find."""
    to = lambda: rng.choice([f"P{rng.randrange(n)}"] * 9 + ["Nowhere", "raw/S1", "P0"])
    kind = rng.choice(["idea", "entity", "question", "domain", "mind", "meta"])
    if rng.random() < 0.1:
        return f"No header here. [[{to()}]]\r\n"
    head = [f"type: {kind}", f"status: {rng.choice(['ready', 'odd', 'deprecated', 'draft'])}", rng.choice(["tags: [a, b]", "tags:\n  - a"])]
    head.append("related:" + "".join(f'\n  - "[[{to()}]]"' for _ in range(rng.randrange(4))))
    head.append("domain:" + "".join(f'\n  - "[[{to()}]]"' for _ in range(rng.randrange(3))))
    body = "\n".join(rng.choice([f"See [[{to()}]] and [[wiki/ideas/{to()}|x]].", "```\n[[P1]]\n```", f"> - [[{to()}#part]]", "`[[P2]]`", "![[P3]]", "[[raw/S2]]", "```\n[[P4]] in an open fence"]) for _ in range(4))
    return "---\n" + "\n".join(head) + "\n---\n" + body + "\n"


def path_of(rng, i):
    folder = rng.choice(FOLDERS)
    return f"{folder}/P{i}.md" if folder else f"P{i}.md"


def full(spark, texts):
    """What a run over all pages finds: issues, and the degrees of links."""
    pages = vault.parsed(spark.createDataFrame(sorted(texts.items()), "path string, text string"))
    issues = rules.run_rules(pages)
    edges = links.graph(pages, "lint")
    nodes = edges.select(edges.src.alias("name")).union(edges.select(edges.dst)).distinct()
    return as_counter(issues), as_counter(links.degrees(edges, nodes))


def as_counter(df):
    return Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def changes(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_upkeep_equals_a_full_run_after_edits_deletions_and_renames(spark, tmp_path):
    rng = random.Random(5)
    n = 40
    texts = {path_of(rng, i): text_of(rng, n) for i in range(n)}
    texts["ideas/sub/P3.md"] = text_of(rng, n)  # a name twice
    folder = str(tmp_path / "state")
    state = upkeep.State(spark, folder, buckets=4)
    assert upkeep.apply(state, changes(spark, list(texts.items())))["touched"] == len(texts)

    def hold():
        fresh = upkeep.State(spark, folder)
        issues, degrees = full(spark, texts)
        assert as_counter(upkeep.open_issues(fresh)) == issues
        assert as_counter(fresh.read("degrees")) == degrees

    hold()
    for step in range(1):
        rows = []
        some = rng.sample(sorted(texts), 9)
        for p in some[:4]:  # edits
            rows.append((p, text_of(rng, n)))
        rows += [(p, None) for p in some[4:]]  # deletions
        rows.append((path_of(rng, 1000 + step), texts[some[6]]))  # two of them are renames: to a new name, and to another's name and folder
        rows.append((f"domains/{some[5].split('/')[-1]}", texts[some[7]]))
        rows = list(dict(rows).items())
        for p, t in rows:
            texts.pop(p, None)
            if t is not None:
                texts[p] = t
        upkeep.apply(upkeep.State(spark, folder), changes(spark, rows))
        hold()
    before = upkeep.State(spark, folder).version
    assert upkeep.apply(upkeep.State(spark, folder), changes(spark, [])) == {"version": before, "touched": 0, "parts": {}}


def test_upkeep_reads_the_touched_parts_only(spark, tmp_path):
    """Of a large vault one edit reads the parts of its page and of what it links to."""
    texts = [(f"ideas/P{i}.md", f"---\ntype: idea\n---\n[[P{(i * 7 + 1) % 3000}]] [[P{(i + 1) % 3000}]]\n") for i in range(3000)]
    folder = str(tmp_path / "state")
    upkeep.apply(upkeep.State(spark, folder), changes(spark, texts))
    state = upkeep.State(spark, folder)
    out = upkeep.apply(state, changes(spark, [("ideas/P5.md", "---\ntype: idea\n---\n[[P9]] [[Gone]]\n")]))
    assert out["touched"] == 1
    assert all(n <= 12 for n in out["parts"].values()), out["parts"]  # of 32
    dead = [r for r in upkeep.open_issues(state).where("type = 'dead-link'").collect()]
    assert [(r["where"], r["what"]) for r in dead] == [("ideas/P5.md", "[[Gone]]")]


def test_a_failed_run_leaves_the_state_before(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "state")
    upkeep.apply(upkeep.State(spark, folder), changes(spark, [("ideas/A.md", "---\ntype: idea\n---\n[[B]]\n"), ("ideas/B.md", "---\ntype: idea\n---\n")]))
    before = as_counter(upkeep.open_issues(upkeep.State(spark, folder)))
    with monkeypatch.context() as m:
        m.setattr(upkeep.State, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            upkeep.apply(upkeep.State(spark, folder), changes(spark, [("ideas/B.md", None)]))
    assert as_counter(upkeep.open_issues(upkeep.State(spark, folder))) == before
    upkeep.apply(upkeep.State(spark, folder), changes(spark, [("ideas/B.md", None)]))
    assert {r["what"] for r in upkeep.open_issues(upkeep.State(spark, folder)).where("type = 'dead-link'").collect()} == {"[[B]]"}


def write_all(root, texts):
    for p, t in texts.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


def test_settle_mends_and_scans_again(spark, tmp_path):
    wiki = tmp_path / "wiki"
    write_all(wiki, {"ideas/A.md": "---\ntype: idea\nstatus: odd\ntags: [a, b]\nsummary: s\n---\n[[B]]\n", "ideas/B.md": "---\ntype: mind\nstatus: ready\nsummary: s\n---\n[[A]]\n"})
    out = upkeep.settle(spark, str(wiki), str(tmp_path / "state"))
    assert {k for _, k in out["applied"]} >= {"status-not-in-enum", "inline-tags", "folder-type-mismatch"}
    assert out["second"]["touched"] == 2
    left = upkeep.open_issues(upkeep.State(spark, str(tmp_path / "state")))
    want, _ = full(spark, {p: (wiki / p).read_text() for p in ("ideas/A.md", "ideas/B.md")})
    assert as_counter(left) == want and {r["where"] for r in left.collect()} == {"ideas/B.md"}  # draft was right for a mind, and isn't for an idea
    # Edits that keep time and size are found by hashes only.
    stat = (wiki / "ideas/A.md").stat()
    (wiki / "ideas/A.md").write_text((wiki / "ideas/A.md").read_text().replace("[[B]]", "[[C]]"))
    os.utime(wiki / "ideas/A.md", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    state = upkeep.State(spark, str(tmp_path / "state"))
    assert upkeep.detect(state, str(wiki)).count() == 0
    assert [r["path"] for r in upkeep.detect(state, str(wiki), thorough=True).collect()] == ["ideas/A.md"]


# The data source


def test_notes_are_read_in_parts_with_conditions_on_path(spark, tmp_path, monkeypatch):
    notes.register(spark)
    texts = {f"ideas/P{i}.md": f"text {i} é\n" for i in range(20)} | {"minds/M.md": "m", "meta/lint-report-1.md": "x", "snapshots/S.md": "x", "ideas/other.txt": "x", "empty.md": ""}
    write_all(tmp_path, texts)
    df = spark.read.format("notes").option("partitionBytes", "40").load(str(tmp_path))
    got = {r["path"]: r["text"] for r in df.collect()}
    assert got == {p: t for p, t in texts.items() if p.endswith(".md") and not p.startswith(("meta/", "snapshots/"))}
    assert df.rdd.getNumPartitions() > 3
    assert {r["path"] for r in df.where("path = 'ideas/P3.md'").collect()} == {"ideas/P3.md"}
    assert df.where("startswith(path, 'minds/')").count() == 1 and df.where("path in ('ideas/P1.md', 'nope.md')").count() == 1
    reader = notes.NotesReader({"path": str(tmp_path)})
    list(reader.pushFilters([notes.EqualTo(("path",), "ideas/P3.md")]))
    assert [e.path for p in reader.partitions() for e in p.entries] == ["ideas/P3.md"]  # one file is opened
    assert spark.read.format("notes").load(str(tmp_path / "nothing")).count() == 0


def test_notes_are_written_all_or_none(spark, tmp_path):
    notes.register(spark)
    write_all(tmp_path, {"ideas/A.md": "old", "ideas/B.md": "old", "ideas/C.md": "old"})
    save = lambda rows, mode="append": spark.createDataFrame(rows, "path string, text string").repartition(3).write.format("notes").mode(mode).save(str(tmp_path))
    save([("ideas/A.md", "new"), ("domains/N.md", "é"), ("ideas/B.md", None)])
    read = lambda: {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.md")}
    want = {"ideas/A.md": "new", "domains/N.md": "é", "ideas/C.md": "old"}
    assert read() == want
    for bad in ([("ideas/A.md", "x"), ("../out.md", "x")], [("ideas/A.md", "x"), ("ideas/A.md", "y")], [("ideas/A.md", "x"), (None, "y")]):
        with pytest.raises(Exception):  # noqa: B017
            save(bad)
        assert read() == want
    hidden = tmp_path / journal.HIDDEN
    assert not any(p.is_file() for p in hidden.rglob("*"))
    save([("ideas/Z.md", "z")], "overwrite")
    assert read() == {"ideas/Z.md": "z"}


def test_the_driver_holds_neither_paths_nor_entries_of_a_large_vault(tmp_path, monkeypatch):
    """Messages of writing tasks don't grow with the pages, parts of a reader by few bytes; a path in lists of two tasks is an error, more lists than are read at once are merged, and overwriting goes through them, too."""
    monkeypatch.setattr(notes, "RUN", 100)
    monkeypatch.setattr(journal, "OPEN", 3)
    schema = T.StructType().add("path", "string").add("text", "string")
    rows = [{"path": f"ideas/sub{i % 3}/P{i}.md" if i % 2 else f"minds/P{i}.md", "text": f"text {i}"} for i in range(2_000)]
    w = notes.NotesWriter({"path": str(tmp_path)}, schema, False)
    messages = [w.write(iter(rows[i::4])) for i in range(4)]
    assert len(pickle.dumps(messages)) < 2_000
    w.commit([*messages, None])
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.md")} == {r["path"]: r["text"] for r in rows}
    parts = notes.NotesReader({"path": str(tmp_path), "partitionBytes": "5000"}).partitions()
    assert len(pickle.dumps(parts)) < 40 * len(rows) and sorted((e.path for p in parts for e in p.entries), key=lambda p: p.split("/")) == [e.path for e in notes.listing(str(tmp_path))]
    w = notes.NotesWriter({"path": str(tmp_path)}, schema, False)
    with pytest.raises(ValueError, match="written twice"):
        w.commit([w.write(iter(rows[:150])), w.write(iter([{"path": rows[149]["path"], "text": None}]))])
    assert len(list(tmp_path.rglob("*.md"))) == 2_000 and not any(p.is_file() for p in (tmp_path / journal.HIDDEN).rglob("*"))
    w = notes.NotesWriter({"path": str(tmp_path)}, schema, True)
    w.commit([w.write(iter([rows[0], {"path": rows[1]["path"], "text": None}, {"path": "new.md", "text": "n"}]))])
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.md")} == {rows[0]["path"], "new.md"}


def test_an_intent_of_lists_is_finished_by_the_next_run(tmp_path, monkeypatch):
    write_all(tmp_path, {"a.md": "old", "b.md": "old", "c.md": "old"})
    j = journal.Journal(str(tmp_path))
    lists = [j.note([("a.md", j.stage(b"new a")), ("c.md", None)]), j.note([("d.md", j.stage(b"new d"))])]
    count = iter(range(10))
    with monkeypatch.context() as m:
        m.setattr(journal.Journal, "move", lambda self, *a, f=journal.Journal.move: f(self, *a) if next(count) < 1 else (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            j.commit_lists(lists)
    assert journal.recover(str(tmp_path)) == [j.job] and not [*(tmp_path / journal.HIDDEN).iterdir()]
    assert {p.name: p.read_text() for p in tmp_path.rglob("*.md")} == {"a.md": "new a", "b.md": "old", "d.md": "new d"}


@pytest.mark.parametrize("stop", range(5))
def test_an_intent_is_finished_by_the_next_run(tmp_path, monkeypatch, stop):
    """A stop before any of the steps of a change of four files."""
    write_all(tmp_path, {"a.md": "old", "b.md": "old", "c.md": "old"})
    j = journal.Journal(str(tmp_path))
    puts = {p: j.stage(f"new {p}".encode()) for p in ("a.md", "b.md", "sub/d.md")}
    steps = iter(range(10))

    def stopped(f):
        def run(self, *a):
            if next(steps) == stop:
                raise OSError("stopped")
            return f(self, *a)

        return run

    with monkeypatch.context() as m:
        m.setattr(journal.Journal, "move", stopped(journal.Journal.move))
        m.setattr(journal.Journal, "drop", stopped(journal.Journal.drop))
        if stop < 4:
            with pytest.raises(OSError):
                j.commit(puts, ["c.md"])
        else:
            j.commit(puts, ["c.md"])
    journal.recover(str(tmp_path))
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.md")} == {"a.md": "new a.md", "b.md": "new b.md", "sub/d.md": "new sub/d.md"}
    assert journal.recover(str(tmp_path)) == []
    assert not [p for p in (tmp_path / journal.HIDDEN).iterdir()]


def test_a_rename_that_stops_half_way_is_finished(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    write_all(root, {"wiki/ideas/A.md": "---\ntype: idea\n---\nme [[A]]", "wiki/ideas/B.md": "[[A]] [[A|x]]", "raw/S.md": "[[A]]", "wiki/ideas/C.md": "none"})
    kept = tmp_path / "kept"
    shutil.copytree(root, kept)
    fixes.rename_file(spark, str(kept), "wiki/ideas/A.md", "wiki/entities/Z.md")
    whole = {str(p.relative_to(kept)): p.read_text() for p in kept.rglob("*.md")}
    assert whole["wiki/ideas/B.md"] == "[[Z]] [[Z|x]]" and whole["raw/S.md"] == "[[Z]]" and "wiki/ideas/A.md" not in whole and whole["wiki/entities/Z.md"].endswith("[[Z]]")
    for stop in range(4):
        at = tmp_path / f"stop{stop}"
        shutil.copytree(root, at)
        count = iter(range(10))
        with monkeypatch.context() as m:
            for k in ("move", "drop"):
                m.setattr(journal.Journal, k, lambda self, *a, f=getattr(journal.Journal, k), stop=stop, count=count: f(self, *a) if next(count) != stop else (_ for _ in ()).throw(OSError("stopped")))
            with pytest.raises(OSError):
                fixes.rename_file(spark, str(at), "wiki/ideas/A.md", "wiki/entities/Z.md")
        journal.recover(str(at))
        assert {str(p.relative_to(at)): p.read_text() for p in at.rglob("*.md")} == whole, stop


# Streams


def settle_for(query, seconds, done):
    """Wait until done(); a stream with timers always has a next batch, so it can't be waited for itself."""
    end = time.time() + seconds
    while not done() and time.time() < end:
        if query.exception():
            raise query.exception()
        time.sleep(2)
    assert done()


def test_page_states_in_a_stream_end_like_a_batch_run(spark, tmp_path):
    """Edits, a deletion, one that is taken back, a re-creation, and a restart from the checkpoint."""
    wiki, folder = tmp_path / "wiki", str(tmp_path / "state")
    page = "---\ntype: idea\nsummary: s\n---\n"
    texts = {"ideas/A.md": page + "[[B]]", "ideas/B.md": page + "[[A]] [[C]]", "ideas/C.md": page, "ideas/D.md": page + "[[C]]"}
    write_all(wiki, texts)

    def same():
        issues, degrees = full(spark, texts)

        def look():
            state = upkeep.State(spark, f"{folder}/tables")
            return as_counter(upkeep.open_issues(state)) == issues and as_counter(state.read("degrees")) == degrees

        return look

    start = lambda: states.follow(spark, str(wiki), folder, grace=1500, processingTime="500 milliseconds")
    query = start()
    try:
        settle_for(query, 120, same())
        texts["ideas/A.md"] = page + "[[C]]\n"
        write_all(wiki, {"ideas/A.md": texts["ideas/A.md"]})
        (wiki / "ideas/B.md").unlink()
        kept = texts.pop("ideas/B.md")
        settle_for(query, 120, same())  # after the grace
        query.stop()
        texts["ideas/B.md"] = kept + " more"  # while nobody looks
        write_all(wiki, {"ideas/B.md": texts["ideas/B.md"]})
        (wiki / "ideas/D.md").unlink()
        del texts["ideas/D.md"]
        query = start()
        settle_for(query, 120, same())
        assert spark.read.parquet(f"{folder}/tables/manifest").selectExpr("max(version)").first()[0] >= 3
    finally:
        query.stop()


def test_listings_make_offsets(tmp_path):
    wiki = tmp_path / "wiki"
    write_all(wiki, {"a.md": "1", "b.md": "1"})
    stream = notes.NotesStream({"path": str(wiki), "listings": str(tmp_path / "l")})
    rows = lambda a, b: sorted((p, t) for part in stream.partitions(a, b) for batch in stream.read(part) for p, t in zip(batch["path"].to_pylist(), batch["text"].to_pylist()))
    zero, one = stream.initialOffset(), stream.latestOffset()
    assert rows(zero, one) == [("a.md", "1"), ("b.md", "1")] and stream.latestOffset() == one
    os.utime(wiki / "a.md", ns=(1, 1))  # touched only
    assert stream.latestOffset() == one
    (wiki / "a.md").write_text("22")
    (wiki / "b.md").unlink()
    two = stream.latestOffset()
    assert two != one and rows(one, two) == [("a.md", "22"), ("b.md", None)]
    again = notes.NotesStream({"path": str(wiki), "listings": str(tmp_path / "l")})
    assert again.latestOffset() == two  # a restart
    stream.commit(two)
    assert len(list(Path(tmp_path / "l").iterdir())) == 1


def test_a_change_of_all_parts_looks_no_name_up_again(spark, tmp_path, monkeypatch):
    """Once the changed pages lie in every part, the parts of what is near them aren't looked for; the result is that of a full run."""
    rng = random.Random(9)
    texts = {f"ideas/P{i}.md": text_of(rng, 30) for i in range(30)}
    state, asked = upkeep.State(spark, str(tmp_path / "state"), buckets=2), []
    of = upkeep.State.of

    def spy(self, names, *rest, **more):
        select = type(names).select
        with monkeypatch.context() as m:
            m.setattr(type(names), "select", lambda *a: asked.append(1) or select(*a))
            return of(self, names, *rest, **more)

    monkeypatch.setattr(upkeep.State, "of", spy)
    upkeep.apply(state, changes(spark, list(texts.items())))
    assert len(asked) == 3  # of the pages, and of targets of links and of aims
    assert (as_counter(upkeep.open_issues(state)), as_counter(state.read("degrees"))) == full(spark, texts)
