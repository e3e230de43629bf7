"""Operators over linked notes: golden cases, a small vault on disk, and every registered query against DuckDB."""

import cmath
import colorsys
import hashlib
import json
import math
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from notegraph.functions import color, geometry
from notegraph.functions import markdown as M
from notegraph.functions.header import parse_header
from notegraph.operators import communities, fixes, links, metrics, rules, vectors
from notegraph.plans import catalog, views
from notegraph.sources import vault
from notegraph.streaming import refresh

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_link_goldens(spark):
    t = F.col("t")
    assert one(spark, M.link_target(t), t="wiki/ideas/RLHF") == "RLHF"
    assert one(spark, M.link_target(t), t="raw/articles/foo") == "raw/articles/foo"
    assert one(spark, M.canonical_fix(t), t="[[wiki/ideas/RLHF#Section|Alias]]") == "[[RLHF#Section|Alias]]"
    assert one(spark, M.raw_key(t), t="[[raw/RLHF]]") == "RLHF.md"
    assert one(spark, M.raw_key(t), t="[[raw/paper.docx.md]]") == "paper.docx.md"
    assert one(spark, M.target_of_path(t), t="wiki/ideas/foo.md") == "foo"
    assert one(spark, M.target_of_path(t), t="raw/articles/foo.md") == "raw/articles/foo"
    assert one(spark, M.target_of_path(t), t="raw/X.pdf") == "raw/X.pdf"
    assert one(spark, M.abbreviation(t), t="Machine Learning") == "ML"
    assert one(spark, M.wikilinks(t), t="[[A]] ![[B]] [[C|d]] [[D#e|f]] `[[G]]` [[H\\|i]] ```\n[[J]]\n``` [[wiki/x/K]]") == ["A", "C", "D", "H", "K"]
    assert one(spark, M.rename_links(t, "Old", "New"), t="[[Old]] ![[Old#a]] [[Old|b]] [[Older]] [[Old#a|b]]") == "[[New]] ![[New#a]] [[New|b]] [[Older]] [[New#a|b]]"
    assert one(spark, M.days_since(t, "2024-01-31"), t="2024-01-01") == 30 and one(spark, M.days_since(t, "2024-01-31"), t="soon") == 10_000


def test_header_grammar():
    raw = 'type: idea\n# note\ntags: [a, "b"]\nrelated:\n  - "[[X]]"\n  -  [[Y]]\n- not an item\nsummary:\nstatus: "ready"\nbad-key: 1\ntype: mind'
    scalars, lists, keys, inline = parse_header(raw)
    assert scalars == {"type": "mind", "summary": None, "status": "ready"}
    assert lists == {"tags": ["a", "b"], "related": ["[[X]]", "[[Y]]"]} and inline == ["tags"]
    assert keys == ["type", "tags", "related", "summary", "status"]


PAGES = {
    "ideas/A.md": "---\ntype: idea\nstatus: strange\ntags: [x]\ndomain:\n  - \"[[Dom]]\"\nrelated:\n  - \"[[B]]\"\nsources:\n  - \"[[raw/s.md]]\"\n---\nSee [[wiki/ideas/B|b]], [[Gone]] and [[raw/s]].\n",
    "ideas/B.md": "---\ntype: entity\nsummary: About | B\nstatus: ready\n---\nNothing.\n",
    "domains/Dom.md": "---\ntype: domain\nsummary: D\nstatus: ready\ndomain:\n  - \"[[Dom]]\"\n---\n",
    "ideas/C.md": "---\r\ntype: idea\r\nsummary: c\r\nstatus: ready\r\n---\r\nAlone\r\n",
    "index.md": "# Index\n",
    "meta/lint-report-1.md": "skip me",
}


@pytest.fixture
def wiki(tmp_path):
    for p, t in PAGES.items():
        (tmp_path / "wiki" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "wiki" / p).write_bytes(t.encode())
    return str(tmp_path / "wiki")


def test_vault_rules_and_fixes(spark, wiki):
    pages = vault.read_pages(spark, wiki).cache()
    assert {r["path"] for r in pages.collect()} == set(PAGES) - {"meta/lint-report-1.md"}
    issues = rules.run_rules(pages)
    found = {(r["type"], r["where"] or r["page_a"]) for r in issues.collect()}
    for kind, where in [("status-not-in-enum", "ideas/A.md"), ("inline-tags", "ideas/A.md"), ("raw-link-with-extension", "ideas/A.md"), ("raw-ref-in-body", "ideas/A.md"), ("dead-link", "ideas/A.md"), ("missing-summary", "ideas/A.md"), ("non-canonical-wikilink", "ideas/A.md"), ("folder-type-mismatch", "ideas/B.md"), ("asymmetric-related", "ideas/A.md"), ("orphan", "ideas/C.md"), ("orphan", "ideas/A.md")]:
        assert (kind, where) in found, kind
    assert not any(w == "domains/Dom.md" for _, w in found)
    assert sorted(vault.write_changed(fixes.apply_fixes(pages, issues), wiki)) == ["ideas/A.md", "ideas/B.md"]
    pages.unpersist()
    after = {r["type"] for r in rules.run_rules(vault.read_pages(spark, wiki)).collect()}
    assert after == {"dead-link", "missing-summary", "asymmetric-related", "orphan"}
    index = views.index_page(vault.read_pages(spark, wiki), "2024-01-31").withColumn("path", F.lit("index.md"))
    got = {r["name"]: r["summary"] for r in views.index_summaries(index).collect()}
    assert got == {"A": views.INDEX_MISSING, "B": "About", "C": "c", "Dom": "D"}


def test_refresh_finds_edits_and_deletions(spark, wiki, tmp_path):
    state = str(tmp_path / "state")
    first = refresh.refresh(spark, wiki, state)
    n = len(PAGES) - 1  # but the generated report
    assert (first["touched"], first["deleted"], first["skipped"]) == (n, 0, False) and refresh.latest_hashes(spark, state).count() == n
    kinds = lambda: {(r["type"], r["where"] or r["page_a"]) for r in refresh.open_issues(spark, state).collect()}
    assert ("dead-link", "ideas/A.md") in kinds() and ("orphan", "ideas/C.md") in kinds()
    for path, text in (("ideas/New.md", "fresh [[C]]"), ("ideas/A.md", PAGES["ideas/A.md"].replace("[[Gone]]", "[[New]]"))):
        with open(f"{wiki}/{path}", "w") as f:
            f.write(text)
    os.remove(f"{wiki}/ideas/C.md")
    second = refresh.refresh(spark, wiki, state)
    assert (second["touched"], second["deleted"], second["version"]) == (2, 1, 2)
    assert {r["page"] for r in refresh.latest_hashes(spark, state).collect()} == {"ideas/A.md", "ideas/B.md", "ideas/New.md", "domains/Dom.md", "index.md"}
    assert ("dead-link", "ideas/A.md") not in kinds() and ("dead-link", "ideas/New.md") in kinds() and not any(w == "ideas/C.md" for _, w in kinds())
    assert refresh.refresh(spark, wiki, state)["touched"] == 0
    pages = vault.read_pages(spark, wiki)
    every = sorted((r["path"], r["text"]) for r in pages.collect())
    assert refresh.wiki_hash(pages).first()["hash"] == hashlib.sha256("".join(f"{p}\n{t}\n" for p, t in every).encode()).hexdigest()


def test_a_clean_wiki_is_skipped(spark, tmp_path):
    (tmp_path / "w/domains").mkdir(parents=True)
    (tmp_path / "w/domains/D.md").write_text('---\ntype: domain\nsummary: d\nstatus: ready\ndomain:\n  - "[[D]]"\n---\n')
    one, two = (refresh.refresh(spark, str(tmp_path / "w"), str(tmp_path / "s")) for _ in range(2))
    assert not one["skipped"] and one["open"] == 0 and two["skipped"] and two["version"] == 1


def pages_from(spark, texts):
    return vault.parsed(spark.createDataFrame(list(texts.items()), "path string, text string"))


def test_rules_leave_out_meta_pages_and_raw_domains(spark):
    p = pages_from(spark, {
        "meta/R.md": "---\ntype: x\n---\n[[Gone]] [[a/b/C]] [[raw/q]]\n",
        "ideas/M.md": "---\ntype: meta\n---\n[[Gone]] [[a/b/C]]\n",
        "ideas/N.md": "no header [[raw/q]] [[Lost]]\nand [[Lost]] [[a/M|t]]\n",
        "ideas/O.md": '---\ntype: idea\ndomain:\n  - "[[raw/x]]"\n  - "[[Nope]]"\nrelated:\n  - "[[x/N]]"\n---\nbody\n',
    })
    got = lambda f, *c: sorted(tuple(r) for r in f(p).select(*c).collect())
    assert got(rules.dead_link, "where", "what", "context") == [("ideas/N.md", "[[Lost]]", "line 1"), ("ideas/O.md", "[[Nope]]", "frontmatter domain")]
    assert got(rules.non_canonical_wikilink, "where", "link", "fix", "context") == [("ideas/N.md", "[[a/M|t]]", "[[M|t]]", "line 2"), ("ideas/O.md", "[[x/N]]", "[[N]]", "frontmatter related")]
    assert got(rules.raw_ref_in_body, "where") == []
    assert got(rules.dangling_domain_ref, "where", "missing_domain") == [("ideas/O.md", "Nope")]
    assert got(rules.asymmetric_related, "page_a", "page_b") == [("ideas/O.md", "ideas/N.md")]
    assert got(rules.missing_summary, "where", "page_type") == [("ideas/M.md", "meta"), ("ideas/O.md", "idea")]
    files = spark.createDataFrame([("a/x.OGG",), ("formats/y.pdf",), ("z.png",)], "path string")
    assert [tuple(r) for r in rules.binary_outside_formats(files).select("where", "suggested").collect()] == [("raw/a/x.OGG", "raw/formats/x.OGG")]
    new = rules.asymmetric_related(p)
    assert rules.quick_scope(new.limit(0), new, spark.createDataFrame([("ideas/N.md",)], "page string")).count() == 1


def test_template_fields_come_and_go(spark, tmp_path):
    (tmp_path / "idea.md").write_text("---\ntype: idea\ntitle: <% tp.file.title %>\ncreated: <% tp.date.now('x') %>\ntags:\n  - a\nsummary:\n---\n")
    (tmp_path / "none.md").write_text("text")
    t = vault.templates(spark, str(tmp_path))
    assert {(r["type"], r["field"]) for r in t.collect()} == {("idea", f) for f in ("type", "title", "created", "tags", "summary")}
    p = pages_from(spark, {"ideas/A.md": "---\ntype: idea\nodd:\n  - x\n# note\ntags: ['q', \"r\"]\n---\nbody\n", "ideas/B.md": "[[raw/x]]"})
    out = fixes.apply_fixes(p, rules.run_rules(p, templates=t, as_of="2024-05-06")).collect()
    assert [(r["path"], r["new_text"]) for r in out if r["path"] == "ideas/A.md"] == [("ideas/A.md", "---\ntype: idea\ntags:\n  - q\n  - r\ncreated: 2024-05-06\ntitle: A\n---\nbody\n")]


def test_health_and_history(spark):
    row = lambda **k: spark.createDataFrame([k], "pages long, wikilinks long, orphans long, ready long, content long, unassigned long, q double")
    none = row(pages=0, wikilinks=0, orphans=0, ready=0, content=0, unassigned=0, q=None)
    assert metrics.health(none).first()["total"] == 0
    some = row(pages=10, wikilinks=70, orphans=0, ready=10, content=10, unassigned=5, q=None)
    a, b = metrics.health(some).first(), metrics.health(some, "ui").first()
    assert (a["q_score"], a["domain_score"], a["total"], a["grade"]) == (50.0, 50.0, 80, "good") and (b["q_score"], b["domain_score"]) == (50.0, 100.0)
    texts = {"ideas/A.md": "---\ntype: idea\nstatus: ready\ndomain:\n  - plain\n---\n[[B]]", "ideas/B.md": "---\ntype: idea\n---\n"}
    m = metrics.vault_metrics(pages_from(spark, texts))
    r = m.first()
    assert (r["pages"], r["wikilinks"], r["orphans"], r["ready"], r["unassigned"], r["domains"], r["pages_list"], r["q"]) == (2, 1, 1, 1, 1, 1, ["A", "B"], None)
    h = spark.createDataFrame([], metrics.HISTORY)
    h = metrics.appended(h, metrics.history_entry(m, h, "2024-01-01 10:00:10", "ingest"))
    assert h.first()["delta"] is None
    h = spark.createDataFrame(h.collect(), metrics.HISTORY)
    assert metrics.appended(h, metrics.history_entry(m, h, "2024-01-01 11:00:00", "query")).count() == 1  # nothing changed
    more = metrics.vault_metrics(pages_from(spark, {**texts, "ideas/C.md": "---\ntype: idea\n---\n[[A]]"}))
    for now, n in (("2024-01-01 10:00:50", 1), ("2024-01-01 11:00:00", 2)):  # of the same minute, and of another
        grown = metrics.appended(h, metrics.history_entry(more, h, now, "save"))
        assert grown.count() == n
    d = metrics.day_totals(grown, "2024-01-02 10:30:00").first()
    assert (d["pages_added"], d["wikilinks"], d["orphans"], d["Q"]) == (["C"], 1, 0, None)
    assert "pages_list" not in metrics.for_display(grown).columns


def test_label_propagation_ends(spark):
    edges = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(5) for j in range(i + 1, 5)] + [("x0", "x1")]
    got = {r["name"]: r["community"] for r in communities.label_propagation(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(got) == 17 and all(len({c for n, c in got.items() if n[0] == g}) == 1 for g in "abcx")


def test_embeddings_snapshots_and_log(spark, tmp_path):
    shapes = ['{"model": "m", "items": {"a/X.md": {"hash": "h", "vec": [1, 2]}, "Y": {"hash": "h"}}}', '{"X": [1, 2], "Z": 3}', '[{"path": "q/X.md", "vec": [1, 2]}, {"name": "X", "vector": [1, 2]}, {"vec": [1]}, 5]']
    for i, (text, n) in enumerate(zip(shapes, (1, 1, 2))):
        (tmp_path / f"{i}.json").write_text(text)
        assert [(r["name"], r["vec"]) for r in vault.read_any_embeddings(spark, str(tmp_path / f"{i}.json")).collect()] == [("X", [1.0, 2.0])] * n
    listing = spark.createDataFrame([(f"_a/{x}.html",) for x in ("snapshot-2024-01-02", "knowledge-map-2024-01-03", "snapshot-graph-2024-01-01", "snapshot-2024")], "path string")
    assert tuple(vault.latest_snapshots(listing).first()) == ("2024-01-03", "knowledge-map-2024-01-03.html", "snapshot-graph-2024-01-01.html")
    assert tuple(vault.latest_snapshots(listing.limit(0)).first()) == (None, None, None)
    assert one(spark, vault.last_operation(F.col("t")), t="# Log\n## 2024-01-02 — Ingest | X\n## 2024-01-01 - save | Y") == "ingest"
    assert one(spark, M.hex_to_rgb(F.col("t")), t=" rgb(1, 20, 255)") == one(spark, M.hex_to_rgb(F.col("t")), t="0114ff") == one(spark, M.hex_to_rgb(F.col("t")), t="#0114FF") == (1, 20, 255)
    assert one(spark, M.plain_text(F.col("t")), t="a [b](c) ![d](e) [[F|g]] h").split() == ["a", "h"]


def test_percentiles_of_pairs(spark, monkeypatch):
    """Exact whatever the bins, blocks and ties; the least and greatest, too."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(60, 4)), np.ones((40, 4)), np.zeros((3, 4))])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "name long, vec array<double>")
    sims = np.array([r["sim"] for r in vectors.pairs(df).collect()])
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    for block, bins, gathered in ((512, 4096, 10_000), (16, 4, 3), (50, 2, 50)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "BINS", bins)
        monkeypatch.setattr(vectors, "GATHERED", gathered)
        total, got, least, most = vectors.pair_ranks(df, points)
        assert total == len(sims) == 103 * 102 // 2 and np.allclose(got, np.quantile(sims, points), atol=1e-9) and abs(least - sims.min()) < 1e-9 and abs(most - sims.max()) < 1e-9
    assert vectors.pair_ranks(df.limit(1), [0.5]) == (0, [0.0], 0.0, 0.0)
    near = {r["name"]: r["nearest"] for r in vectors.nearest(df).collect()}
    assert len(near) == 103 and near[102] == 0.0 and abs(near[60] - 1) < 1e-9
    best = vectors.closest(df.where("name < 60")).first()
    assert abs(best["sim"] - max(s["sim"] for s in vectors.pairs(df.where("name < 60")).collect())) < 1e-12
    assert abs(one(spark, vectors.loose_cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0))), t=1) - 0.6) < 1e-12


def test_similar_pairs_lose_names_and_links_inside_of_the_blocks(spark, monkeypatch):
    """Links both ways, in all tiles and blocks, of a hub, to oneself and to nothing; above the blocks no pair is joined or shuffled."""
    monkeypatch.setattr(vectors, "BLOCK", 15)
    monkeypatch.setattr(vectors, "TILE", 4)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 3))
    ids = {i: 2**60 + i for i in range(60)}  # not to be held as doubles
    df = spark.createDataFrame([(ids[i], [float(x) for x in r]) for i, r in enumerate(v)], "name long, vec array<double>")
    links = [(ids[a], ids[b]) for a, b in rng.integers(0, 60, size=(300, 2)).tolist()] + [(ids[7], ids[i]) for i in range(60)] + [(ids[3], 5), (5, 6), (None, ids[3])]
    names = df.where("name % 9 <> 4").select("name")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = {(ids[i], ids[j]): float(u[i] @ u[j]) for i in range(60) for j in range(i + 1, 60)}
    for points, least in ((0.5, -1.0), (0.0, 0.3)):
        floor = max(np.quantile(list(sims.values()), points), least)
        want = {p for p, s in sims.items() if s > floor + 1e-12 and all(x % 9 != 4 for x in p) and p not in links and p[::-1] not in links}
        out = vectors.similar_unlinked(df, spark.createDataFrame(links, "src long, dst long"), names, points, least)
        rows = out.collect()
        assert {(r["a"], r["b"]) for r in rows} == want and len(rows) == len(want) and all(abs(r["sim"] - sims[r["a"], r["b"]]) < 1e-9 for r in rows)
        above = out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[0]
        assert want and "Join" not in above and "Aggregate" not in above
    strings = df.select(F.concat(F.lit("D"), "name").alias("name"), "vec")
    few = {(r["a"], r["b"]) for r in vectors.pairs(strings, without=spark.createDataFrame([(f"D{ids[1]}", f"D{ids[2]}")], "a string, b string")).collect()}
    assert len(few) == 60 * 59 // 2 - 1 and (f"D{ids[1]}", f"D{ids[2]}") not in few
    again = vectors.pairs(df.unionByName(df.where(F.col("name") == ids[1])), without=spark.createDataFrame([(ids[1], i) for i in ids.values() if i > ids[1]], "a long, b long"))
    assert not [r for r in again.collect() if r["a"] == ids[1] != r["b"]]


def test_blocks_of_pairs_don_t_grow_in_number(spark, monkeypatch):
    """A vector goes to SIDE pairs of blocks, however many vectors there are; tiles cover each pair once."""
    monkeypatch.setattr(vectors, "BLOCK", 2)
    monkeypatch.setattr(vectors, "TILE", 3)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "name long, vec array<double>")

    def sizes(a, b, tiles):
        n = sum(s.size if keep is None else int(keep.sum()) for _, _, s, keep in tiles)
        yield pd.DataFrame({"vectors": [len(set(a) | set(b))], "n": [n]})

    got = vectors._each_block(df, None, sizes, "vectors long, n long").toPandas()
    assert len(got) <= vectors.SIDE * (vectors.SIDE + 1) // 2 and got["vectors"].sum() <= 200 * vectors.SIDE and got["n"].sum() == 200 * 199 // 2


def test_nearest_in_tiles_break_ties_by_name(spark, monkeypatch):
    from notegraph.operators import layout

    rng = np.random.default_rng(8)
    v = rng.integers(-1, 2, size=(90, 3)).astype(float)  # many equal directions
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "name long, vec array<double>")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    want = {i: [int(j) for j in np.lexsort((np.arange(90), -s[i]))[:6]] for i in range(90)}
    for block, tile in ((512, 512), (10, 7), (30, 4)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "TILE", tile)
        got = {}
        for r in layout.knn(df, 6).orderBy("name", "rank").collect():
            got.setdefault(r["name"], []).append(r["other"])
        assert got == want
        best = vectors.closest(df).first()
        assert (best["a"], best["b"]) == min((i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] == s.max())


def test_louvain_by_arrays_moves_as_by_dictionaries(spark, monkeypatch):
    """In name order, a node moves to the best community of its neighbours, the least of equal ones; one bounded task merges communities of rounds."""
    rng = random.Random(5)
    edges = sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(170)) if a < b})
    near = {}
    for a, b in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1
    names = sorted(near)
    at, degree = {n: n for n in names}, {n: len(near[n]) for n in names}
    weight, total, moved = dict(degree), 2 * len(edges), True
    while moved:
        moved = False
        for n in names:
            weight[at[n]] -= degree[n]
            k = {}
            for o in near[n]:
                k[at[o]] = k.get(at[o], 0) + 1
            score = lambda c: k.get(c, 0) - weight[c] * degree[n] / total  # noqa: B023, E731
            best = max(sorted(k), key=score)
            best = best if score(best) > score(at[n]) + 1e-12 else at[n]
            weight[best] += degree[n]
            at[n], moved = best, moved or best != at[n]
    place = {n: i for i, n in enumerate(names)}
    keys = sorted((place[a], place[b]) for n in names for a, b in ((n, o) for o in near[n]))
    src, dst = np.array(keys).T
    got = communities._greedy(src, dst, np.ones(len(src), np.int64), np.array([degree[n] for n in names]), total)
    assert [names[c] for c in got] == [at[n] for n in names]
    calls, moves = [], communities._moves
    monkeypatch.setattr(communities, "_moves", lambda *a: calls.append(1) or moves(*a))
    df = spark.createDataFrame(edges, "a long, b long")
    part = communities.louvain_rounds(df, rounds=4)
    q = [communities.modularity(df, p).first()["q"] for p in (part, communities.louvain(df))]
    assert len(calls) == 2 and q[0] > q[1] - 0.05 and part.count() == len(names)


def test_louvain_looks_again_only_at_nodes_near_which_something_changed():
    """Same moves as rounds over all nodes, with weights and without, in less than three quarters of the scores."""

    class Counted(int):
        def __rtruediv__(self, x):
            calls.append(1)
            return x / int(self)

    for seed, n, heavy, less in ((1, 4000, False, True), (2, 1500, True, False), (3, 60, True, False), (4, 40, False, False)):
        rng = random.Random(seed)
        links = {(min(a, b), max(a, b)): rng.randrange(1, 4) if heavy else 1 for a in range(n) for b in ((a + 17) % n, (3 * a + 1) % n, rng.randrange(n)) if a != b}
        both = sorted([(a, b, x) for (a, b), x in links.items()] + [(b, a, x) for (a, b), x in links.items()])
        src, dst, w = np.array(both, dtype=np.int64).T
        degree = np.bincount(src, w, n).astype(np.int64)
        total, near = int(degree.sum()), {}
        for a, b, x in both:
            near.setdefault(a, []).append((b, x))
        at, weight, plain, moved = list(range(n)), degree.tolist(), 0, True
        while moved:
            moved = False
            for v in range(n):
                d, home, k = int(degree[v]), at[v], {}
                weight[home] -= d
                for o, x in near[v]:
                    k[at[o]] = k.get(at[o], 0) + x
                plain += len(k)
                score = {c: x - weight[c] * d / total for c, x in k.items()}
                best = min(score, key=lambda c: (-score[c], c))
                best = best if score[best] > k.get(home, 0) - weight[home] * d / total + 1e-12 else home
                weight[best] += d
                at[v], moved = best, moved or best != home
        calls = []
        assert communities._greedy(src, dst, w, degree, Counted(total)) == at
        assert not less or len(calls) < plain * 3 / 4, (len(calls), plain)


def test_pages_are_parsed_in_small_batches(spark):
    from notegraph.plans import catalog

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for had, want in (("10000", "1000"), ("0", "1000"), ("256", "256")):
            spark.conf.set(key, had)
            catalog.pages_of(spark, "/root/testdata/sf0.001")
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_colors(spark):
    hues = [round(360 * colorsys.rgb_to_hls(*(x / 255 for x in bytes.fromhex(p[1:])))[0]) for p in color.palette(4)]
    assert color.palette(0) == [] and color.palette(4)[0] == "#6791e4" and hues == [220, 310, 40, 130]
    c = color.domain_colors(spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "domain string"), ["#ff0000", "#00ffff"])
    assert {r["domain"]: r["color"] for r in c.collect()} == {"a": "#ff0000", "b": "#00ffff", "c": "#ff0000"}
    rng = random.Random(3)
    known = {f"d{i}": "#" + bytes(rng.randrange(256) for _ in range(3)).hex() for i in range(12)} | {"gray": "#808080", "red": "#ff0000", "cyan": "#00ffff"}
    pages = {f"p{i}": rng.sample(sorted(known), rng.randrange(1, 4)) for i in range(60)} | {"none": ["?"], "two": ["red", "cyan"]}
    got = {r["name"]: r["color"] for r in color.blended(spark.createDataFrame([(p, d) for p, ds in pages.items() for d in ds], "name string, domain string"), spark.createDataFrame(list(known.items()), "domain string, color string")).collect()}
    for p, ds in pages.items():
        of = [colorsys.rgb_to_hls(*(x / 255 for x in bytes.fromhex(known[d][1:]))) for d in ds if d in known]
        if len(of) < 2:
            assert got[p] == (known[ds[0]] if of else "#cccccc")
            continue
        total = sum(cmath.exp(2j * math.pi * h) for h, _, _ in of)
        h = sum(x[0] for x in of) / len(of) if abs(total) < 0.05 * len(of) else cmath.phase(total) / (2 * math.pi) % 1
        rgb = colorsys.hls_to_rgb(h, max(0, sum(x[1] for x in of) / len(of) - 0.18), max(0, sum(x[2] for x in of) / len(of) - 0.05))
        assert all(abs(a - 255 * b) <= 1 for a, b in zip(bytes.fromhex(got[p][1:]), rgb)), p


def test_rectangles_and_manifest(spark):
    assert geometry.merge_rects([]) == []
    chain = [(0, 0, 10, 10), (35, 0, 45, 10), (70, 0, 80, 10), (300, 0, 310, 10), (5, 5, 5, 9)]
    assert geometry.merge_rects(chain) == [(0, 0, 80, 10), (300, 0, 310, 10), (5, 5, 5, 9)]
    assert geometry.merge_rects([(0, 0, 10, 10), (40, 0, 50, 10)]) == [(0, 0, 10, 10), (40, 0, 50, 10)]  # they touch only
    df = spark.createDataFrame([("p", i, *map(float, r)) for i, r in enumerate(chain)] + [("q", 0, 1.0, 1.0, 2.0, 2.0)], "page string, place long, x0 double, y0 double, x1 double, y1 double")
    assert geometry.merged_rects(df, "page").groupBy("page").count().orderBy("page").collect() == [("p", 3), ("q", 1)]
    for n, large in ((21, False), (100, False), (101, True)):
        text = one(spark, geometry.manifest(F.col("t"), F.lit(n), F.array(F.lit("a.png")), F.lit(None).cast("string")), t="raw/X.PDF")
        assert json.loads(text) == {"source": "raw/X.PDF", "format": "pdf", "pages": n, "large_doc": large, "images": ["a.png"], "transcript": None}


def test_cards_and_pulse(spark):
    entry = lambda ts, trigger, pages, links_, q, delta: (ts, trigger, pages, links_, 0, q, [], delta)
    h = spark.createDataFrame([
        entry("2024-01-01T09:00", "ingest", 10, 20, 0.5, None),
        entry("2024-01-01T10:00", "query", 10, 20, 0.5, ([], [], 0, 0, 0.0)),
        entry("2024-01-01T11:00", "save", 12, 30, 0.6, (["X", "Y"], [], 10, 3, 0.1)),
    ], metrics.HISTORY)
    m = spark.createDataFrame([(12, 30, 3, 4, 0.6)], "pages long, wikilinks long, orphans long, domains long, q double")
    got = {r["card"]: (r["value"], r["delta"], r["kind"]) for r in metrics.cards(m, h, "2024-01-01 12:00:00").collect()}
    assert len(got) == 15 and got["pages"] == ("12", "+2 за 24ч", "up") and got["orphans"] == ("3", "+3 за 24ч ⚠", "down") and got["domains"] == ("4", "без изменений", "")
    assert got["density"] == ("2.50", "+0.50 за 24ч", "up") and got["Q"] == ("0.600", "+0.100 за 24ч", "up") and got["sim_p50"] == ("—", "без изменений", "") and got["isolated"][:2] == ("—", "—")
    assert tuple(metrics.pulse(h, "2024-01-01 12:00:29").first()) == ("save", 60, False, 3)
    assert [r["ts"] for r in metrics.turns(h).collect()] == ["2024-01-01T11:00"]


def test_files_are_renamed_with_their_links(spark, tmp_path):
    for p, t in {"wiki/ideas/Old.md": "[[Old]]", "wiki/ideas/X.md": "[[Old#a|b]] [[raw/a/f.pdf]]", "raw/a/f.pdf": "x", "raw/n.md": "![[Old]]"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert fixes.rename_file(spark, str(tmp_path), "wiki/ideas/Old.md", "wiki/ideas/New.md") == ["raw/n.md", "wiki/ideas/New.md", "wiki/ideas/Old.md", "wiki/ideas/X.md"]
    assert (tmp_path / "wiki/ideas/New.md").read_text() == "[[New]]" and (tmp_path / "raw/n.md").read_text() == "![[New]]"
    for old, new in (("wiki/ideas/Old.md", "wiki/Z.md"), ("wiki/ideas/New.md", "wiki/ideas/X.md"), ("wiki/ideas/New.md", "raw/N.md")):
        with pytest.raises(ValueError):
            fixes.rename_file(spark, str(tmp_path), old, new)
    issues = rules.binary_outside_formats(vault.files(spark, str(tmp_path / "raw"), content=False))
    assert fixes.move_binaries(spark, str(tmp_path), issues) == ["raw/a/f.pdf"] and (tmp_path / "raw/formats/f.pdf").exists()
    assert (tmp_path / "wiki/ideas/X.md").read_text() == "[[New#a|b]] [[raw/formats/f.pdf]]"


def test_views_are_written_once(spark, wiki, tmp_path):
    pages = vault.read_pages(spark, wiki)
    out = str(tmp_path / "views")
    assert views.write_views(pages, out) == ["Dom", "dashboard"] and views.write_views(pages, out) == []
    assert views.write_text("a", f"{out}/i.md") and not views.write_text("a", f"{out}/i.md") and views.write_text("b", f"{out}/i.md")


def test_pairs_and_cohesion(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 5))
    v[3] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "name long, vec array<double>, g int")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    got = {(r["a"], r["b"]): r["sim"] for r in vectors.pairs(df).collect()}
    assert set(got) == {(i, j) for i in range(40) for j in range(i + 1, 40)} and all(abs(s - u[i] @ u[j]) < 1e-9 for (i, j), s in got.items())
    by = {}
    for r in vectors.pairs(df, group="g").collect():
        by.setdefault(r["g"], []).append(r["sim"])
    for r in vectors.cohesion(df, "g").collect():
        assert abs(r["cohesion"] - np.mean(by[r["g"]])) < 1e-9


def test_louvain_finds_the_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(6) for j in range(i + 1, 6)] + [("a0", "b0"), ("b1", "c1")]
    df = spark.createDataFrame(edges, "a string, b string")
    part = communities.louvain(df)
    groups = {}
    for r in part.collect():
        groups.setdefault(r["community"], set()).add(r["name"][0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"], ["c"]]
    q = communities.modularity(df, part).first()["q"]
    assert q > 0.6 and math.isfinite(q)
    assert links.most_connected(df.toDF("src", "dst")).count() >= 1


def test_most_connected_counts_what_links_to_a_page(spark):
    page = "---\ntype: idea\n---\n"
    pages = pages_from(spark, {"ideas/Hub.md": page + "[[A]] [[B]] [[C]]", "ideas/A.md": page + "[[B]]", "ideas/B.md": page, "ideas/C.md": page + "[[A]]"})
    assert sorted(map(tuple, links.most_connected(links.graph(pages, "map")).collect())) == [("A", 2), ("B", 2)]
    assert [tuple(r) for r in links.most_connected(links.graph(pages, "dash"), pages).collect()] == [("A", 2)]
    assert links.most_connected(links.graph(pages.where("name = 'B'"), "map")).count() == 0


def test_the_guard_of_modularity_counts_all_pages(spark):
    page = "---\ntype: idea\n---\n"
    texts = {"ideas/A.md": page + "[[B]] [[C]]", "ideas/B.md": page, "ideas/C.md": page}
    part = spark.createDataFrame([("A", 0), ("B", 0), ("C", 0), ("D", 1)], "name string, community int")
    assert metrics.vault_metrics(pages_from(spark, texts), part).first()["q"] is None
    assert metrics.vault_metrics(pages_from(spark, {**texts, "ideas/D.md": page}), part).first()["q"] == 0.0


def _same(a, b):
    norm = lambda rows: sorted(repr(tuple(None if x is None or x != x else round(float(x), 5) if isinstance(x, (float, int)) and not isinstance(x, bool) else x for x in r)) for r in rows)
    return norm(a) == norm(b)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(out.columns)
    assert _same([tuple(r) for r in out.select(*[F.col(f"`{n}`") for n in names]).collect()], cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and os.path.isdir(SF)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
