"""Stores and readers beside the pages: embedding indexes, history, view files, containers; and the dashboard's row and payload."""

import io
import json
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph import session
from notegraph.operators import communities, dashboard, layout, links, metrics, vectors
from notegraph.plans import bases
from notegraph.sources import containers, history, indexes, vault


def pages_from(spark, texts):
    return vault.parsed(spark.createDataFrame(sorted(texts.items()), "path string, text string"))


# Containers


def pdf_of(n, depth=1, packed=False, updated=0):
    """A made PDF with n pages in a tree of that depth, its objects in a compressed stream if packed, and pages added by an update."""
    objects, next_ = {}, [3]

    def tree(k, level, parent):
        me = next_[0]
        next_[0] += 1
        if level == 0:
            kids = []
            for _ in range(k):
                objects[next_[0]] = f"<< /Type /Page /Parent {me} 0 R >>"
                kids.append(next_[0])
                next_[0] += 1
        else:
            kids = [tree(len(part), level - 1, me) for part in np.array_split(np.arange(k), 2)]
        objects[me] = f"<< /Type /Pages /Count {k} /Kids [ {' '.join(f'{x} 0 R' for x in kids)} ] >>"
        return me

    root = tree(n, depth - 1, None)
    objects[1] = f"<< /Type /Catalog /Pages {root} 0 R >>"
    if packed:
        order = sorted(objects)
        bodies = [objects[k].encode() + b" " for k in order]
        starts = np.cumsum([0, *map(len, bodies)])[:-1]
        head = " ".join(f"{k} {s}" for k, s in zip(order, starts)).encode() + b" "
        data = zlib.compress(head + b"".join(bodies))
        out = b"%PDF-1.5\n2 0 obj << /Type /ObjStm /N " + str(len(order)).encode() + b" /First " + str(len(head)).encode() + b" /Filter /FlateDecode >> stream\r\n" + data + b"\nendstream endobj\n"
    else:
        out = b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n{v}\nendobj\n".encode() for k, v in objects.items())
    if updated:
        kids = " ".join(f"{900 + i} 0 R" for i in range(updated))
        out += "".join(f"{900 + i} 0 obj << /Type /Page >> endobj\n" for i in range(updated)).encode() + f"{root} 0 obj << /Type /Pages /Kids [{kids}] /Count {updated} >> endobj\n".encode()
    return out


def docx_of(names):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return f.getvalue()


def test_containers(spark, tmp_path):
    files = {
        "a/one.pdf": pdf_of(1), "deep.PDF": pdf_of(37, 3), "packed.pdf": pdf_of(120, 2, packed=True), "updated.pdf": pdf_of(5, updated=2), "broken.pdf": b"%PDF-1.4\nnothing", "no.pdf": b"x", "cut.pdf": pdf_of(9, packed=True)[:150],
        "d.docx": docx_of(["word/document.xml", "word/media/image2.PNG", "word/media/image1.jpeg", "word/media/x.emf"]), "bad.docx": b"PK\x03\x04zzz", "zip.docx": docx_of(["a.png"]), "other.txt": b"x",
    }
    for p, data in files.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(data)
    got = {r["path"]: r for r in containers.read_containers(spark, str(tmp_path)).collect()}
    assert set(got) == set(files) - {"other.txt"}
    assert {p: r["pages"] for p, r in got.items() if p.lower().endswith("pdf")} == {"a/one.pdf": 1, "deep.PDF": 37, "packed.pdf": 120, "updated.pdf": 2, "broken.pdf": None, "no.pdf": None, "cut.pdf": None}
    assert got["d.docx"]["pictures"] == ["image1.jpeg", "image2.PNG"]
    for p in ("broken.pdf", "no.pdf", "cut.pdf", "bad.docx", "zip.docx"):
        assert got[p]["reason"] and got[p]["pages"] is None and got[p]["pictures"] is None, p


# Embedding indexes


def texts(spark, rows):
    return spark.createDataFrame(rows, "name string, hash string, text string")


def test_both_indexes_move_together(spark, tmp_path):
    folder = str(tmp_path)
    embed = vectors.hashing_embedder
    wiki, raw = texts(spark, [("A", "1", "alpha beta"), ("B", "1", "gamma")]), texts(spark, [("S", "1", "delta")])
    out = indexes.update(spark, folder, wiki, raw, embed, "m1")
    assert out == {"version": 1, "actions": {"wiki": {"insert": 2}, "raw": {"insert": 1}}, "written": True}
    assert not indexes.update(spark, folder, wiki, raw, embed, "m1")["written"]
    before = {k: indexes.read_index(spark, folder, k).collect() for k in indexes.KINDS}

    @F.pandas_udf("array<double>")
    def failing(s):
        import pandas as pd

        if (s == "broken").any():
            raise RuntimeError("provider")
        return pd.Series([[1.0] * 64] * len(s))

    # The first index is written when the second one's provider fails.
    for bad in ((texts(spark, [("A", "2", "new")]), texts(spark, [("S", "2", "broken")])), (texts(spark, [("A", "2", "broken")]), raw)):
        with pytest.raises(Exception):  # noqa: B017
            indexes.update(spark, folder, *bad, failing, "m1")
        assert {k: indexes.read_index(spark, folder, k).collect() for k in indexes.KINDS} == before
    out = indexes.update(spark, folder, texts(spark, [("A", "2", "new"), ("C", "1", "c")]), raw, embed, "m1")
    assert out["actions"] == {"wiki": {"update": 1, "insert": 1, "delete": 1}, "raw": {"keep": 1}}
    kept = {r["name"]: r["vec"] for r in indexes.read_index(spark, folder, "raw").collect()}
    assert kept == {r["name"]: r["vec"] for r in before["raw"]}
    # Another model embeds all anew; a side may have no texts.
    out = indexes.update(spark, folder, texts(spark, []), raw, embed, "m2")
    assert out["version"] == 3 and indexes.read_index(spark, folder, "wiki").count() == 0
    assert {r["model"] for r in indexes.read_index(spark, folder, "raw").collect()} == {"m2"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["00000002", "00000003", "current.json"]
    indexes.update(spark, folder, wiki, raw, embed, "m2")
    assert [r["name"] for r in indexes.search(spark, folder, "wiki", "alpha beta", embed, 1).collect()] == ["A"]


# History


def entry(spark, ts, pages):
    return spark.createDataFrame([(ts, "t", pages, 1, 0, None, [], None)], metrics.HISTORY)


def test_history_is_a_log(spark, tmp_path):
    folder = str(tmp_path / "h")
    got = lambda **k: [(r["ts"], r["pages"]) for r in history.read(spark, folder, **k).orderBy("ts").collect()]
    assert got() == []
    rows = [("2024-01-01T10:00", 1, 1), ("2024-01-01T10:00", 2, 2), ("2024-01-01T11:00", 3, 3), ("2024-01-02T09:00", 4, 4)]
    for ts, pages, batch in rows:
        history.append(entry(spark, ts, pages), folder, batch)
    want = [("2024-01-01T10:00", 2), ("2024-01-01T11:00", 3), ("2024-01-02T09:00", 4)]
    assert got() == want and got(keep=2) == want[1:] and got(since="2024-01-02") == want[2:]
    history.append(entry(spark, *rows[1][:2]), folder, 2)  # the same batch again
    assert got() == want
    assert history.merge(spark, folder, 3) == ["2024-01-01"] and got() == want
    assert [p.name for p in (tmp_path / "h/day=2024-01-01").iterdir() if p.is_dir()] == ["upto=3"]
    history.append(entry(spark, *rows[1][:2]), folder, 2)  # a batch that is merged already
    assert got() == want
    history.append(entry(spark, "2024-01-01T11:00", 9), folder, 5)
    assert got()[1] == ("2024-01-01T11:00", 9) and history.merge(spark, folder) == []
    # A merge that stopped before its old parts were deleted.
    (tmp_path / "h/day=2024-01-01/batch=1").mkdir()
    (tmp_path / "h/day=2024-01-01/batch=1/_SUCCESS").touch()
    assert len(got()) == 3
    assert history.expire(spark, folder, "2024-01-02") == ["2024-01-01"] and got() == want[2:]


PAGE = "---\ntype: {}\nstatus: ready\ndomain:\n  - \"[[Dom]]\"\n---\n"


def vault_texts():
    """Two cliques of four pages, and one page between them."""
    out = {}
    for g, kind in (("A", "idea"), ("B", "entity")):
        for i in range(4):
            out[f"{'ideas' if g == 'A' else 'entities'}/{g}{i}.md"] = PAGE.format(kind) + " ".join(f"[[{g}{j}]]" for j in range(4) if j != i)
    return out | {"questions/X.md": PAGE.format("question") + "[[A0]] [[A1]] [[B0]] [[B1]] </script>", "domains/Dom.md": "---\ntype: domain\nprovenance: auto\n---\nwords words"}


def test_all_metrics_and_the_payload(spark, tmp_path):
    pages = pages_from(spark, vault_texts()).persist()
    rng = np.random.default_rng(1)
    index = spark.createDataFrame([(n, rng.normal(size=8).tolist()) for n in ("A0", "A1", "B0", "X")], "name string, vec array<double>")
    part = communities.louvain(links.undirected(links.graph(pages, "dash"))).persist()
    m = dashboard.all_metrics(pages, index, part).persist()
    r = m.first()
    assert (r["pages"], r["wikilinks"], r["orphans"], r["communities"], r["top_bridge"]["spans"]) == (10, 37, 1, 2, 2) and r["bridges"] >= 1
    assert r["most_connected"]["name"] == "Dom" and r["most_connected"]["inbound"] == 9
    assert r["types"] == {"idea": 4, "entity": 4, "question": 1, "domain": 1, "mind": 0} and r["provenance"] == {"manual": 9, "auto": 1} and r["statuses"] == {"ready": 9} and r["domains_dist"] == {"Dom": 9}
    vec = {x["name"]: np.array(x["vec"]) for x in index.collect()}
    cos = {(a, b): float(vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])) for a in vec for b in vec if a < b}
    assert abs(r["sim_p50"] - np.percentile(list(cos.values()), 50)) < 1e-9 and (r["closest"]["a"], r["closest"]["b"]) == max(cos, key=cos.get)
    assert abs(r["cohesion"]["Dom"] - np.mean(list(cos.values()))) < 1e-9
    folder = str(tmp_path / "h")
    assert history.record(m, folder, "2024-01-01 10:00:00", "ingest", 1)
    assert not history.record(m, folder, "2024-01-01 11:00:00", "query", 2)  # nothing changed
    more = dashboard.all_metrics(pages_from(spark, vault_texts() | {"ideas/N.md": PAGE.format("idea")}), part=part)
    assert history.record(more, folder, "2024-01-01 12:00:00", "save", 3) and not history.record(more, folder, "2024-01-01 12:00:00", "save", 3)
    h = history.read(spark, folder)
    last = h.orderBy(F.desc("ts")).first()
    assert last["delta"]["pages_added"] == ["N"] and last["types"]["idea"] == 5 and last["communities"] == 2
    sankey = spark.createDataFrame([("Dom", 0, 4), ("Dom", 1, 5)], "domain string, community int, flow long")
    tree = spark.createDataFrame([("Dom", None, 9), ("Dom", "idea", 4)], "domain string, type string, n long")
    first = dashboard.heavy_snapshot(sankey, tree, spark.createDataFrame([(None,)], "insights map<string,string>"), "2024-01-01T10:00:00", "knowledge-map-2024-01-01.html", None)
    told = first.withColumn("insights", F.create_map(F.lit("sankey"), F.lit("flows")))
    again = dashboard.heavy_snapshot(sankey, tree, told, "2024-01-02T10:00:00", "u.html", "g.html")
    text = again.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("text"))
    heavy = dashboard.read_heavy(text)
    assert heavy.first()["insights"] == {"sankey": "flows"} and [x["value"] for x in heavy.first()["sankey"]] == [5, 4]
    none = dashboard.read_heavy(spark.createDataFrame([("{broken",)], "text string")).first()
    assert (none["sankey"], none["insights"], none["umap_iframe"]) == ([], {}, None)
    words = spark.createDataFrame([("words", 2), ("other", 1)], "word string, n long")
    latest = vault.latest_snapshots(spark.createDataFrame([("snapshots/knowledge-map-2023-01-01.html",)], "path string"))
    for of, shown in ((heavy, "u.html"), (dashboard.read_heavy(spark.createDataFrame([], "text string")), "knowledge-map-2023-01-01.html")):
        text = dashboard.payload(m, h, words, of, latest, "2024-01-01 12:00:00", "Vault </x>").first()["json"]
        assert "</" not in text
        data = json.loads(text)
        assert set(data) == {"now", "vault_name", "history", "provenance", "statuses", "wordcloud", "sankey", "treemap", "insights", "latest_snapshot_date", "umap_iframe", "graph_iframe", "cards", "health"}
        assert data["umap_iframe"] == shown and [e["pages"] for e in data["history"]] == [10, 11] and "pages_list" not in data["history"][0]
        assert len(data["cards"]) == 15 and data["cards"]["most_connected"]["value"] == "Dom" and len(data["health"]["rows"]) == 5 and data["wordcloud"][0]["word"] == "words"
    pages.unpersist()
    m.unpersist()


# View files


def test_view_files_are_read_back(spark, tmp_path):
    pytest.importorskip("yaml")
    for base in (bases.GLOBAL, bases.domain_base('A "quoted" name', "AQN")):
        assert bases.parse(bases.text_of(base, bases.LABELS)) == base
    text = """
filters:
  and:
    - file.inFolder("wiki/")
    - or:
        - status == "ready"
        - not:
            - file.inFolder("wiki/ideas")
            - file.hasLink("A0")
views:
  - type: table
    name: V
    groupBy: {property: type, direction: DESC}
    order: [file.name, type]
    sort:
      - {property: file.name, direction: DESC}
"""
    base = bases.parse(text)
    texts = vault_texts() | {"ideas/Q.md": "---\ntype: idea\nstatus: odd\n---\n", "entities/L.md": "---\ntype: entity\nstatus: odd\n---\n[[A0]]", "entities/K.md": "---\ntype: entity\nstatus: odd\n---\n"}
    of = bases.rows(pages_from(spark, texts))
    got = [tuple(r) for r in bases.build(base, base.views[0], of).collect()]
    want = [(p.split("/")[-1][:-3], t.split("type: ")[1].split("\n")[0]) for p, t in texts.items() if "status: ready" in t or not (p.startswith("ideas/") or "[[A0]]" in t)]
    assert Counter(got) == Counter(want)
    assert [t for _, t in got] == sorted((t for _, t in got), reverse=True)
    assert all(a[0] >= b[0] for a, b in zip(got, got[1:]) if a[1] == b[1])
    for bad in ("a: [", "x", "views: 3", "filters:\n  xor:\n    - a\nviews: []"):
        with pytest.raises(ValueError):
            bases.parse(bad)
    for bad in ("import os", "file.inFolder(x)", "status = 1"):
        with pytest.raises(ValueError):
            bases.condition(bad)
    pages = pages_from(spark, texts)
    (tmp_path / "b").mkdir()
    (tmp_path / "b/dashboard.base").write_text("mine")
    assert bases.write_missing(pages, str(tmp_path / "b")) == ["Dom.base"] and bases.write_missing(pages, str(tmp_path / "b")) == []
    assert (tmp_path / "b/dashboard.base").read_text() == "mine"
    dom = bases.parse((tmp_path / "b/Dom.base").read_text())
    assert {r["name"] for r in bases.build(dom, dom.views[0], of).collect()} == {p.split("/")[-1][:-3] for p, t in texts.items() if "[[Dom]]" in t}


# Communities and the map


def quality(edges, part):
    """Modularity in plain Python."""
    m, deg, inner = len(edges), Counter(), Counter()
    for a, b in edges:
        deg[part[a]] += 1
        deg[part[b]] += 1
        inner[part[a]] += part[a] == part[b]
    return sum(inner[c] / m - (deg[c] / 2 / m) ** 2 for c in deg)


def test_rounds_neither_deal_out_links_nor_compare_names(spark, monkeypatch):
    """A round's join takes links as they are held, and its labels are numbers in the order of names."""
    rows = [(f"n{i}", f"n{(i + d) % 40}") for i in range(40) for d in (1, 2, 7)]
    seen, real = [], session.Tables.write

    def write(self, df):
        if "was" in df.columns:  # labels after a round
            seen.append((df.schema["name"].dataType.simpleString(), df._jdf.queryExecution().executedPlan().toString()))
        return real(self, df)

    monkeypatch.setattr(session.Tables, "write", write)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["name"]: r["community"] for r in communities.louvain_rounds(spark.createDataFrame(rows, "a string, b string"), rounds=3).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got) == {f"n{i}" for i in range(40)} and set(got.values()) <= set(got)
    assert seen and all(kind == "bigint" for kind, _ in seen)
    for _, plan in seen:
        by_b = [x for x in plan.splitlines() if "Exchange hashpartitioning(b#" in x and "ENSURE_REQUIREMENTS" in x]
        assert "InMemoryTableScan" in plan and len(by_b) == 1  # the labels


def test_louvain_by_rounds_is_as_good_as_in_one_task(spark):
    rng = np.random.default_rng(3)
    edges = {(f"n{a:03d}", f"n{b:03d}") for g in range(8) for a, b in rng.integers(0, 30, (150, 2)) + 30 * g if a < b} | {(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 240, (120, 2)) if a < b}
    edges |= {("hub", f"n{i:03d}") for i in range(0, 240, 2)}  # half of the nodes
    df = spark.createDataFrame(sorted(edges), "a string, b string")
    got = {r["name"]: r["community"] for r in communities.louvain_rounds(df).collect()}
    few = [{tuple(r) for r in communities.louvain_rounds(x, levels=1, rounds=1).collect()} for x in (df, df.repartition(3, "b"))]
    assert few[0] == few[1]
    one = {r["name"]: r["community"] for r in communities.louvain(df).collect()}
    assert set(got) == set(one) and quality(edges, got) > quality(edges, one) - 0.02
    assert all(c in got for c in got.values())
    assert communities.louvain_rounds(df.limit(0)).count() == 0
    n = {r["community"] for r in communities.numbered(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "name string, community string")).collect()}
    assert n == {0, 1}


def test_the_map_keeps_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16)) * 1.5
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.5).tolist()) for i in range(180)]
    index = spark.createDataFrame(rows, "name long, vec array<double>")
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {i: [int(j) for j in np.lexsort((np.arange(180), -s[i]))[:5]] for i in range(180)}
    got = {}
    for r in layout.knn(index, 5).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append(r["other"])
    assert got == want
    at = layout.neighbour_map(index, epochs=8)
    kept, plain = (layout.kept_neighbours(index, p).first()["kept"] for p in (at, vectors.projection_2d(index)))
    p = np.array([[r["x"], r["y"]] for r in at.orderBy("name").collect()])
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    brute = np.mean([len(set(np.argsort(d[i])[:10]) & set(np.lexsort((np.arange(180), -s[i]))[:10])) / 10 for i in range(180)])
    assert abs(kept - brute) < 0.01 and kept > plain + 0.03
    assert layout.neighbour_map(index.limit(2), epochs=2).count() == 2


def test_label_propagation_says_whether_it_settled(spark):
    path = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)], "a string, b string")
    assert {r["settled"] for r in communities.label_propagation(path, rounds=1).collect()} == {False}
    clique = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "a string, b string")
    assert {(r["community"], r["settled"]) for r in communities.label_propagation(clique).collect()} == {("a", True)}
    assert links.most_connected(clique.toDF("src", "dst")).count() == 1


def test_vectors_of_unlike_dimensions_are_an_error_and_null_ones_take_no_part(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", None)], "name string, vec array<double>")
    assert [(r["a"], r["b"]) for r in vectors.pairs(index).collect()] == [("a", "b")]
    bad = index.union(spark.createDataFrame([("d", [1.0])], index.schema))
    with pytest.raises(Exception, match="differ in dimension"):
        vectors.pairs(bad).collect()
