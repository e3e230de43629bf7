"""Measures of a partition (name, community) over undirected edges (a, b), and partitions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Tables


def _ends(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(name, ca, other, cb) for both directions of each edge."""
    both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("other")), F.struct(F.col("b").alias("name"), F.col("a").alias("other")))))
    return both.join(part.select("name", F.col("community").alias("ca")), "name").join(part.select(F.col("name").alias("other"), F.col("community").alias("cb")), "other")


def modularity(edges: DataFrame, part: DataFrame) -> DataFrame:
    """One row, q: sum over communities of inner edges by all edges less the squared share of degree."""
    e = _ends(edges, part)
    by = e.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), 0.5).otherwise(0.0)).alias("inner_"), F.count("*").alias("degree"))
    return by.agg(F.sum("inner_").alias("l"), F.sum("degree").alias("d"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("dd")).select((F.col("l") * 2 / F.nullif(F.col("d"), F.lit(0)) - F.col("dd") / F.nullif(F.col("d").cast("double") * F.col("d"), F.lit(0.0))).alias("q"))


def participation(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(name, participation, degree, communities): 1 less the sum of squared shares of a node's links by community."""
    k = _ends(edges, part).groupBy("name", "cb").agg(F.count("*").alias("k"))
    d = k.groupBy("name").agg(F.sum("k").alias("degree"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"), F.count("*").alias("communities"))
    return d.select("name", (1 - F.col("kk") / (F.col("degree").cast("double") * F.col("degree"))).alias("participation"), "degree", "communities")


def bridges(edges: DataFrame, part: DataFrame, top: int | None = 5, above: float | None = None) -> DataFrame:
    """Nodes with links to two communities or more (above: with more participation than that), by rounded participation, degree, name."""
    p = participation(edges, part)
    p = p.where("communities > 1") if above is None else p.where(F.col("participation") > above)
    p = p.orderBy(F.desc(F.round("participation", 3)), F.desc("degree"), "name")
    return p.limit(top) if top else p


def community_sizes(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(community, size, inner, cohesion): cohesion is inner edges by possible ones."""
    sizes = part.groupBy("community").agg(F.count("*").alias("size"))
    inner = _ends(edges, part).where("ca = cb and name < other").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner"))
    n = F.col("size")
    return sizes.join(inner, "community", "left").select("community", "size", F.coalesce("inner", F.lit(0)).alias("inner"), F.when(n > 1, 2.0 * F.coalesce("inner", F.lit(0)) / (n * (n - 1))).otherwise(F.lit(0.0)).alias("cohesion"))


def sparse_communities(edges: DataFrame, part: DataFrame, least: int = 3, below: float = 0.15) -> DataFrame:
    return community_sizes(edges, part).where((F.col("size") >= least) & (F.col("cohesion") < below)).orderBy("cohesion", F.desc("size"), "community")


def sankey(domains: DataFrame, part: DataFrame, none: str = "без домена", least: int = 3) -> DataFrame:
    """(domain, community, flow): pages by primary domain and community of `least` members or more. domains: (name, domain)."""
    large = part.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("community")
    j = domains.join(part, "name").join(large, "community", "left_semi")
    return j.groupBy(F.coalesce("domain", F.lit(none)).alias("domain"), "community").agg(F.count("*").alias("flow")).orderBy(F.desc("flow"), "domain", "community")


def label_propagation(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(name, community, settled): a node takes its neighbours' most frequent label, ties the least. For graphs of any size.

    In each round about half of the nodes may change, chosen by a hash of name and round, so that neighbours don't swap labels for ever. It ends
    when no node would change, and settled is true, or after `rounds`, and settled tells that some would. Each round's labels are written, and the round's before deleted.
    """
    tables = Tables(edges.sparkSession)
    both = tables.write(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    labels = tables.write(both.select(F.col("a").alias("name")).distinct().withColumn("community", F.col("name")).withColumn("open", F.lit(True)))
    settled = False
    for i in range(rounds):
        votes = both.join(labels.select(F.col("name").alias("b"), "community"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("best")).withColumnRenamed("a", "name")
        turn = F.pmod(F.xxhash64("name", F.lit(i)), F.lit(2)) == 0
        step = labels.select("name", "community").join(best, "name").select("name", F.when(turn, F.col("best")).otherwise(F.col("community")).alias("community"), (F.col("best") != F.col("community")).alias("open"))
        labels, old = tables.write(step), labels
        tables.drop(old)
        if not labels.where("open").limit(1).count():
            settled = True
            break
    tables.drop(both)
    return labels.select("name", "community", F.lit(settled).alias("settled"))


#: A node with over this part of all ends of edges gets its community to its neighbours by broadcast: there are at most as many such nodes.
HUB_PART = 200


def _with_community(links: DataFrame, labels: DataFrame, hubs: bool, *more: str) -> DataFrame:
    """links (a, b, w, hub) with cb, the community of b, and more columns of b; hubs' labels are sent to the links instead of all of a hub's links to one task."""
    of = labels.select(F.col("name").alias("b"), F.col("community").alias("cb"), *more)
    columns = ["a", "cb", "w", *more]
    if not hubs:
        return links.join(of, "b").select(columns)
    few = links.where("hub").join(F.broadcast(of.join(F.broadcast(labels.where("hub").select(F.col("name").alias("b"))), "b")), "b")
    return links.where("not hub").join(of, "b").select(columns).unionByName(few.select(columns))


#: Rounds after which turns come again.
TURNS = 62


def _turns() -> Column:
    """A bit for each round: whether a node waits in it."""
    bits = [F.shiftleft(F.pmod(F.xxhash64("name", F.lit(i)), F.lit(2)), i) for i in range(TURNS)]
    return reduce(Column.bitwiseOR, bits)


def _held(links: DataFrame) -> DataFrame:
    """links kept where their b belongs, in order of b: a round then deals out labels and sums only, and doesn't sort links. To be unpersisted."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = links.repartition(parts, "b").sortWithinPartitions("b").persist()
    held.count()  # only once they are there does the planner know where they are
    return held


def _moves(tables: Tables, links: DataFrame, nodes: DataFrame, total: int, rounds: int, least: float) -> tuple[DataFrame, float]:
    """(labels, their modularity): rounds of simultaneous moves, each node to the neighbouring community with the greatest gain.

    links: as _held() gives them, since each round joins them by b. nodes: (name, community, k, loops, hub, turns) of degrees and twice the inner weight. So that neighbours don't swap places, a node that is alone joins
    another lonely one of a lesser name only, and half of the nodes wait, by hashes of name and round. A round's modularity follows
    from what it reads, so the best labels are known; it ends after three rounds that gain less than `least`, and gives the best.
    """
    hubs = nodes.where("hub").limit(1).count() > 0
    columns = ["name", "community", "k", "loops", "hub", "turns"]
    labels, best, best_q, idle = nodes, nodes, -1.0, 0
    for i in range(rounds + 1):
        tot = labels.groupBy("community").agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
        full = labels.select(*columns).join(tot, "community")
        own = full.select(F.col("name").alias("a"), F.col("community").alias("cb"), F.lit(0).cast("long").alias("w"), "tot", "n")
        near = _with_community(links, full, hubs, "tot", "n").unionByName(own).repartition("a")  # all that follows is by a
        near = near.groupBy("a", "cb").agg(F.sum("w").alias("w"), F.any_value("tot").alias("tot"), F.any_value("n").alias("n"))
        cand = near.join(full.select(F.col("name").alias("a"), F.col("community").alias("ca"), "k", "loops", "hub", "turns", F.col("n").alias("own_n")), "a")
        same = F.col("ca") == F.col("cb")
        cand = cand.withColumn("gain", F.col("w") - F.col("k").cast("double") * (F.col("tot") - F.when(same, F.col("k")).otherwise(0)) / total)
        swap = (F.col("own_n") == 1) & (F.col("n") == 1) & (F.col("cb") > F.col("ca"))
        cand = cand.withColumn("open", F.when(~swap, F.col("gain")))
        picked = cand.groupBy(F.col("a").alias("name")).agg(
            F.min_by(F.when(F.col("open").isNotNull(), F.col("cb")), F.struct(F.coalesce(-F.col("open"), F.lit(float("inf"))).alias("g"), "cb")).alias("to"), F.max("open").alias("gain"), F.max(F.when(same, F.col("gain"))).alias("stay"), F.max(F.when(same, F.col("w"))).alias("inner_w"),
            *[F.any_value(c).alias(c) for c in ("ca", "k", "loops", "hub", "turns")],
        )
        turn = F.shiftright("turns", i % TURNS).bitwiseAND(1) == 0
        better = F.col("gain") > F.col("stay") + 1e-12
        nxt = tables.write(picked.select("name", F.when(turn & better, F.col("to")).otherwise(F.col("ca")).alias("community"), "k", "loops", "hub", "turns", F.col("ca").alias("was"), (F.col("inner_w") + F.col("loops")).alias("inner_w"), better.alias("open")))
        by = nxt.groupBy("was").agg(F.sum("k").cast("double").alias("tot"), F.sum("inner_w").alias("inner_w"), F.count_if("open").alias("open"))
        inner, squares, open_ = by.agg(F.sum("inner_w"), F.sum(F.col("tot") * F.col("tot")), F.sum("open")).first()
        q = inner / total - squares / total / total
        idle = 0 if q > best_q + least else idle + 1
        old = best if q > best_q else labels
        if q > best_q:
            best, best_q = labels, q
        if old is not best and old is not nodes:
            tables.drop(old)
        labels = nxt
        if idle >= 3 or not open_:
            break
    if labels is not best:
        tables.drop(labels)
    return best.select(*columns), best_q


def louvain_rounds(edges: DataFrame, levels: int = 10, rounds: int = 24, least: float = 1e-3) -> DataFrame:
    """(name, community) by modularity gain for graphs of any size: moves in rounds of joins, then communities become the nodes of a weighted graph, and so on.

    A community is named by one of its nodes. Weights are whole numbers and ties go to the least name, so that the result doesn't depend on how the
    rows are dealt out. Nodes of the last level move once more one by one. No task and no driver sees the whole graph: each round joins links to
    labels and sums by node and community; links stay where they are, a hub's too. Once communities have FEW links or less between them (both directions),
    one task merges them further, as louvain does. Tables of finished rounds are deleted.
    """
    spark = edges.sparkSession
    tables = Tables(spark)
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).withColumn("w", F.lit(1).cast("long"))
    both = tables.write(both)
    total = both.count()
    if not total:
        return both.select(F.col("a").alias("name"), F.col("a").alias("community"))
    # Numbers in the order of names: all rounds compare and shuffle these, with the moves that the names would give.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = both.select(F.col("a").alias("name")).distinct().repartitionByRange(parts, "name").sortWithinPartitions("name")
    known = tables.write(known.select("name", F.monotonically_increasing_id().alias("id"), _turns().alias("turns")))
    of = lambda c: known.select(F.col("name").alias(c), F.col("id").alias(f"_{c}"))
    both = tables.write(both.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w"))
    turns = known.select(F.col("id").alias("name"), "turns")

    def level(links: DataFrame, loops: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(links with hub of b, nodes each in a community of its own)."""
        k = links.groupBy(F.col("a").alias("name")).agg(F.sum("w").alias("out"))
        if loops is not None:
            k = k.join(loops, "name", "full_outer")
        loops_ = F.coalesce("loops", F.lit(0)) if loops is not None else F.lit(0)
        k = k.select("name", F.col("name").alias("community"), (F.coalesce("out", F.lit(0)) + loops_).cast("long").alias("k"), loops_.cast("long").alias("loops"))
        nodes = tables.write(k.join(turns, "name").withColumn("hub", F.col("k") * HUB_PART > total))
        hubs = nodes.where("hub").select(F.col("name").alias("b"), F.lit(True).alias("hub"))  # at most HUB_PART
        return _held(tables.write(links.join(F.broadcast(hubs), "b", "left").select("a", "b", "w", F.coalesce("hub", F.lit(False)).alias("hub")))), nodes

    links, nodes = first, first_nodes = level(both, None)
    part, q = None, -1.0
    for _ in range(levels):
        labels, new_q = _moves(tables, links, nodes, total, rounds, least)
        step = labels.select("name", "community")
        joined = step if part is None else part.withColumnRenamed("community", "_c").join(step.withColumnRenamed("name", "_c"), "_c").select("name", "community")
        part = tables.write(joined)
        if new_q <= q + least:
            break
        q = new_q
        ends = links.join(step.select(F.col("name").alias("a"), F.col("community").alias("ca")), "a")
        moved = _named_ends(ends, labels, nodes.where("hub").limit(1).count() > 0)
        merged = tables.write(moved.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        loops = merged.where("a = b").select(F.col("a").alias("name"), F.col("w").alias("loops"))
        old = labels.groupBy(F.col("community").alias("name")).agg(F.sum("loops").alias("before"))
        loops = old.join(loops, "name", "left").select("name", (F.col("before") + F.coalesce("loops", F.lit(0))).alias("loops"))
        if links is not first:
            links.unpersist()
        between = merged.where("a <> b")
        if between.count() <= FEW:
            part, q = tables.write(_merged(part, between, loops, total)), new_q  # no worse than before
            break
        links, nodes = level(between, loops)
    start = first_nodes.drop("community").join(part, "name").select("name", "community", "k", "loops", "hub", "turns")
    fine, fine_q = _moves(tables, first, tables.write(start), total, rounds, least)
    part = (fine if fine_q > q else part).select(F.col("name").alias("_name"), F.col("community").alias("_community"))
    out = tables.write(part.join(of("name"), "_name").join(of("community"), "_community").select("name", "community"))
    for df in (links, first):
        df.unpersist()
    tables.drop_all(out)
    return out


#: Links between communities, both directions, that one task may merge; it holds some 100 bytes of each.
FEW = 4_000_000


def _merged(part: DataFrame, links: DataFrame, loops: DataFrame, total: int) -> DataFrame:
    """(name, community) after one task has merged communities. links (a, b, w) between them, both directions, and loops (name, loops): FEW at most and no more communities than that have links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        codes, names = pd.factorize(pd.concat([pdf["a"], pdf["b"]]), sort=True)
        a, b = codes.reshape(2, -1)
        own = a == b
        inner = np.zeros(len(names), np.int64)
        np.add.at(inner, a[own], pdf["w"].to_numpy()[own])
        order = np.lexsort((b[~own], a[~own]))
        found = _levels_of(a[~own][order], b[~own][order], pdf["w"].to_numpy()[~own][order], inner, total)
        for i in range(0, len(names), PART):
            yield pd.DataFrame({"community": names[i : i + PART], "to": names[found[i : i + PART]]})

    kind = part.schema["name"].dataType.simpleString()
    linked = loops.join(links.select(F.col("a").alias("name")).distinct(), "name", "left_semi")  # one without links stays
    rows = links.select("a", "b", "w").unionByName(linked.select(F.col("name").alias("a"), F.col("name").alias("b"), F.col("loops").alias("w")))
    to = rows.repartition(1).mapInPandas(run, f"community {kind}, to {kind}")
    return part.join(to, "community", "left").select("name", F.coalesce("to", "community").alias("community"))


def _named_ends(links: DataFrame, labels: DataFrame, hubs: bool) -> DataFrame:
    """links with ca and cb."""
    renamed = links.select(F.struct("a", "ca").alias("a"), "b", "w", "hub")
    return _with_community(renamed, labels, hubs).select(F.col("a.ca").alias("ca"), "cb", "w")


def numbered(part: DataFrame) -> DataFrame:
    """(name, community) with communities as numbers by size, then first member. Only the communities' sizes meet in one task."""
    from pyspark.sql import Window

    sizes = part.groupBy("community").agg(F.count("*").alias("n"), F.min("name").alias("first"))
    order = sizes.withColumn("i", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long"))
    return part.join(order.select("community", "i"), "community").select("name", F.col("i").alias("community"))


def louvain(edges: DataFrame) -> DataFrame:
    """(name, community) by greedy moves in name order until nothing gains, level by level; the same input gives the same result.

    Each move depends on the ones before, so one task works on the whole graph, by arrays of numbers; louvain_rounds needs no such task.
    Communities are numbered by size, then first member.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        ends = [[np.fromiter((seen.setdefault(x, len(seen)) for x in pdf[c]), np.int64, len(pdf)) for c in ("a", "b")] for pdf in batches]
        names = sorted(seen)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter((seen[x] for x in names), np.int64, len(names))] = np.arange(len(names))
        del seen
        a, b = (rank[np.concatenate([e[i] for e in ends])] if ends else rank for i in (0, 1))
        found = _levels(a, b, len(names))
        _, first, of, n = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
        number = np.empty(len(n), np.int64)
        number[np.lexsort((first, -n))] = np.arange(len(n))
        label = number[of]
        for i in range(0, len(names), PART):
            yield pd.DataFrame({"name": names[i : i + PART], "community": label[i : i + PART]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").repartition(1).mapInPandas(run, f"name {kind}, community long")


#: Nodes of a batch.
PART = 100_000


def _levels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The community of each node 0 to n - 1, named by a node of it."""
    keys = np.unique(np.concatenate([a * n + b, b * n + a]))
    return _levels_of(keys // max(n, 1), keys % max(n, 1), np.ones(len(keys), np.int64), np.zeros(n, np.int64), len(keys))


def _levels_of(src: np.ndarray, dst: np.ndarray, w: np.ndarray, loops: np.ndarray, total: int) -> np.ndarray:
    """As _levels, for links in both directions in order of src, with whole weights. A link inside counts twice in loops; total: of all weights and loops."""
    n = len(loops)
    names = label = np.arange(n)
    while True:
        degree = np.bincount(src, w, n).astype(np.int64) + loops
        at = np.asarray(_greedy(src, dst, w, degree, total), dtype=np.int64)
        if (at == np.arange(n)).all():
            return names[label]
        kept, to = np.unique(at, return_inverse=True)
        src, dst, m = to[src], to[dst], len(kept)
        inner = src == dst
        loops = (np.bincount(to, loops, m) + np.bincount(src[inner], w[inner], m)).astype(np.int64)
        keys, of = np.unique(src[~inner] * m + dst[~inner], return_inverse=True)
        w = np.bincount(of, w[~inner], len(keys)).astype(np.int64)
        src, dst, names, label, n = keys // m, keys % m, names[kept], to[label], m


def _greedy(src: np.ndarray, dst: np.ndarray, w: np.ndarray, degree: np.ndarray, total: int) -> list[int]:
    """Each node's community after moves in order, round after round until none gains. src is in order.

    A node's choice depends on its neighbours' communities and on the weights of these and its own. Once the communities that a round's moves touched have
    few ends of links, the next rounds only look at nodes for which one of these has changed since their last look; any other would stay. So the moves
    are the same as if each round looked at all.
    """
    n = len(degree)
    starts = np.searchsorted(src, np.arange(n + 1)).tolist()
    ids = list(range(n))  # one object for a number, however many links hold it
    near_of = [ids[x] for i in range(0, len(dst), PART) for x in dst[i : i + PART].tolist()]
    alike = bool((w == 1).all())
    weights = None if alike else w.tolist()
    degrees, weight, at = degree.tolist(), degree.tolist(), ids.copy()
    size = [y - x for x, y in zip(starts, starts[1:])]  # of a community: links of its nodes, which marking goes through
    due, members = bytearray(b"\1") * n, None
    touched = 1
    while touched:
        left = len(near_of) // 2  # marks of a round; beyond that, all nodes are looked at
        touched, v = 0, due.find(1)
        while v >= 0:
            v = ids[v]
            if members is not None:
                due[v] = 0
            i, j = starts[v], starts[v + 1]
            near: dict = {}
            if alike:
                for o in near_of[i:j]:
                    c = at[o]
                    near[c] = near.get(c, 0) + 1
            else:
                for o, x in zip(near_of[i:j], weights[i:j]):
                    c = at[o]
                    near[c] = near.get(c, 0) + x
            home, d = at[v], degrees[v]
            weight[home] -= d
            best, top = home, None
            for c, x in near.items():
                score = x - weight[c] * d / total
                if top is None or score > top or (score == top and c < best):
                    best, top = c, score
            if best != home and top <= near.get(home, 0) - weight[home] * d / total + 1e-12:
                best = home
            weight[best] += d
            if best != home:
                at[v] = best
                touched += size[home] + size[best]
                size[home] -= j - i
                size[best] += j - i
                if members is not None and touched > left:
                    members, due = None, bytearray(b"\1") * n
                elif members is not None:
                    members[home].remove(v)
                    members[best].append(v)
                    for c in (home, best):
                        for u in members[c]:
                            due[u] = 1
                            for o in near_of[starts[u] : starts[u + 1]]:
                                due[o] = 1
            v = due.find(1, v + 1)
        if members is None and 0 < touched <= left:
            members = {}
            for v in ids:
                members.setdefault(at[v], []).append(v)
    return at
