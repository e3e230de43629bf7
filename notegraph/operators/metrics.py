"""Distributions, word counts, health, and the history of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..sources import vault
from . import communities, links

KINDS = tuple(vault.FOLDER_TYPES.values())

# Words that word counts leave out.
STOPWORDS = tuple(
    """
    это так что как для при или его ему её они над под без вид если когда уже также тоже там тут тогда потому поэтому только может должен
    нужно надо быть есть был была было будет будут очень ещё еще где куда откуда почему чтобы лишь хотя однако между вместо около вокруг через
    против после перед сразу потом затем наконец сначала сейчас теперь сегодня вчера завтра всего всех всем всё все себя своё свои своя свой
    наш ваш мне тебе мной тобой ним ней них нём нам вам что-то кого кому
    the and for are but not you all can had her was one our out day get has him his how man new now old see two way who boy did its let put
    say she too use with this that from they have been were what when where which while their there would could should into than then them
    these those such some more most very well also just like even only much many any every each both few other another same own
    """.split()
)


def primary_domain(pages: DataFrame) -> DataFrame:
    """(name, domain): the first item of the domain field, its link or else its text; null without one."""
    return pages.select("name", _primary().alias("domain"))


def _primary() -> Column:
    item = F.get(F.try_element_at("fm_lists", F.lit("domain")), F.lit(0))
    link = F.regexp_extract(item, M.WIKILINK, 1)
    return F.nullif(F.when(link != "", M.link_target(M.strip(link), "dash")).otherwise(M.strip(item)), F.lit(""))


def distributions(pages: DataFrame) -> DataFrame:
    """(measure, key, n) over pages with a header and a content type: type (all five), domain, provenance, status, and unassigned."""
    s = lambda k: F.try_element_at("fm_scalars", F.lit(k))
    of = pages.where(F.col("has_fm") & F.col("page_type").isin(*KINDS))
    d = _primary()
    one = lambda m, k: F.struct(F.lit(m).alias("measure"), k.alias("key"))
    rows = of.select(F.inline(F.array(one("type", F.col("page_type")), one("domain", d), one("provenance", F.coalesce(F.nullif(s("provenance"), F.lit("")), F.lit("manual"))), one("status", s("status")), one("unassigned", F.when(d.isNull(), "pages")))))
    counts = rows.where("key is not null").groupBy("measure", "key").agg(F.count("*").alias("n"))
    filled = pages.sparkSession.range(1).select(F.lit("type").alias("measure"), F.explode(F.array(*map(F.lit, KINDS))).alias("key"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(filled).groupBy("measure", "key").agg(F.sum("n").alias("n"))


def domain_counts(pages: DataFrame) -> DataFrame:
    """(domain, n): every domain of every content page."""
    return vault.content_pages(pages).select(F.explode(M.list_links(F.try_element_at("fm_lists", F.lit("domain")))).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def treemap(rows: DataFrame, domain: str, kind: str) -> DataFrame:
    """(domain, type, n) with totals by domain (type null)."""
    r = rows.select(F.col(domain).alias("domain"), F.col(kind).alias("type")).rollup("domain", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return r.where("g < 3").select("domain", F.when(F.col("g") == 0, F.col("type")).alias("type"), "n").orderBy("domain", F.desc("n"))


def word_counts(texts: DataFrame, id_col: str, text_col: str, stopwords: list[str], top: int | None = 60) -> DataFrame:
    """(word, n): words of three letters or more, lower-cased unless short and all capitals; ties by first use (id, place)."""
    w = texts.select(F.col(id_col).alias("_id"), F.posexplode(M.words(M.plain_text(F.col(text_col)))).alias("_pos", "w"))
    w = w.withColumn("word", F.when((F.length("w") <= 5) & (F.col("w") == F.upper("w")), F.col("w")).otherwise(F.lower("w")))
    w = w.where(~F.lower("word").isin(*stopwords) & (F.length("word") >= 3)) if stopwords else w.where(F.length("word") >= 3)
    c = w.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_pos")).alias("_first")).orderBy(F.desc("n"), "_first")
    return (c.limit(top) if top else c).select("word", "n")


def font_scale(counts: DataFrame, low: float = 13.0, span: float = 47.0) -> DataFrame:
    """counts (word, n) with a font size; equal counts have none."""
    r = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return counts.join(F.broadcast(r)).select("word", "n", (low + span * (F.col("n") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).alias("size"))


def health(m: DataFrame, variant: str = "engine") -> DataFrame:
    """m (pages, wikilinks, orphans, ready, content, unassigned, q) with five scores of 0 to 100 and their weighted total.

    engine: a zero or missing q scores 50. ui: only a missing one does, and the domain score is 100. No pages: total 0.
    """
    p = F.greatest(F.col("pages"), F.lit(1)).cast("double")
    out = m.withColumns({
        "orphan_score": M.clamp(100 - F.col("orphans") / p * 1000),
        "density_score": M.clamp(100 - F.abs(F.col("wikilinks") / p - 7) * 14),
        "q_score": F.when(F.col("q").isNull() if variant == "ui" else F.coalesce("q", F.lit(0.0)) == 0, 50.0).otherwise(M.clamp(F.col("q") / 0.7 * 100)),
        "ready_score": M.clamp(F.col("ready") / p * 100),
        "domain_score": F.lit(100.0) if variant == "ui" else M.clamp((F.col("content") - F.col("unassigned")) / F.greatest(F.col("content"), F.lit(1)) * 100),
    })
    total = 0.25 * F.col("orphan_score") + 0.15 * F.col("density_score") + 0.25 * F.col("q_score") + 0.2 * F.col("ready_score") + 0.15 * F.col("domain_score")
    rounded = (F.floor(total + 0.5) if variant == "ui" else F.bround(total)).cast("int")
    out = out.withColumn("total", F.when(F.col("pages") == 0, 0).otherwise(rounded))
    return out.withColumn("grade", F.when(F.col("total") >= 80, "good").when(F.col("total") >= 60, "warn").otherwise("bad"))


def vault_metrics(pages: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """One row of what a vault measures: pages (of a content type), pages_list, wikilinks, orphans, ready, content, unassigned, domains, and q of the partition
    part (name, community) of its links, null without one or for fewer than two links or four pages, linked or not. Each is one aggregate."""
    of = pages.where(F.col("has_fm") & F.col("page_type").isin(*KINDS))
    status = F.try_element_at("fm_scalars", F.lit("status"))
    d = _primary()
    counts = of.agg(F.count("*").alias("pages"), F.array_sort(F.collect_list("name")).alias("pages_list"), F.count_if(F.coalesce(status == "ready", F.lit(False))).alias("ready"), F.count("*").alias("content"), F.count_if(d.isNull()).alias("unassigned"), F.count_distinct(d).alias("domains"))
    edges = links.graph(pages, "dash")
    row = counts.join(F.broadcast(edges.agg(F.count("*").alias("wikilinks")))).join(F.broadcast(links.orphans(pages, "dash").agg(F.count("*").alias("orphans"))))
    if part is None:
        return row.withColumn("q", F.lit(None).cast("double"))
    both = links.undirected(edges)
    row = row.join(F.broadcast(communities.modularity(both, part))).join(F.broadcast(both.agg(F.count("*").alias("_m")))).join(F.broadcast(pages.agg(F.count_distinct("name").alias("_k"))))
    return row.withColumn("q", F.when((F.col("_m") >= 2) & (F.col("_k") >= 4), F.col("q"))).drop("_m", "_k")


def with_delta(history: DataFrame, numbers: list[str], pages: str | None = None) -> DataFrame:
    """history (ts, ...) with the change of each number since the entry before (null at the first), and pages added and removed."""
    w = Window.orderBy("ts")  # an entry a turn: a few hundred rows after retention
    out = history.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in numbers})
    if pages:
        before = F.lag(pages).over(w)
        out = out.withColumns({"pages_added": F.array_sort(F.array_except(pages, before)), "pages_removed": F.array_sort(F.array_except(before, F.col(pages)))})
    return out


def meaningful(added: Column, removed: Column, wikilinks: Column) -> Column:
    return (F.coalesce(F.size(added), F.lit(0)) > 0) | (F.coalesce(F.size(removed), F.lit(0)) > 0) | (F.coalesce(wikilinks, F.lit(0)) != 0)


def last_per_minute(entries: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The last entry of each minute (and key)."""
    w = Window.partitionBy(F.date_trunc("minute", "ts"), *(keys or [])).orderBy(*[F.desc(c) for c in order])
    return entries.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def retained(entries: DataFrame, keep: int = 365) -> DataFrame:
    return entries.orderBy(F.desc("ts")).limit(keep)


def day_totals(history: DataFrame, now: str) -> DataFrame:
    """One row over the entries (ts, delta) of the last 24 hours that have a delta: pages_added in order, sums of wikilinks and orphans, and of Q where any has one."""
    of = history.where((F.col("ts").cast("timestamp") > F.lit(now).cast("timestamp") - F.expr("interval 24 hours")) & F.col("delta").isNotNull())
    lists = F.array_sort(F.collect_list(F.struct("ts", F.coalesce("delta.pages_added", F.array().cast("array<string>")).alias("added"))))
    total = lambda c: F.coalesce(F.sum(f"delta.{c}"), F.lit(0)).alias(c)
    return of.agg(F.flatten(lists["added"]).alias("pages_added"), total("wikilinks"), total("orphans"), F.sum("delta.Q").alias("Q"))


#: Columns of a history.
HISTORY = "ts string, `trigger` string, pages long, wikilinks long, orphans long, Q double, pages_list array<string>, delta struct<pages_added:array<string>,pages_removed:array<string>,wikilinks:long,orphans:long,Q:double>"


#: With what a whole row of metrics has besides.
FULL_HISTORY = HISTORY + ", communities long, bridges long, sim_p50 double, sim_p75 double, sim_p95 double, types map<string,long>, domains map<string,long>, cohesion map<string,double>"


def history_entry(m: DataFrame, history: DataFrame, now: str, trigger: str) -> DataFrame:
    """The next entry (HISTORY, or FULL_HISTORY of a row of all metrics): m with the change since the history's last entry; delta is null for the first."""
    more = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("communities", "bridges")] + ["sim_p50", "sim_p75", "sim_p95", "types", F.col("domains_dist").alias("domains"), "cohesion"] if "domains_dist" in m.columns else []
    before = history.orderBy(F.desc("ts")).limit(1).select(F.struct("pages_list", "wikilinks", "orphans", "Q").alias("b"))
    j = m.join(F.broadcast(before.groupBy().agg(F.first("b").alias("b"))))
    none = F.array().cast("array<string>")
    cur, old = F.col("pages_list"), F.coalesce("b.pages_list", none)
    change = lambda c: (F.col(c) - F.coalesce(f"b.{c}", F.col(c))).cast("long").alias(c)
    delta = F.struct(F.array_sort(F.array_except(cur, old)).alias("pages_added"), F.array_sort(F.array_except(old, cur)).alias("pages_removed"), change("wikilinks"), change("orphans"), (F.col("q") - F.col("b.Q")).alias("Q"))
    out = j.select(F.date_format(F.lit(now).cast("timestamp"), "yyyy-MM-dd'T'HH:mm").alias("ts"), F.lit(trigger).alias("trigger"), "pages", "wikilinks", "orphans", F.col("q").alias("Q"), "pages_list", F.when(F.col("b").isNotNull(), delta).alias("delta"), *more)
    return out


def worth_keeping(entry: DataFrame) -> DataFrame:
    """entry, or no row if nothing changed since the entry before; a first one, without delta, is kept."""
    d = F.col("delta")
    return entry.where(d.isNull() | meaningful(d["pages_added"], d["pages_removed"], d["wikilinks"]))


def appended(history: DataFrame, entry: DataFrame, keep: int = 365) -> DataFrame:
    """history with entry: one without a meaningful change is left out, unless it is the first; the last entry of the same minute is replaced; the newest `keep` stay."""
    told = worth_keeping(entry)
    rest = history.join(F.broadcast(told.select("ts")), "ts", "left_anti").select(*entry.columns)
    return retained(rest.unionByName(told), keep)


def pulse(history: DataFrame, now: str) -> DataFrame:
    """One row on the last entry: its trigger, whole minutes since, whether it was quiet (no page added, no change of links), and the number of entries of the day."""
    at = F.col("ts").cast("timestamp")
    last = F.max_by(F.struct("trigger", "delta", at.alias("at")), "ts")
    today = F.count_if(F.to_date(at) == F.to_date(F.lit(now).cast("timestamp")))
    row = history.agg(last.alias("l"), today.alias("turns_today"))
    d = F.col("l.delta")
    quiet = d.isNull() | ((F.coalesce(F.size(d["pages_added"]), F.lit(0)) == 0) & (d["wikilinks"] == 0))
    minutes = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("l.at")) / 60 + 0.5).cast("int")
    return row.where("l is not null").select("l.trigger", minutes.alias("minutes_ago"), quiet.alias("quiet"), "turns_today")


def turns(history: DataFrame) -> DataFrame:
    """Entries with a delta, the newest first; query turns that changed nothing are left out."""
    d = F.col("delta")
    empty = ~meaningful(d["pages_added"], d["pages_removed"], d["wikilinks"])
    return history.where(d.isNotNull() & ~(empty & F.col("trigger").contains("query"))).select("ts", "trigger", "delta").orderBy(F.desc("ts"))


# Texts of the cards.
SAME, IN_A_DAY, NOTHING = "без изменений", " за 24ч", "—"


def cards(m: DataFrame, history: DataFrame, now: str) -> DataFrame:
    """(card, value, delta, kind) of the fifteen cards. m: one row of vault_metrics; other columns that it lacks (communities, bridges, sim_p50, sim_p75, sim_p95,
    most_connected (name, inbound), top_bridge (name, participation, spans), closest (a, b, sim), isolated (name, nearest)) count as null.

    Pages, links and orphans change by the sums of 24 hours; Q, density and similarities against the entry before the last.
    """
    shapes = {"communities": "long", "bridges": "long", "sim_p50": "double", "sim_p75": "double", "sim_p95": "double", "most_connected": "struct<name:string,inbound:long>", "top_bridge": "struct<name:string,participation:double,spans:long>", "closest": "struct<a:string,b:string,sim:double>", "isolated": "struct<name:string,nearest:double>"}
    m = m.withColumns({k: F.lit(None).cast(t) for k, t in shapes.items() if k not in m.columns})
    known = [F.col(c) if c in history.columns else F.lit(None).cast("double").alias(c) for c in ("pages", "wikilinks", "Q", "sim_p50", "sim_p75", "sim_p95")]
    two = history.select("ts", *known).orderBy(F.desc("ts")).limit(2).agg(F.count("*").alias("k"), F.min_by(F.struct("pages", "wikilinks", "Q", "sim_p50", "sim_p75", "sim_p95"), "ts").alias("p"))
    day = day_totals(history, now).select(F.struct(F.size("pages_added").cast("long").alias("pages"), "wikilinks", "orphans").alias("day"))
    row = m.join(F.broadcast(two.select(F.when(F.col("k") > 1, F.col("p")).alias("prev")))).join(F.broadcast(day))
    text = lambda c, digits: F.coalesce(F.format_string(f"%.{digits}f", c.cast("double")), F.lit(NOTHING))
    card = lambda k, value, delta=F.lit(SAME), kind=F.lit(""): F.struct(F.lit(k).alias("card"), value.cast("string").alias("value"), F.coalesce(delta, F.lit(SAME)).alias("delta"), F.coalesce(kind, F.lit("")).alias("kind"))

    def summed(k: str) -> Column:
        n = F.col(f"day.{k}")
        good = n < 0 if k == "orphans" else n > 0
        mark = F.when(n > 2, " ⚠").otherwise("") if k == "orphans" else F.lit("")
        return card(k, F.col(k), F.when(n != 0, F.concat(F.format_string("%+d", n), F.lit(IN_A_DAY), mark)), F.when(n != 0, F.when(good, "up").otherwise("down")))

    def against(k: str, cur: Column, old: Column, digits: int, least: float) -> Column:
        diff = cur - old
        moved = F.abs(diff) >= least
        shown = F.when(cur.isNull(), NOTHING).otherwise(text(cur, digits))
        return card(k, shown, F.when(moved, F.concat(F.format_string(f"%+.{digits}f", diff), F.lit(IN_A_DAY))), F.when(moved, F.when(diff > 0, "up").otherwise("down")))

    def told(k: str, value: Column, delta: Column) -> Column:
        return card(k, F.coalesce(value, F.lit(NOTHING)), F.coalesce(delta, F.lit(NOTHING)))

    per = lambda w, p: w / F.nullif(p, F.lit(0))
    density = F.coalesce(per(F.col("wikilinks"), F.col("pages")), F.lit(0.0))
    bridge = F.when(F.col("top_bridge").isNotNull(), F.concat(F.lit("P="), text(F.col("top_bridge.participation"), 2), F.lit(" · "), F.col("top_bridge.spans"), F.lit(" сообщ.")))
    every = [
        summed("pages"), summed("wikilinks"), card("domains", F.col("domains")), summed("orphans"),
        told("most_connected", F.col("most_connected.name"), F.concat("most_connected.inbound", F.lit(" входящих"))), told("top_bridge", F.col("top_bridge.name"), bridge),
        against("density", density, per(F.col("prev.wikilinks"), F.col("prev.pages")), 2, 0.005), against("Q", F.col("q"), F.col("prev.Q"), 3, 0.001),
        card("communities", F.coalesce("communities", F.lit(0))), card("bridges", F.coalesce("bridges", F.lit(0))),
        *[against(k, F.col(k), F.col(f"prev.{k}"), 3, 0.001) for k in ("sim_p50", "sim_p75", "sim_p95")],
        told("closest_pair", F.concat("closest.a", F.lit(" ↔ "), "closest.b"), F.when(F.col("closest").isNotNull(), text(F.col("closest.sim"), 3))),
        told("isolated", F.col("isolated.name"), F.when(F.col("isolated").isNotNull(), F.concat(F.lit("max "), text(F.col("isolated.nearest"), 3)))),
    ]
    return row.select(F.array(*every).alias("_cards")).select(F.inline("_cards"))


def for_display(history: DataFrame) -> DataFrame:
    """history without the page lists, which only the next delta needs."""
    return history.drop("pages_list")


def last_day(entries: DataFrame, now: str, sums: list[str]) -> DataFrame:
    """Sums over entries after now - 24 h."""
    return entries.where(F.col("ts") > F.lit(now).cast(entries.schema["ts"].dataType) - F.expr("interval 24 hours")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.count("*").alias("entries"))


def in_range(entries: DataFrame, now: str, days: int | None) -> DataFrame:
    return entries if days is None else entries.where(F.col("ts") >= F.lit(now).cast(entries.schema["ts"].dataType) - F.expr(f"interval {days} days"))


def series(entries: DataFrame, counts: str, keys: list[str]) -> DataFrame:
    """ts and a column for each key of a map column; missing ones 0."""
    return entries.select("ts", *[F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0)).alias(k) for k in keys])
