"""Data-quality rules: each makes issues from pages; a registry runs them all in one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..sources import vault
from . import links as L

# Allowed states.
STATUSES, MIND_STATUSES = ("evaluation", "in-progress", "ready"), ("draft", "stable", "deprecated")


def _type() -> Column:
    return F.coalesce(F.col("page_type"), F.lit(""))


def _scalar(k: str) -> Column:
    return F.try_element_at("fm_scalars", F.lit(k))


def _issue(df: DataFrame, type_: str, **payload: Column) -> DataFrame:
    return df.select(F.lit(type_).alias("type"), *[c.alias(k) for k, c in payload.items()])


def status_not_in_enum(pages: DataFrame) -> DataFrame:
    s, mind = _scalar("status"), _type() == "mind"
    bad = pages.where(F.col("has_fm") & (_type() != "entity") & s.isNotNull() & ~F.when(mind, s.isin(*MIND_STATUSES)).otherwise(s.isin(*STATUSES)))
    return _issue(bad, "status-not-in-enum", where=F.col("path"), value=s, fix=F.when(mind, "draft").otherwise("in-progress"))


def invalid_fields(pages: DataFrame, templates: DataFrame, as_of: str | None = None) -> DataFrame:
    """Fields that the type's template lacks (extra), and those that the page lacks (missing), with the template's entry, its placeholders filled."""
    t = templates.groupBy(F.col("type").alias("page_type")).agg(F.collect_set("field").alias("allowed"), F.map_from_entries(F.collect_list(F.struct("field", "entry"))).alias("entries"))
    j = pages.where(F.col("has_fm") & (_type() != "meta")).join(F.broadcast(t), "page_type")
    extra = j.select("path", F.lit("extra").alias("subtype"), F.explode(F.array_except("fm_keys", "allowed")).alias("field"), F.lit(None).cast("string").alias("entry"))
    missing = j.select("path", "name", "entries", F.explode(F.array_except("allowed", F.concat("fm_keys", F.array(F.lit("summary"), F.lit("provenance"))))).alias("field"))
    entry = M.fill_placeholders(F.try_element_at("entries", F.col("field")), F.col("name"), as_of) if as_of else F.try_element_at("entries", F.col("field"))
    missing = missing.select("path", F.lit("missing").alias("subtype"), "field", entry.alias("entry"))
    return _issue(extra.unionByName(missing), "invalid-fields", where=F.col("path"), subtype=F.col("subtype"), field=F.col("field"), entry=F.col("entry"))


def inline_tags(pages: DataFrame) -> DataFrame:
    bad = pages.where(F.array_contains("inline_lists", "tags") & (F.size(F.try_element_at("fm_lists", F.lit("tags"))) > 0))
    return _issue(bad, "inline-tags", where=F.col("path"))


def raw_link_with_extension(pages: DataFrame) -> DataFrame:
    items = pages.select("path", F.explode(F.try_element_at("fm_lists", F.lit("sources"))).alias("link"))
    stem = F.element_at(F.split(F.regexp_extract("link", r"^\[\[(raw/[^\]\|]+)\.md(\|[^\]]+)?\]\]$", 1), "/"), -1)
    return _issue(items.where((stem != "") & ~stem.contains(".")), "raw-link-with-extension", where=F.col("path"), link=F.col("link"))


def _not_meta(pages: DataFrame) -> DataFrame:
    return pages.where((_type() != "meta") & (F.col("folder") != "meta"))


def _lines(pages: DataFrame) -> DataFrame:
    return pages.select("path", F.posexplode(F.split("body", "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def raw_ref_in_body(pages: DataFrame) -> DataFrame:
    found = _lines(_not_meta(pages).where("has_fm")).select("path", "line", F.explode(F.regexp_extract_all("content", F.lit(r"\[\[raw/[^\]]+\]\]"), F.lit(0))).alias("link"))
    return _issue(found, "raw-ref-in-body", where=F.col("path"), line=F.col("line"), link=F.col("link"))


def _unfenced(pages: DataFrame) -> Column:
    """The body's lines outside of fences, which toggle line by line."""
    step = lambda a, x: F.struct(F.when(x.rlike(r"^\s*```"), ~a["fence"]).otherwise(a["fence"]).alias("fence"), F.concat(a["out"], F.array(F.when(a["fence"] | x.rlike(r"^\s*```"), "").otherwise(F.regexp_replace(x, r"`[^`]*`", "")))).alias("out"))
    return F.aggregate(F.split("body", "\n"), F.struct(F.lit(False).alias("fence"), F.array().cast("array<string>").alias("out")), step)["out"]


def _ordered_links(pages: DataFrame, code: bool) -> DataFrame:
    """(path, origin, ord, literal, raw_target, target) of body lines, then related, then domain; origin: `line n` or `frontmatter field`.

    Code in the body never counts; code in fields does if code is set.
    """
    body = pages.select("path", F.posexplode(_unfenced(pages)).alias("ord", "content")).select("path", F.concat(F.lit("line "), F.col("ord") + 1).alias("origin"), "ord", F.explode(F.regexp_extract_all(F.regexp_replace("content", r"\\\|", "|"), F.lit(r"(?<!\!)\[\[[^\]|#]+(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(0))).alias("literal"))
    fields = [pages.select("path", F.lit(f"frontmatter {f}").alias("origin"), F.posexplode(F.try_element_at("fm_lists", F.lit(f))).alias("ord", "item")).select("path", "origin", (F.col("ord") + 1_000_000_000 * k).alias("ord"), F.explode(F.regexp_extract_all(F.col("item") if code else M.link_text(F.col("item")), F.lit(r"(?<!\!)\[\[[^\]|#]+(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(0))).alias("literal")) for k, f in ((1, "related"), (2, "domain"))]
    every = reduce(DataFrame.unionByName, [body, *fields])
    return every.withColumn("raw_target", M.strip(F.regexp_extract("literal", M.WIKILINK, 1))).withColumn("target", M.link_target(F.col("raw_target")))


def link_aims(pages: DataFrame) -> DataFrame:
    """(path, target, origin): what each page links to, raw sources left out, with the first place of each target; pages of type or folder meta have none."""
    found = _ordered_links(_not_meta(pages), code=False).where(~F.col("target").startswith("raw/"))
    return found.groupBy("path", "target").agg(F.min_by("origin", "ord").alias("origin"))


def dead_link(pages: DataFrame) -> DataFrame:
    """Links to no page, the first of each page and target; pages of type or folder meta are left out."""
    one = link_aims(pages).join(pages.select(F.col("name").alias("target")).distinct(), "target", "left_anti")
    return _issue(one, "dead-link", where=F.col("path"), what=F.concat(F.lit("[["), "target", F.lit("]]")), context=F.col("origin"))


def orphan(pages: DataFrame) -> DataFrame:
    return _issue(L.orphans(pages).join(pages.select("name", "path"), "name"), "orphan", where=F.col("path"))


def asymmetric_related(pages: DataFrame) -> DataFrame:
    """page_a names page_b as related, but not the other way round; both by path. Pages of type mind are left out."""
    t = pages.groupBy("name").agg(F.max_by(F.struct("path", F.col("page_type").alias("t")), "path_parts").alias("p")).select("name", "p.*")
    rel = pages.select(F.col("name").alias("a"), F.explode(M.list_links(F.try_element_at("fm_lists", F.lit("related")))).alias("b")).where("a <> b").distinct()
    for k in "ab":
        rel = rel.join(t.select(F.col("name").alias(k), F.col("path").alias(f"page_{k}"), F.col("t").alias(f"page_{k}_type")), k)
    known = rel.where("coalesce(page_a_type, '') <> 'mind' and coalesce(page_b_type, '') <> 'mind'")
    back = rel.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return _issue(known.join(back, ["a", "b"], "left_anti"), "asymmetric-related", page_a=F.col("page_a"), page_b=F.col("page_b"), page_a_type=F.col("page_a_type"), page_b_type=F.col("page_b_type"))


def dangling_domain_ref(pages: DataFrame) -> DataFrame:
    refs = pages.where("has_fm").select("path", F.explode(M.list_links(F.try_element_at("fm_lists", F.lit("domain")))).alias("d")).where("not startswith(d, 'raw/')")
    return _issue(refs.join(pages.where("folder = 'domains'").select(F.col("name").alias("d")), "d", "left_anti"), "dangling-domain-ref", where=F.col("path"), missing_domain=F.col("d"))


def missing_summary(pages: DataFrame) -> DataFrame:
    bad = pages.where(F.col("has_fm") & F.col("folder").isin(*vault.FOLDER_TYPES) & (M.strip(F.coalesce(_scalar("summary"), F.lit(""))) == ""))
    kinds = F.create_map(*[F.lit(x) for kv in vault.FOLDER_TYPES.items() for x in kv])
    return _issue(bad, "missing-summary", where=F.col("path"), page_type=F.coalesce(F.nullif("page_type", F.lit("")), F.try_element_at(kinds, F.col("folder"))))


def binary_outside_formats(files: DataFrame) -> DataFrame:
    """files: (path) of the source tree."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    bad = files.where(suffix.isin(*vault.BINARY) & ~F.split("path", "/")[0].isin("formats", "meta"))
    return _issue(bad, "binary-source-outside-formats", where=F.concat(F.lit("raw/"), "path"), suggested=F.concat(F.lit("raw/formats/"), F.element_at(F.split("path", "/"), -1)))


def non_canonical_wikilink(pages: DataFrame) -> DataFrame:
    """Links with a path, the first of each page and literal in the body and in each field; pages of type or folder meta are left out."""
    found = _ordered_links(_not_meta(pages), code=True).where(F.col("raw_target").contains("/") & ~F.col("raw_target").startswith("raw/"))
    of = F.when(F.col("origin").startswith("line "), "body").otherwise(F.col("origin"))
    one = found.groupBy("path", "literal", of.alias("of")).agg(F.min_by("origin", "ord").alias("origin"))
    return _issue(one, "non-canonical-wikilink", where=F.col("path"), link=F.col("literal"), fix=M.canonical_fix(F.col("literal")), context=F.col("origin"))


def folder_type_mismatch(pages: DataFrame) -> DataFrame:
    expected = F.create_map(*[F.lit(x) for kv in vault.FOLDER_TYPES.items() for x in kv])
    e = F.try_element_at(expected, F.col("folder"))
    return _issue(pages.where(F.col("has_fm") & e.isNotNull() & ~F.col("page_type").eqNullSafe(e)), "folder-type-mismatch", where=F.col("path"), current_type=F.col("page_type"), expected_type=e)


#: In the order in which issues are reported and mended; invalid-fields comes second, and binary-source-outside-formats last.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "status-not-in-enum": status_not_in_enum,
    "inline-tags": inline_tags,
    "non-canonical-wikilink": non_canonical_wikilink,
    "folder-type-mismatch": folder_type_mismatch,
    "raw-link-with-extension": raw_link_with_extension,
    "raw-ref-in-body": raw_ref_in_body,
    "dead-link": dead_link,
    "orphan": orphan,
    "asymmetric-related": asymmetric_related,
    "dangling-domain-ref": dangling_domain_ref,
    "missing-summary": missing_summary,
}


def run_rules(pages: DataFrame, only: str | None = None, templates: DataFrame | None = None, files: DataFrame | None = None, as_of: str | None = None, extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All issues with rule_seq, in one plan; columns that a rule doesn't fill are null.

    templates (type, field, entry) add invalid-fields, files (path) of the source tree add binary-source-outside-formats. Each rule reads pages:
    persist them where parsing costs.
    """
    rules = list(REGISTRY.items())
    if templates is not None:
        rules.insert(1, ("invalid-fields", lambda p: invalid_fields(p, templates, as_of)))
    if files is not None:
        rules.append(("binary-source-outside-formats", lambda _: binary_outside_formats(files)))
    rules += list((extra or {}).items())
    parts = [f(pages).withColumn("rule_seq", F.lit(i)) for i, (k, f) in enumerate(rules) if only in (None, k)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def issue_involves(issues: DataFrame, touched: DataFrame, how: str) -> DataFrame:
    """Issues that name a touched page in where, page_a, page_b or mentioned_in (how: left_semi), or that don't (left_anti). touched: (page)."""
    names = F.array_compact(F.array(*[F.col(c) for c in ("where", "page_a", "page_b") if c in issues.columns]))
    if "mentioned_in" in issues.columns:
        names = F.concat(names, F.coalesce("mentioned_in", F.array().cast("array<string>")))
    marked = issues.withColumn("_k", F.xxhash64(*[F.col(c).cast("string") for c in issues.columns])).withColumn("_names", names)
    hit = marked.select("_k", F.explode("_names").alias("page")).join(touched, "page", "left_semi").select("_k").distinct()
    return marked.join(hit, "_k", how).drop("_k", "_names")


def touched(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(page): new or changed by hash. Both sides (page, hash)."""
    j = current.join(stored.select("page", F.col("hash").alias("_old")), "page", "left")
    return j.where(F.col("_old").isNull() | (F.col("_old") != F.col("hash"))).select("page")


def quick_scope(old: DataFrame, new: DataFrame, pages_touched: DataFrame) -> DataFrame:
    """Old issues that don't involve touched pages, and new ones that do."""
    return issue_involves(old, pages_touched, "left_anti").unionByName(issue_involves(new, pages_touched, "left_semi"), allowMissingColumns=True)
