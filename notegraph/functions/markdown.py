"""Column functions over markdown pages: headers, links, hashes, dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .header import parse_header

# Patterns whose matches define the data model.
HEADER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
HEADER_STRICT = r"(?s)\A---\n(.*?)\n---\s*\n"
WIKILINK = r"(?<!\!)\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
WORD = r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9_-]{2,}"

_STRINGS = T.ArrayType(T.StringType())
FIELDS = T.StructType().add("scalars", T.MapType(T.StringType(), T.StringType())).add("lists", T.MapType(T.StringType(), _STRINGS)).add("keys", _STRINGS).add("inline_lists", _STRINGS)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_quotes(c: Column) -> Column:
    """One matching pair of quotes off."""
    return F.regexp_replace(c, r"""(?s)^(["'])(.*)\1$""", "$2")


def has_header(text: Column) -> Column:
    return text.rlike(HEADER)


def header(text: Column, strict: bool = False) -> Column:
    """The header between its `---` lines; empty without one. strict: no spaces after the first line."""
    return F.regexp_extract(text, HEADER_STRICT if strict else HEADER, 1)


def body(text: Column) -> Column:
    """The text after the header."""
    return F.regexp_replace(text, HEADER, "")


def join_header(raw: Column, rest: Column) -> Column:
    return F.concat(F.lit("---\n"), raw, F.lit("\n---\n"), rest)


@F.pandas_udf(FIELDS)
def header_fields(raw: pd.Series) -> pd.DataFrame:
    """scalars, lists, keys and inline_lists of a header, in Arrow batches: a line's meaning depends on the lines before it."""
    return pd.DataFrame([parse_header(r) for r in raw.fillna("")], columns=["scalars", "lists", "keys", "inline_lists"])


def single_field(text: Column, field: str) -> Column:
    """A header field by one pattern, as index pages read it: a bare field takes the next line; doubled single quotes count as one."""
    found = F.regexp_extract(header(text, strict=True), rf"(?m)^\Q{field}\E:\s*(.+?)\s*$", 1)
    return F.replace(strip_quotes(found), F.lit("''"), F.lit("'"))


def link_text(text: Column, profile: str = "lint") -> Column:
    """text without code, and, in profile lint, with `\\|` unescaped."""
    t = F.regexp_replace(text, r"\\\|", "|") if profile in ("lint", "edge") else text
    return F.regexp_replace(F.regexp_replace(t, r"(?s)```.*?```", ""), r"`[^`\n]*`" if profile in ("lint", "edge") else r"`[^`\n]+`", "")


def link_target(t: Column, profile: str = "lint") -> Column:
    """The page that a target names: after the last `/`; raw targets stay whole, but in profile dash, which also drops `.md`."""
    last = F.element_at(F.split(t, "/"), -1)
    if profile == "dash":
        return F.regexp_replace(last, r"\.md$", "")
    return F.when(t.startswith("raw/"), t).otherwise(last)


def wikilinks(text: Column, profile: str = "lint") -> Column:
    """Targets of all links of a text, in order; embeds don't count."""
    return F.transform(F.regexp_extract_all(link_text(text, profile), F.lit(WIKILINK), F.lit(1)), lambda x: link_target(strip(x), profile))


def first_links(items: Column, profile: str = "dash") -> Column:
    """For each item of a list field its first link, or the item itself where it has none (profile dash)."""
    one = lambda x: F.regexp_extract(x, WIKILINK, 1)
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: link_target(strip(F.when(one(x) != "", one(x)).otherwise(x)), profile))


def list_links(items: Column) -> Column:
    """All links of a list field's items, and nothing where the field is missing."""
    return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: wikilinks(x)))


def canonical_fix(link: Column) -> Column:
    """`[[wiki/a/X#s|t]]` as `[[X#s|t]]`."""
    inner = F.regexp_extract(link, r"(?s)^\[\[(.*)\]\]$", 1)
    alias = F.split(inner, r"\|", 2)
    anchor = F.split(alias[0], "#", 2)
    return F.concat(F.lit("[["), link_target(strip(anchor[0])), F.when(F.size(anchor) > 1, F.concat(F.lit("#"), F.get(anchor, F.lit(1)))).otherwise(""), F.when(F.size(alias) > 1, F.concat(F.lit("|"), F.get(alias, F.lit(1)))).otherwise(""), F.lit("]]"))


def raw_key(link: Column) -> Column:
    """`[[raw/X]]` as `X.md`; null for other links."""
    x = F.regexp_extract(link, r"\[\[raw/([^\]]+)\]\]", 1)
    return F.when(x == "", F.lit(None)).when(x.endswith(".md"), x).otherwise(F.concat(x, F.lit(".md")))


def target_of_path(path: Column) -> Column:
    """How links name a file: a page by its stem, a source by its path without `.md`. Other paths raise."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.md)?$", 1)
    return F.when(path.startswith("wiki/"), stem).when(path.startswith("raw/"), F.regexp_replace(path, r"\.md$", "")).otherwise(F.raise_error(F.concat(F.lit("not below wiki/ or raw/: "), path)))


def rename_links(text: Column, old: str, new: str) -> Column:
    """text with every link and embed of old naming new, anchors and aliases kept."""
    quoted = "\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, rf"(!?)\[\[{quoted}(#[^\]|]*)?(\|[^\]]*)?\]\]", "$1[[" + new.replace("\\", "\\\\").replace("$", "\\$") + "$2$3]]")


def fill_placeholders(entry: Column, name: Column, as_of: str) -> Column:
    """Date and title placeholders of a template filled in."""
    dated = F.regexp_replace(entry, r"<%\s*tp\.date\.now\([^)]*\)\s*%>", as_of)
    parts = F.split(dated, r"<%\s*tp\.file\.title\s*%>", -1)
    return F.array_join(parts, "") if name is None else F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), parts[0], lambda a, x: F.concat(a, name, x))


def remove_field(raw: Column, field: str) -> Column:
    """The header without a field and the indented lines that belong to it."""
    return F.regexp_replace(F.regexp_replace(F.concat(raw, F.lit("\n")), rf"(?m)^\Q{field}\E[ \t]*:.*\n(?:[ \t]+.*\n)*", ""), r"\n\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(body(text), 256)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def plain_text(text: Column) -> Column:
    """text without code, wikilinks, images and links, for word counts."""
    for p in (r"(?s)```.*?```", r"`[^`\n]+`", WIKILINK, r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]]*\]\([^)]*\)"):
        text = F.regexp_replace(text, p, " ")
    return text


def abbreviation(name: Column) -> Column:
    """Initials in upper case."""
    return F.array_join(F.transform(F.array_remove(F.split(name, r"\s+"), ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "-"), r"^-+|-+$", "")


def days_since(date: Column, as_of: str) -> Column:
    """Whole days from a yyyy-MM-dd text to as_of, 0 at least; 10000 without a date."""
    days = F.datediff(F.lit(as_of).cast("date"), F.try_to_date(date, "yyyy-MM-dd"))
    return F.when(days.isNull(), 10_000).otherwise(F.greatest(F.lit(0), days))


def recency(days: Column, scale: float = 30.0) -> Column:
    return F.exp(-days / scale)


def clamp(v: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


# The texts of a change.
UNCHANGED, IN_A_DAY = "без изменений", " за 24ч"


def signed_delta(cur: Column, prev: Column, digits: int = 0, suffix: str = IN_A_DAY) -> Column:
    """A change as (text, kind): signed, with up or down; a fixed text and no kind where it is 0 or there is no value before."""
    diff = cur - prev
    none = prev.isNull() | (diff == 0)
    shown = F.concat(F.format_string(f"%+.{digits}f", diff.cast("double")), F.lit(suffix))
    return F.struct(F.when(none, UNCHANGED).otherwise(shown).alias("text"), F.when(none, "").when(diff > 0, "up").otherwise("down").alias("kind"))


def hex_to_rgb(c: Column) -> Column:
    """`#rrggbb`, `rrggbb` or `rgb(r, g, b)` as a struct of integers."""
    s = strip(c)
    digits = F.regexp_replace(s, "^#+", "")
    part = lambda i: F.conv(F.substring(digits, 2 * i - 1, 2), 16, 10).cast("int")
    listed = lambda i: F.regexp_extract(s, r"\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", i).try_cast("int")
    return F.struct(*[F.when(s.startswith("rgb"), listed(i)).otherwise(part(i)).alias(k) for i, k in ((1, "r"), (2, "g"), (3, "b"))])


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0") for x in (r, g, b)])


def node_size(degree: Column, most: Column, is_domain: Column, by_degree: bool = True) -> Column:
    """A node's radius: 10 to 32 on a square-root scale of its degree, 20 at least for a domain; else 28 for a domain and 18 for others."""
    if not by_degree:
        return F.when(is_domain, 28).otherwise(18)
    s = F.when(most > 0, F.bround(10 + 22 * F.sqrt(degree / F.nullif(most, F.lit(0))))).otherwise(10).cast("int")
    return F.when(is_domain, F.greatest(s, F.lit(20))).otherwise(s)


def linkify(text: Column) -> Column:
    """Wikilinks as HTML anchors."""
    pieces = F.split(text, r"\[\[[^\]|]+(?:\|[^\]]*)?\]\]", -1)
    found = F.regexp_extract_all(text, F.lit(r"\[\[[^\]|]+(?:\|[^\]]*)?\]\]"), F.lit(0))

    def anchor(m: Column) -> Column:
        page, alias = F.regexp_extract(m, r"\[\[([^\]|]+)", 1), F.regexp_extract(m, r"\|([^\]]*)\]\]", 1)
        return F.concat(F.lit('<a href="'), F.replace(F.url_encode(page), F.lit("+"), F.lit("%20")), F.lit('">'), F.when(alias != "", alias).otherwise(page), F.lit("</a>"))

    return F.array_join(F.flatten(F.zip_with(pieces, F.transform(found, anchor), lambda p, a: F.array(p, F.coalesce(a, F.lit(""))))), "")
