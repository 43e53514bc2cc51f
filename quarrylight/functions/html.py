"""Column functions on HTML, by patterns that stay inside the JVM; Python sees only texts with rare entities. A null text gives null."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrylight.functions.text import SPACE, strip

# fixed values: patterns of elements
TITLE, IMAGE = r"(?i)<title>([^<]+)</title>", r"(?i)<img\s+[^>]*src=[\"']([^\"']+)[\"']"
HEADING, ANCHOR = r"(?i)<h([1-6])[^>]*>([^<]+)</h\1>", r"(?di)<a\s+[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
META = r"(?i)<meta\s+name=\"([^\"]+)\"\s+content=\"([^\"]*)\""
# fixed values: common entities, the ampersand last
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


_RARE = r"&(?!(?:lt|gt|quot|#39|nbsp|copy|middot|amp);)(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);"


@F.pandas_udf(StringType())
def _common(texts: pd.Series) -> pd.Series:
    """Entities of all names and numbers as characters, those that would be markup under their common names."""
    return texts.map(lambda t: t if t is None else _ENTITY.sub(_as_common, t))


_ENTITY = re.compile(_RARE)


def _as_common(m: re.Match) -> str:
    char = unescape(m[0])
    return {"<": "&lt;", ">": "&gt;", "&": "&amp;", "\xa0": "&nbsp;"}.get(char, char)


def common_entities(c: Column) -> Column:
    """A text with no other entities than those that ``decode`` knows."""
    rare = c.rlike(_RARE)
    return F.coalesce(_common(F.when(rare, c)), c)


def decode(c: Column) -> Column:
    """The common entities as characters."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _without(c: Column, tags: tuple[str, ...]) -> Column:
    return F.regexp_replace(c, rf"(?is)<({'|'.join(tags)})\b.*?</\1\s*>", "") if tags else c


def html_text(c: Column, remove_tags: tuple[str, ...] = ()) -> Column:
    """Visible text: no scripts, styles, templates, comments, and none of ``remove_tags``; white space collapsed."""
    c = _without(common_entities(c), ("script", "style", "template", *remove_tags))
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode(c), f"(?U){SPACE}+", " "))


def html_strings(c: Column, remove_tags: tuple[str, ...] = ("script", "style", "nav", "footer")) -> Column:
    """The strings between tags, each trimmed and joined by a blank; white space inside a string is kept."""
    c = F.regexp_replace(_without(common_entities(c), remove_tags), r"(?s)<!--.*?-->", "")
    parts = F.transform(F.split(c, r"<[^>]*>"), lambda s: strip(decode(s)))
    return F.array_join(F.filter(parts, lambda s: s != ""), " ")


def title(c: Column, default: str | None = None) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, TITLE, 1), F.lit("")), F.lit(default))


def headings(c: Column) -> Column:
    """Headings without inner tags, in order: level and text."""
    pattern = HEADING
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).cast("array<int>").alias("level"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("text"))


def links(c: Column) -> Column:
    """Anchors within a line, in order: href and inner HTML."""
    pattern = ANCHOR
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).alias("href"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("anchor"))


def images(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IMAGE), 1)


def meta(c: Column) -> Column:
    """Named meta tags as a map; of a name given twice the first counts."""
    pattern = META
    names, values = (F.regexp_extract_all(c, F.lit(pattern), k) for k in (1, 2))
    values = F.split(common_entities(F.array_join(values, "\x1f")), "\x1f")
    pairs = F.arrays_zip(names.alias("k"), F.transform(values, decode).alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(first)


def clean_fragment(c: Column) -> Column:
    """A fragment for export: no style, script or inline styles; a document type and a character set in front."""
    c = F.regexp_replace(_without(c, ("style", "script")), r"(?i)\s+style=(?:\"[^\"]*\"|'[^']*')", "")
    head = F.when(c.rlike(r"(?i)<meta[^>]*charset"), "").otherwise('<meta charset="utf-8">\n')
    kind = F.when(c.rlike(r"(?i)^\s*<!doctype"), "").otherwise("<!DOCTYPE html>\n")
    return F.concat(kind, head, c)


def slug(url: Column, default: str = "index") -> Column:
    """The path of an address with underscores for slashes; a default for an empty path."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    return F.when(url.isNotNull(), F.coalesce(F.nullif(F.translate(path, "/", "_"), F.lit("")), F.lit(default)))


def export_page(title_col: Column, body: Column, style: str = "") -> Column:
    """A page of its own: style, heading, body. Nulls count as empty."""
    return F.concat(F.lit(style), F.lit("<h1>"), F.coalesce(title_col, F.lit("")), F.lit("</h1>\n"), F.coalesce(body, F.lit("")))


def paragraphs(c: Column, style: str = "") -> Column:
    """Text with its paragraphs between empty lines marked up."""
    return F.concat(F.lit(style), F.array_join(F.transform(F.split(c, "\n\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n"))
