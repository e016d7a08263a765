"""HTML page audits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_text(html: Column, tag: str) -> Column:
    return F.trim(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}\b"))


def meta(html: Column, name: str) -> Column:
    """content of <meta name|property=...>, the attributes in either order."""
    a = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*content=["']([^"']*)["'][^>]*(?:name|property)=["']{name}["']""", 1)
    return F.when(a != "", a).otherwise(b)


def unescape(c: Column) -> Column:
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(to))
    return c


def visible_text(html: Column) -> Column:
    """Without scripts, styles, comments, navigation and tags; entities decoded, white space collapsed."""
    for tag in ("script", "style", "nav", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    html = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(html), r"\s+", " "))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\bhref=["']([^"']*)["']"""), F.lit(1))
