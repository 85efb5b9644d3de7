"""Titles of web pages and attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, squash
from .urls import file_name

# Words that make a title a menu entry.
NAVIGATION = ("주메뉴", "메뉴", "home", "login", "사이트맵", "검색")
# Named character references that are decoded in titles.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def decode(c: Column) -> Column:
    for name, to in NAMED:
        c = F.replace(c, F.lit(name), F.lit(to))
    return c


def _usable(c: Column) -> Column:
    title = squash(decode(F.regexp_replace(c, "<[^>]*>", " ")))
    return F.when((title != "") & ~contains_any(F.lower(title), NAVIGATION), F.substring(title, 1, 300))


def html_title(html: Column) -> Column:
    """og:title, else <title>, else the first h1; menu words are no title."""
    og = F.regexp_extract(html, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    heading = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.coalesce(_usable(og), _usable(title), _usable(heading))


def useful_share(c: Column) -> Column:
    text = F.trim(c)
    return F.when(F.length(text) < 2, 0.0).otherwise(F.regexp_count(text, F.lit("[0-9A-Za-z가-힣ㄱ-ㆎ]")) / F.length(text))


def text_title(content: Column, source: Column) -> Column:
    """The first line that is no link or menu, without heading marks; else the file's name without suffix."""
    lines = F.transform(F.split(content, r"\R"), lambda x: F.trim(x))
    bare = lambda x: F.trim(F.regexp_replace(x, r"(?U)^#+\s*", ""))
    keep = lambda x: (
        (bare(x) != "") & ~contains_any(F.lower(bare(x)), NAVIGATION) & ~bare(x).startswith("- [") & ~bare(x).startswith("* [")
        & ~bare(x).rlike(r"^\[.+\]\(.+\)$") & (useful_share(bare(x)) >= 0.35)
    )
    stem = F.regexp_replace(F.coalesce(file_name(source), source), r"\.[^.]*$", "")
    return F.substring(F.coalesce(bare(F.get(F.filter(lines, keep), F.lit(0))), F.nullif(stem, F.lit("")), source), 1, 300)
