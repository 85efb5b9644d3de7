"""Text normalisation, line cleaning, tokens and keys.

Case folding is lower() with ß written as ss; Python's casefold differs from it in a few other
characters only. White space is Unicode white space throughout.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"

# What marks a line as page furniture (substrings of the folded line).
SKIP_LINE_TOKENS = (
    "본문 바로가기", "skip to content", "sns공유", "공유하기", "페이스북", "트위터", "카카오스토리", "네이버블로그", "인스타그램",
    "youtube", "login", "logout", "home", "추천검색어", "인기 검색어", "내가찾은 검색어", "자동완성",
)
# Two of these in a line make it a menu.
MENU_TOKENS = ("대학상징", "대학ㆍ조직", "홍보미디어", "캠퍼스안내", "학교찾아오기", "모바일 서비스", "전화번호", "이사회 회의록", "학칙")
# Lines at which content begins, line beginnings at which it ends, and lines that a
# content page repeats from its menu.
START_TITLES = ("학사일정(학부)", "졸업요건", "faq")
END_PREFIXES = ("이전글", "다음글", "목록", "첨부파일")
HOME_LINES = ("home", "대학생활")
# Markdown that goes from a line, and what stays of it.
MARKDOWN = ((r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?U)^[-*]\s+", ""), (r"(?U)^#+\s*", ""))


@dataclass(frozen=True)
class LineRules:
    """Words by which lines are judged; sites pass their own beside or in place of the defaults."""

    skip: tuple[str, ...] = SKIP_LINE_TOKENS
    menu: tuple[str, ...] = MENU_TOKENS
    start: tuple[str, ...] = START_TITLES
    end: tuple[str, ...] = END_PREFIXES
    home: tuple[str, ...] = HOME_LINES


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalize_title(c: Column) -> Column:
    return squash(fold(c))


def normalize_value(c: Column) -> Column:
    return strip(fold(F.coalesce(c, F.lit(""))))


def normalize_content(c: Column) -> Column:
    """Folded, links replaced by their texts, white space squashed."""
    return squash(F.regexp_replace(fold(c), LINK, "$1"))


def contains_any(c: Column, tokens: tuple[str, ...]) -> Column:
    """Whether any of some literal tokens occurs in the text."""
    found = F.lit(False)
    for t in tokens:
        found = found | c.contains(t)
    return found


def count_of(c: Column, tokens: tuple[str, ...]) -> Column:
    """How many of some literal tokens occur in the text."""
    total = F.lit(0)
    for t in tokens:
        total = total + c.contains(t).cast("int")
    return total


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of some literal words."""
    return "|".join(re.escape(w) for w in words) or r"\b\B"


def strip_markdown(line: Column) -> Column:
    """A line without images, link targets, one leading bullet and heading marks."""
    for pattern, to in MARKDOWN:
        line = F.regexp_replace(line, pattern, to)
    return squash(line)


def first_index(array: Column, test) -> Column:
    """Index from 0 of the first element that passes; null if none does."""
    return F.array_min(F.transform(array, lambda x, i: F.when(test(x), i)))


def folded(lines: Column) -> Column:
    """array<struct<x, low>>: each line beside its folded form, which is made once and then only looked at."""
    return F.transform(lines, lambda x: F.struct(x.alias("x"), normalize_title(x).alias("low")))


def kept_line(line: Column, on_page: Column, rules: LineRules) -> Column:
    """Whether a cleaned line is neither blank nor furniture: skip words, bare URLs, menus, single characters."""
    x, low = line["x"], line["low"]
    furniture = contains_any(low, rules.skip) | x.rlike(r"https?://.*https?://") | x.rlike(r"(?U)^https?://\S+$") | (count_of(low, rules.menu) >= 2)
    return (x != "") & (F.length(low) > 1) & ~furniture & ~(on_page & low.isin(*rules.home))


def clean_markdown(content: Column, url: Column, rules: LineRules | None = None) -> Column:
    """Main lines of a crawled markdown page.

    The region starts at the first heading or known title and ends before the first footer line.
    Furniture goes; of blank lines one stays between lines, and none at the ends.
    """
    r = rules or LineRules()
    lines = folded(F.transform(F.split(F.coalesce(content, F.lit("")), r"\R|[\x1c-\x1e]", -1), strip))
    on_page = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))).contains("contents.do")

    def region(every: Column) -> Column:
        start = first_index(every, lambda s: s["x"].contains("## ") | s["low"].startswith("## ") | s["low"].isin(*r.start))
        return F.slice(every, F.coalesce(start, F.lit(0)) + 1, F.size(every))

    def flat(part: Column) -> Column:
        end = first_index(part, lambda s: s["low"].rlike(f"^(?:{any_of(r.end)})"))
        return folded(F.transform(F.slice(part, F.lit(1), F.coalesce(end, F.size(part))), lambda s: strip_markdown(s["x"])))

    def marked(part: Column, page: Column) -> Column:
        return F.transform(part, lambda s: F.struct(s["x"].alias("x"), kept_line(s, page, r).alias("keep")))

    def collapse(items: Column) -> Column:
        def join(first: Column) -> Column:
            blank = lambda s, i: (s["x"] == "") & (i > first) & (F.get(items, i - 1)["x"] != "")
            return F.array_join(F.transform(F.filter(items, lambda s, i: s["keep"] | blank(s, i)), lambda s: s["x"]), "\n")

        return let(F.coalesce(first_index(items, lambda s: s["keep"]), F.size(items)), join)

    shown = let(on_page, lambda page: let(let(let(lines, region), flat), lambda part: let(marked(part, page), collapse)))
    return strip(shown)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, as the only element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(c: Column) -> Column:
    """Folded runs of digits, ASCII letters and Hangul, of two characters or more."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("([0-9A-Za-z가-힣]+)"), 1), fold), lambda t: F.length(t) >= 2)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_id(prefix: str, source: Column) -> Column:
    """Key of a crawled page ("crawl") or an attachment ("doc")."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(source), 1, 12))


def member_id(source: Column, member: Column) -> Column:
    return short_id("doc", F.concat(source, F.lit("#"), member))
