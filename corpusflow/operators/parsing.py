"""Parsing of crawled markdown: rules choose a parser per page, parsers are expression bundles.

`pages` has url, category, department, markdown, metadata (map<string,string>) and links
(array<string>). A page is cleaned once; every parser's title is then a column, and the chosen one
decides. A page that its parser rejects is dropped, there is no second choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import published_at
from ..functions.text import clean_markdown, contains_any, first_index, fold, squash, strip
from ..functions.urls import is_board_list, is_document, resolve_all

RULE = "name string, priority int, url_patterns array<string>, categories array<string>, parser string, blocked_prefixes array<string>"
# What is no title, and labels that are no author.
SKIP_TITLES = ("二쇰찓", "닫기", "language", "login", "로그", "검색")
GENERIC_TITLES = ("공지사항 -", "자료실 -", "faq -")
NAVIGATION_TITLES = ("입시홈페이지", "통합검색", "로그인", "language", "주메뉴 열기")
METADATA_TITLES = ("_작성자", "_작성일")
LABEL_WORDS = ("작성자", "등록일", "작성일", "부서", "담당부서")
AUTHOR_KEYS = ("author", "department", "writer", "article:author")
AUTHOR_LABELS = ("작성자", "부서", "담당부서")
# Lines of a FAQ board that are no answer, by beginning and by content.
FAQ_STARTS = ("![", "[", "*", "1.", "2.", "3.")
FAQ_TOKENS = ("faq", "질문 답변 검색", "question answer search", "본문 바로가기", "열린광장", "페이스북", "트위터", "네이버블로그", "카카오톡")
PARSERS = ("faq", "notice_detail", "generic_markdown", "schedule")


def route(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule, parser and blocked_prefixes of the first rule that matches, by priority and name.

    Rules are few and go to every task; a page's match is a max_by over its own rules.
    """
    url, category = F.lower("url"), F.lower(F.coalesce("category", F.lit("")))
    listed = rules.orderBy("priority", "name").agg(F.collect_list(F.struct("priority", "name", "url_patterns", "categories", "parser", "blocked_prefixes")).alias("_rules"))
    joined = pages.join(F.broadcast(listed))

    def fits(r: Column) -> Column:
        any_url = (F.coalesce(F.size(r["url_patterns"]), F.lit(0)) <= 0) | F.exists(r["url_patterns"], lambda p: url.contains(p))
        any_category = (F.coalesce(F.size(r["categories"]), F.lit(0)) <= 0) | F.array_contains(r["categories"], category)
        return any_url & any_category

    first = F.array_min(F.filter("_rules", fits))
    return joined.withColumn("_r", first).select(
        *pages.columns, F.col("_r.name").alias("rule"), F.coalesce("_r.parser", F.lit("generic_markdown")).alias("parser"),
        F.coalesce("_r.blocked_prefixes", F.array().cast("array<string>")).alias("blocked_prefixes"),
    )


def plain_title(line: Column) -> Column:
    """A line without heading marks and link targets."""
    out = F.regexp_replace(squash(line), r"(?U)^#+\s*", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(out, r"\]\(https?://[^)]+\)", ""))


def is_navigation(title: Column) -> Column:
    bare = F.regexp_replace(plain_title(title), r"^[*_ ]+|[*_ ]+$", "")
    return fold(bare).isin(*NAVIGATION_TITLES) | bare.startswith("주메뉴 열기") | contains_any(F.lower(title), SKIP_TITLES)


def _meta(key: str) -> Column:
    return F.try_element_at("metadata", F.lit(key))


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | c.startswith(p)
    return found


def title_items(lines: Column) -> Column:
    """Lines with what titles are judged by: array<struct<x, plain, nav, meta>>."""
    pairs = F.transform(lines, lambda x: F.struct(x.alias("x"), plain_title(x).alias("plain")))
    return F.transform(
        pairs,
        lambda s: F.struct(s["x"].alias("x"), s["plain"].alias("plain"), is_navigation(s["plain"]).alias("nav"), _starts(s["plain"], METADATA_TITLES).alias("meta")),
    )


def notice_title(items: Column, blocked: Column) -> Column:
    """Metadata, a tagged line, the line after the print link, the first line; else any line that is no label."""
    listed = F.array(*[squash(_meta(k)) for k in ("title", "og:title")])
    fit = lambda v: v.isNotNull() & (v != "") & ~is_navigation(v) & ~contains_any(fold(v), GENERIC_TITLES)
    meta = F.get(F.filter(listed, fit), F.lit(0))
    tagged = F.regexp_extract(_first(items, lambda s: s["x"].rlike(r"(?U)^\[.*?\]\s+.+$"))["x"], r"(?U)^\[.*?\]\s+(.+)$", 1)
    tagged = F.regexp_replace(squash(tagged), r"(?U)\s+이미지\s+[0-9]+$", "")
    tagged = F.get(F.filter(F.array(tagged), lambda t: (t != "") & ~is_navigation(t)), F.lit(0))
    printed = first_index(items, lambda s: s["x"].isin("* 인쇄", "인쇄"))
    after = F.slice(items, printed + 2, F.size(items))
    line = lambda s: (s["plain"] != "") & ~s["x"].startswith("*") & ~s["x"].startswith("[") & ~s["nav"] & ~s["meta"]
    after_print = F.when(printed.isNotNull(), _first(after, line)["plain"])
    first = _first(items, lambda s: ~_starts(s["x"], METADATA_TITLES) & ~s["x"].rlike(r"^!\[.*\]\(") & (s["x"] != "") & ~s["nav"])["x"]
    first = squash(F.regexp_replace(first, r"(?U)^#+\s*", ""))
    is_blocked = lambda t: F.exists(blocked, lambda p: t.startswith(p))
    no_title = lambda t: (t == "") | (t == "본문 바로가기") | _starts(t, METADATA_TITLES) | is_blocked(t)
    found = F.filter(F.array(plain_title(F.coalesce(meta, tagged, after_print, first))), lambda t: t.isNotNull() & ~no_title(t))
    other = lambda s: ~s["x"].startswith("![") & ~s["x"].startswith("[") & ~no_title(s["plain"]) & ~s["nav"]
    return F.substring(F.coalesce(F.get(found, F.lit(0)), _first(items, other)["plain"]), 1, 300)


def author(content: Column) -> Column:
    """Metadata, else the rest of a line after a label; labels themselves are no author."""

    def usable(value: Column) -> Column:
        value = squash(value)
        return F.when((value != "") & ~contains_any(F.lower(value), LABEL_WORDS), F.substring(value, 1, 200))

    labelled = [F.regexp_extract(content, rf"_?{label}_?\s*[:：]?\s*([^\n]+)", 1) for label in AUTHOR_LABELS]
    found = F.transform(F.array(*[_meta(k) for k in AUTHOR_KEYS], *labelled), usable)
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def faq_lines(lines: Column) -> Column:
    """Lines after the FAQ heading without boilerplate; without any, all such lines."""
    keep = lambda x: (x != "") & ~_starts(x, FAQ_STARTS) & ~contains_any(fold(squash(x)), FAQ_TOKENS)
    heading = first_index(lines, lambda x: fold(squash(x)).isin("faq", "## faq"))
    inside = F.filter(F.slice(lines, heading + 2, F.size(lines)), keep)
    return F.when(F.coalesce(F.size(inside), F.lit(0)) > 0, inside).otherwise(F.filter(lines, keep))


def empty_faq(text: Column) -> Column:
    """Whether a page, its white space squashed, says that it lists nothing."""
    none = text.contains("총게시물") & text.contains("_0_") & text.contains("검색결과가 없습니다")
    return none | text.rlike("총게시물 ?: 0")


def _once(rows: DataFrame, **values: Column) -> DataFrame:
    """Adds columns as output of a generator, which the optimiser does not copy into each of their uses."""
    one = F.array(F.struct(*[value.alias(name) for name, value in values.items()]))
    return rows.select("*", F.inline(one))


def parse(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page that its parser accepts: the page's columns, rule, parser, title, content, published_at, author_department, attachment_urls."""
    routed = _once(route(pages, rules), _content=clean_markdown(F.col("markdown"), F.col("url"))).where("_content <> ''")
    routed = _once(routed, _lines=F.transform(F.split("_content", "\n"), strip))
    routed = _once(routed, _items=title_items(F.col("_lines")), _faq=faq_lines(F.col("_lines")), _squashed=squash(F.col("_content")))
    plain = lambda x: (x != "") & ~x.startswith("![") & ~x.startswith("[")
    first_line = F.trim(F.regexp_replace(_first(F.col("_lines"), plain), r"(?U)^#+\s*", ""))
    meta = F.coalesce(F.nullif(squash(_meta("title")), F.lit("")), F.nullif(squash(_meta("og:title")), F.lit("")))
    faq = F.col("_faq")
    kind = F.col("parser")
    notice = kind == "notice_detail"
    is_faq_category = F.coalesce(F.col("category") == "faq", F.lit(False))
    no_count = F.col("_squashed").rlike("총게시물 ?: 0")
    rejected = (
        F.when(kind == "faq", empty_faq(F.col("_squashed")) | (F.size(faq) == 0))
        .when(notice, is_faq_category & (no_count | is_board_list(F.col("url"))))
        .otherwise(F.lit(False))
    )
    title = (
        F.when(kind == "faq", F.coalesce(meta, F.get(faq, F.lit(0))))
        .when(notice, notice_title(F.col("_items"), F.col("blocked_prefixes")))
        .when(kind == "schedule", F.coalesce(meta, first_line))
        .otherwise(first_line)
    )
    links = F.array_distinct(F.filter(resolve_all(F.col("url"), F.coalesce("links", F.array().cast("array<string>"))), is_document))
    parsed = routed.where(~rejected).select(
        *pages.columns, "rule", "parser", F.substring(title, 1, 300).alias("title"),
        F.when(kind == "faq", F.array_join(faq, "\n")).otherwise(F.col("_content")).alias("content"),
        F.when(notice, published_at(F.col("_content"), F.col("metadata"))).alias("published_at"),
        F.when(notice, author(F.col("_content"))).alias("author_department"),
        F.when(notice, links).otherwise(F.array().cast("array<string>")).alias("attachment_urls"),
    )
    return parsed.where(F.coalesce("title", F.lit("")) != "")


def keyword_filter(docs: DataFrame, allow: list[str] | None = None, block: list[str] | None = None) -> DataFrame:
    """Keeps documents whose title, department or author holds an allowed word, then drops blocked ones."""
    text = fold(F.concat_ws(" ", *[squash(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "department", "author_department")]))
    words = lambda xs: tuple(x.lower().replace("ß", "ss") for x in xs or () if x)
    if words(allow):
        docs = docs.where(contains_any(text, words(allow)))
    return docs.where(~contains_any(text, words(block))) if words(block) else docs


def author_filter(docs: DataFrame, allow: list[str] | None = None, block: list[str] | None = None) -> DataFrame:
    """The same by author alone; a document without one is never allowed and never blocked."""
    text = F.coalesce(fold(squash(F.col("author_department"))), F.lit(""))
    words = lambda xs: tuple(x.lower().replace("ß", "ss") for x in xs or () if x)
    if words(allow):
        docs = docs.where(contains_any(text, words(allow)))
    return docs.where(~contains_any(text, words(block))) if words(block) else docs


def date_filter(docs: DataFrame, cutoff: Column) -> DataFrame:
    """Drops what is older than the cutoff, and undated board details; other undated pages stay."""
    old = F.coalesce(F.col("published_at") < cutoff, F.lower("url").contains("selectbbsnttview.do"))
    return docs.where(cutoff.isNull() | ~old)
