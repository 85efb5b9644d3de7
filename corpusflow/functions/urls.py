"""URL canonicalisation and crawl predicates, as expressions on string columns.

urlparse's parts are cut by one regular expression, so odd URLs never fail. Query values are
compared and sorted as they are written; percent-encoding is not normalised.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, let

# Extensions of documents and their types, and board endpoints.
DOCUMENT_EXTENSIONS = {
    ".pdf": "pdf", ".docx": "docx", ".hwp": "hwp", ".hwpx": "hwpx", ".zip": "zip", ".png": "image", ".jpg": "image",
    ".jpeg": "image", ".tif": "image", ".tiff": "image", ".bmp": "image", ".gif": "image", ".webp": "image",
}
DOWNLOAD, BOARD_LIST, BOARD_DETAIL, CONTENTS = "downloadbbsfile.do", "selectbbsnttlist.do", "selectbbsnttview.do", "contents.do"
# Query keys that identify a board page.
DETAIL_KEYS = ("bbsno", "key", "nttno", "selfat")
LIST_KEYS = ("bbsno", "key", "pageindex", "selfat", "sf.dc", "sf.dcof", "sf.of1", "sf.of2")
# What a link must contain, and must not, unless a source says otherwise.
INCLUDE_PATTERNS = (
    "notice", "bbs", "board", "academic", "scholarship", "faq", "download", "dn.php", "contents.do", ".pdf", ".docx", ".hwp", ".hwpx", ".zip",
)
EXCLUDE_PATTERNS = ("login", "logout", "signup", "search.do", "javascript:", "mailto:")

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, name: str) -> Column:
    """scheme, host (authority), path (with parameters), query or fragment; empty if absent."""
    group = ("scheme", "host", "path", "query", "fragment").index(name) + 1
    return F.regexp_extract(url, PARTS, group)


def domain(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"^www\.", "")


def _pairs(query: Column) -> Column:
    """Key and value of each item; items without a key are dropped, as are blank ones."""
    items = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(
        items,
        lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit("")).alias("v")),
    )


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def canonical_query(path: Column, query: Column) -> Column:
    """Sorted items; board pages keep their identifying keys only, the first of each."""
    low = F.lower(path)
    texts = lambda xs: F.array(*[F.lit(x) for x in xs])
    is_board = low.contains(BOARD_DETAIL) | low.contains(BOARD_LIST)
    keys = F.when(low.contains(BOARD_DETAIL), texts(DETAIL_KEYS)).otherwise(texts(LIST_KEYS))
    named = F.transform(_pairs(query), lambda p, i: F.struct(F.lower(p["k"]).alias("low"), i.alias("i"), p["k"].alias("k"), p["v"].alias("v")))

    def board(items: Column) -> Column:
        return F.filter(items, lambda p, i: F.array_contains(keys, p["low"]) & ((i == 0) | ~F.get(items, i - 1)["low"].eqNullSafe(p["low"])))

    return F.when(is_board, _joined(let(F.array_sort(named), board))).otherwise(_joined(F.array_sort(_pairs(query))))


def normalize_url(url: Column) -> Column:
    """Without fragment, session parameter and trailing slashes, with a canonical query."""

    def rebuilt(u: Column, p: Column, canon: Column) -> Column:
        joined = F.concat(
            F.when(p["scheme"] != "", F.concat(F.lower(p["scheme"]), F.lit(":"))).otherwise(F.lit("")),
            F.when((p["host"] != "") | u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(F.lit("//"), p["host"])).otherwise(F.lit("")),
            p["path"],
            F.when(canon != "", F.concat(F.lit("?"), canon)).otherwise(F.lit("")),
        )
        return F.regexp_replace(joined, "/+$", "")

    def parts(u: Column) -> Column:
        path = F.regexp_replace(part(u, "path"), r"(?i);jsessionid=[^/?#;]+$", "")
        return F.struct(part(u, "scheme").alias("scheme"), part(u, "host").alias("host"), path.alias("path"), part(u, "query").alias("query"))

    canonical = lambda p: F.when(p["query"] == "", "").otherwise(canonical_query(p["path"], p["query"]))
    return let(url, lambda u: let(parts(u), lambda p: let(canonical(p), lambda canon: rebuilt(u, p, canon))))


def page_index(url: Column) -> Column:
    """The first all-digit pageIndex of the query, else 1."""
    found = F.filter(_pairs(part(url, "query")), lambda p: (F.lower(p["k"]) == "pageindex") & p["v"].rlike("^[0-9]+$"))
    return F.coalesce(F.try_element_at(F.transform(found, lambda p: p["v"].cast("int")), F.lit(1)), F.lit(1))


def with_param(url: Column, key: str, value: Column) -> Column:
    """The URL with this query parameter last, in place of any of its name."""
    others = F.filter(_pairs(part(url, "query")), lambda p: F.lower(p["k"]) != key.lower())
    base = F.regexp_replace(url, r"[?#].*$", "")
    item = F.concat(F.lit(f"{key}="), value.cast("string"))
    fragment = part(url, "fragment")
    tail = F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit(""))
    return F.concat(base, F.lit("?"), F.concat_ws("&", F.when(F.size(others) > 0, _joined(others)), item), tail)


def is_document(url: Column) -> Column:
    return F.lower(url).rlike(any_of((DOWNLOAD, *DOCUMENT_EXTENSIONS)))


def is_board_list(url: Column) -> Column:
    return F.lower(url).contains(BOARD_LIST)


def is_board_detail(url: Column) -> Column:
    return F.lower(url).contains(BOARD_DETAIL)


def crawl_priority(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains(BOARD_DETAIL), 0).when(low.contains(BOARD_LIST), 1).when(low.contains(CONTENTS), 2).otherwise(3)


def any_in(text: Column, patterns: Column) -> Column:
    """Whether any of an array of patterns occurs in the text."""
    return F.coalesce(F.exists(patterns, lambda p: text.contains(p)), F.lit(False))


def some(patterns: Column) -> Column:
    return F.coalesce(F.size(patterns) > 0, F.lit(False))


def is_allowed(url: Column, domains: Column, follow: Column, include: Column, exclude: Column, prefixes: Column) -> Column:
    """Whether a crawl may fetch a URL. Empty or null arrays allow everything."""
    low = F.lower(url)
    path = part(url, "path")
    below = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    patterns = F.when(some(follow), follow).otherwise(include)
    in_place = ~some(prefixes) | F.exists(prefixes, lambda p: below.startswith(p))
    return (
        F.lower(part(url, "scheme")).isin("http", "https")
        & (~some(domains) | F.array_contains(domains, domain(part(url, "host"))))
        & ~any_in(low, exclude)
        & (is_document(url) | (in_place & (~some(patterns) | any_in(low, patterns))))
    )


def is_collectable(url: Column, is_seed: Column, collect_seeds: Column, collect: Column, include: Column) -> Column:
    patterns = F.when(some(collect), collect).otherwise(include)
    return ~(is_seed & ~collect_seeds) & (~some(patterns) | any_in(F.lower(url), patterns))


def path_prefixes(seeds: Column) -> Column:
    """First path segments of some seed URLs, as /segment/, in order and once each."""

    def prefix(u: Column) -> Column:
        segment = F.regexp_extract(part(u, "path"), "^/*([^/]+)", 1)
        return F.when(segment == "", F.lit("/")).otherwise(F.concat(F.lit("/"), segment, F.lit("/")))

    return F.array_distinct(F.transform(seeds, prefix))


def file_name(url: Column) -> Column:
    return F.nullif(F.element_at(F.split(part(url, "path"), "/"), -1), F.lit(""))


def file_type(url: Column) -> Column:
    name = file_name(url)
    return F.when(name.contains("."), F.nullif(F.lower(F.element_at(F.split(name, r"\."), -1)), F.lit("")))


def source_type(url: Column, content_type: Column | None = None) -> Column:
    """Type of an attachment by its name, then by content type, else html for URLs and file for paths."""
    low = F.lower(url)
    by_name = F.when(low.contains(".pdf"), "pdf").when(low.contains(".docx"), "docx")
    suffix = F.lower(F.regexp_extract(part(url, "path"), r"(\.[^./]+)$", 1))
    for ext, kind in {**DOCUMENT_EXTENSIONS, ".html": "html", ".htm": "html", ".md": "markdown"}.items():
        by_name = by_name.when(suffix == ext, kind)
    kind = F.lower(F.coalesce(content_type if content_type is not None else F.lit(""), F.lit("")))
    return (
        by_name.when(kind.contains("pdf"), "pdf").when(kind.contains("wordprocessingml"), "docx").when(kind.contains("hwpx"), "hwpx")
        .when(kind.contains("hwp"), "hwp").when(kind.contains("zip"), "zip").when(kind.startswith("image/"), "image").when(kind.contains("markdown"), "markdown")
        .when(kind.contains("html"), "html").when(low.rlike("^https?://"), "html").otherwise("file")
    )


def resolve(base: Column, href: Column) -> Column:
    """A link seen from its page: absolute, protocol-relative, rooted, query-only or relative."""
    return F.get(resolve_all(base, F.array(href)), F.lit(0))


def resolve_all(base: Column, hrefs: Column) -> Column:
    """All links of a page as `resolve` has them; the page's own URL is taken apart once."""

    def dots(path: Column) -> Column:
        """Path segments . and .. worked off."""

        def work(parts: Column) -> Column:
            done = F.aggregate(
                parts,
                F.array().cast("array<string>"),
                lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x)),
            )
            tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
            return F.concat(F.array_join(done, "/"), tail)

        return let(F.split(path, "/", -1), work)

    def seen_from(b: Column, href: Column) -> Column:
        own = F.regexp_extract(href, r"^([^?#]*)", 1)
        rest = F.regexp_replace(href, r"^[^?#]*", "")
        root = F.concat(b["scheme"], F.lit("://"), b["host"])
        folder = F.regexp_replace(b["path"], "[^/]*$", "")
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        rooted = F.when(href.startswith("/"), own).otherwise(F.concat(folder, own))
        return (
            F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href))
            .when(href.startswith("?"), F.concat(root, b["path"], href))
            .when((href == "") | href.startswith("#"), F.concat(b["page"], href))
            .otherwise(F.concat(root, dots(rooted), rest))
        )

    parts = F.struct(*[part(base, name).alias(name) for name in ("scheme", "host", "path")], F.regexp_replace(base, "#.*$", "").alias("page"))
    return let(parts, lambda b: F.transform(hrefs, lambda href: seen_from(b, href)))
