"""Crawling as level-synchronous breadth-first search over a table of fetched pages.

`pages` (url, links, ...) stands for the network: a fetch is a join. Each level is a few joins:
frontier with pages, links exploded, filtered, anti-joined with what was seen. URLs of a small level go
to all tasks, so pages that it does not visit are passed over where they lie. The visited set is
checkpointed per level, so plans stay short and lost executors cost one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import (
    crawl_priority, is_allowed, is_board_detail, is_board_list, is_collectable, is_document, normalize_url, page_index, resolve_all, with_param,
)
from ..sources.shared import pin, to_all

LAST_PAGE = r"페이지\s*:\s*_?[0-9]+_?\s*/\s*_?([0-9]+)_?"
OPTIONAL = ("allowed_domains", "follow_patterns", "include_patterns", "exclude_patterns", "allowed_path_prefixes", "collect_patterns")


def links_of(base: Column, hrefs: Column) -> Column:
    """Resolved, normalised links of a page, once each."""
    return F.array_distinct(F.transform(resolve_all(base, F.filter(hrefs, lambda h: F.coalesce(h, F.lit("")) != "")), normalize_url))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']"), 1)


def last_page(markdown: Column, hrefs: Column) -> Column:
    """Number of a board's pages: as the text says, else the largest pageIndex of its links, else null."""
    said = F.regexp_extract(markdown, LAST_PAGE, 1).try_cast("int")
    linked = F.array_max(F.transform(F.filter(hrefs, lambda h: F.lower(h).rlike("[?&]pageindex=[0-9]+")), page_index))
    return F.coalesce(said, linked)


def pagination(url: Column, last: Column, most: Column, newest: Column, cutoff: Column) -> Column:
    """URLs of further pages of a board list: all, or only the next one if old pages are cut off."""
    end = F.when(most > 0, F.least(last, most)).otherwise(last)
    current = page_index(url)
    none = F.array().cast("array<string>")
    every = F.transform(F.sequence(F.lit(1), F.greatest(end, F.lit(1))), lambda i: normalize_url(with_param(url, "pageIndex", i)))
    following = F.when(current < end, F.array(normalize_url(with_param(url, "pageIndex", current + 1)))).otherwise(none)
    fresh = cutoff.isNull() | newest.isNull() | (newest >= cutoff)
    return F.when(~is_board_list(url) | F.coalesce(last <= 1, F.lit(True)) | ~fresh, none).when(cutoff.isNull(), every).otherwise(following)


def follow(url: Column, hrefs: Column, dates: Column, cutoff: Column) -> Column:
    """Whether a page's links are followed: a board list only if it links to details that are not all old."""
    details = F.exists(hrefs, is_board_detail)
    recent = (F.size(dates) == 0) | (F.array_max(dates) >= cutoff)
    return ~is_board_list(url) | cutoff.isNull() | (details & recent)


def crawl(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per visited page: name, url, depth, ordinal, fetched, collect, documents, page_url (its url as `pages` has it).

    `sources` has name, seed_urls, max_pages, max_depth, collect_seed_pages and the pattern arrays
    of OPTIONAL (null allows all). Within a level pages come in order of the parent's ordinal,
    priority and URL, so the page limit (0: none) cuts a total order. A page that is not in `pages`
    counts as visited. `documents` are its links to attachments.

    With a date `cutoff` in `sources`, and `dates` (array<date>) and `last_page` in `pages`, boards
    stop paging where all dates are old: a board list without recent dates is not followed, other
    lists are reached through its next page only.
    """
    if "cutoff" not in sources.columns:
        sources = sources.withColumn("cutoff", F.lit(None).cast("date"))
    if "max_pagination_pages" not in sources.columns:
        sources = sources.withColumn("max_pagination_pages", F.lit(0))
    for c, kind in (("dates", "array<date>"), ("last_page", "int")):
        if c not in pages.columns:
            pages = pages.withColumn(c, F.lit(None).cast(kind))
    for c in OPTIONAL:
        if c not in sources.columns:
            sources = sources.withColumn(c, F.lit(None).cast("array<string>"))
    settings = F.broadcast(sources.drop("seed_urls"))
    strings, days = F.array().cast("array<string>"), F.array().cast("array<date>")
    page = F.struct(F.col("url").alias("page_url"), F.coalesce("links", strings).alias("links"), F.coalesce("dates", days).alias("dates"), "last_page")
    web = pin(pages.select(normalize_url(F.col("url")).alias("url"), page.alias("page")))
    # What is made of a page and its links, the same at every level.
    url, cutoff, newest = F.col("url"), F.col("cutoff"), F.array_max("dates")
    goes_on = follow(url, F.coalesce("hrefs", strings), F.coalesce("dates", days), cutoff)
    own = F.filter(F.coalesce("links", strings), lambda u: cutoff.isNull() | ~is_board_list(url) | ~is_board_list(u))
    more = F.when(goes_on, F.concat(own, F.coalesce(pagination(url, F.col("last_page"), F.col("max_pagination_pages"), newest, cutoff), strings)))
    linked = F.filter(
        F.array_distinct(F.coalesce(more, strings)),
        lambda u: is_allowed(u, F.col("allowed_domains"), F.col("follow_patterns"), F.col("include_patterns"), F.col("exclude_patterns"), F.col("allowed_path_prefixes")),
    )
    collect = is_collectable(url, F.col("depth") == 0, F.col("collect_seed_pages"), F.col("collect_patterns"), F.col("include_patterns"))
    fetched = F.col("page_url").isNotNull()
    found = (
        url, links_of(url, F.col("page.links")).alias("links"), F.col("page.links").alias("hrefs"), F.col("page.dates").alias("dates"),
        F.col("page.last_page").alias("last_page"), F.col("page.page_url").alias("page_url"),
    )
    kept = ("name", "url", "depth", "ordinal", fetched.alias("fetched"), (collect & fetched).alias("collect"), linked.alias("_links"), "max_depth", "page_url")
    place = F.struct("ordinal", crawl_priority(url).alias("p"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("order", F.lower("url"), "url"))
    seeds = sources.select("name", F.posexplode("seed_urls").alias("_pos", "_seed")).select("name", normalize_url(F.col("_seed")).alias("url"), F.col("_pos").cast("long").alias("order"))
    frontier = pin(seeds.groupBy("name", "url").agg(F.min("order").alias("order")))
    visited: DataFrame | None = None
    depth, n_visited = 0, 0
    while (n_frontier := frontier.count()) or visited is None:  # each level needs a max_depth beyond it
        level = frontier.withColumn("_nth", nth).join(settings, "name")
        if visited is not None:  # one row per source
            level = level.join(F.broadcast(visited.groupBy("name").agg(F.count(F.lit(1)).alias("_before"))), "name", "left")
        before = F.coalesce("_before", F.lit(0)) if visited is not None else F.lit(0)
        level = level.withColumns({"ordinal": (before + F.col("_nth")).cast("long"), "depth": F.lit(depth)})
        level = level.where(((F.col("max_pages") <= 0) | (F.col("ordinal") <= F.col("max_pages"))) & (F.col("depth") <= F.col("max_depth")))
        # Only pages of this level are grouped and have their links resolved.
        asked = web.join(to_all(level.select("url").distinct(), n_frontier), "url", "left_semi").groupBy("url").agg(F.min("page").alias("page"))
        done = pin(level.join(asked.select(*found), "url", "left").select(*kept))
        visited = done if visited is None else visited.unionByName(done)
        n_visited += n_frontier
        nexts = done.where(F.col("depth") < F.col("max_depth")).select("name", "ordinal", F.explode("_links").alias("url")).where(~is_document(url))
        nexts = nexts.groupBy("name", "url").agg(F.min(place).alias("at")).join(to_all(visited.select("name", "url"), n_visited), ["name", "url"], "left_anti")
        frontier = pin(nexts.select("name", "url", (F.col("at.ordinal") * 4 + F.col("at.p")).alias("order")))
        depth += 1
    return visited.select("name", "url", "depth", "ordinal", "fetched", "collect", F.filter("_links", is_document).alias("documents"), "page_url")


def attachment_titles(attachments: DataFrame, documents: DataFrame) -> DataFrame:
    """Attachments take the title of the first document (by seq) that links them, if it has one."""
    linked = documents.select("seq", "title", F.explode("attachment_urls").alias("url"))
    first = linked.groupBy("url").agg(F.min_by("title", "seq").alias("_parent"))
    base = F.substring_index("source_url", "#", 1)
    joined = attachments.withColumn("_base", base).join(first, F.col("_base") == F.col("url"), "left")
    return joined.withColumn("title", F.coalesce(F.nullif("_parent", F.lit("")), "title")).select(*attachments.columns)
