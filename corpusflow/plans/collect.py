"""Crawl and parse in one plan: which pages become documents, and which attachments are worth fetching.

What the parser says of a page decides about its attachments: those of a page that was to be collected
and was rejected are dropped, unless another page links them. Links to further pages are followed
all the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, short_id, squash
from ..functions.urls import is_board_detail
from ..operators.crawl import crawl
from ..operators.parsing import parse
from ..sources.shared import pin, to_all

#: Filters that a source may have, and what they look at.
FILTERS = {
    "allowed_keyword_filters": ("title", "department", "author_department"), "blocked_keyword_filters": ("title", "department", "author_department"),
    "allowed_author_department_filters": ("author_department",), "blocked_author_department_filters": ("author_department",),
}


@dataclass(frozen=True)
class Collected:
    """visited: every page of the crawl with its verdict; documents: accepted pages; attachments: what to fetch, with its parent's title."""

    visited: DataFrame
    documents: DataFrame
    attachments: DataFrame


def passes_filters(given: dict[str, Column]) -> Column:
    """Whether a page's words pass the filters of its source; an empty or missing list filters nothing."""
    ok = F.lit(True)
    for name, columns in FILTERS.items():
        words = F.filter(F.transform(given[name], fold), lambda w: w != "")
        text = fold(F.concat_ws(" ", *[squash(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
        found = F.exists(words, lambda w: text.contains(w))  # noqa: B023 - used at once
        ok = ok & (F.coalesce(~found, F.lit(True)) if name.startswith("blocked") else F.coalesce(found | (F.size(words) <= 0), F.lit(True)))
    return ok


def collect(pages: DataFrame, sources: DataFrame, rules: DataFrame, collected_at: Column | None = None) -> Collected:
    """`pages` has url, links and markdown and, if known, metadata; `sources` is that of `crawl`, with category, department, filters and cutoff.

    A page's verdict is passed (not to be collected, or not fetched), accepted or rejected: by its parser, by
    the source's filters, or by the cutoff, which drops what is older and undated board details. An attachment has the
    title of the first accepted page, in order of the crawl, that names it.
    """
    for name in (*FILTERS, "cutoff", "category", "department"):
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(None).cast({"cutoff": "date", "category": "string", "department": "string"}.get(name, "array<string>")))
    settings = F.broadcast(sources.select("name", "category", "department", F.col("cutoff").alias("_cutoff"), *FILTERS))
    visited = pin(crawl(pages, sources))
    if "metadata" not in pages.columns:
        pages = pages.withColumn("metadata", F.create_map().cast("map<string,string>"))
    asked = visited.where("collect").select("name", "url", "ordinal", "page_url")
    wanted = to_all(asked.select(F.col("page_url").alias("url")).distinct(), visited.count())
    page = pages.join(wanted, "url", "left_semi").select(F.col("url").alias("page_url"), "markdown", "metadata", "links")
    page = page.groupBy("page_url").agg(F.min_by(F.struct("markdown", "metadata", "links"), F.coalesce("markdown", F.lit(""))).alias("p")).select("page_url", "p.*")
    asked = asked.join(page, "page_url").drop("page_url").join(settings, "name")
    parsed = parse(asked, rules).where(passes_filters({c: F.col(c) for c in FILTERS}))
    old = F.coalesce(F.col("published_at") < F.col("_cutoff"), is_board_detail(F.col("url")))
    accepted = pin(
        parsed.where(F.col("_cutoff").isNull() | ~old).select(
            "name", "ordinal", short_id("crawl", F.col("url")).alias("doc_id"), F.lit("html").alias("source_type"), F.col("url").alias("source_url"), "title", "content", "category",
            "department", "author_department", "published_at", "attachment_urls", (collected_at if collected_at is not None else F.lit(None)).cast("timestamp_ntz").alias("collected_at"),
        )
    )
    marked = visited.join(accepted.select("name", F.col("source_url").alias("url"), F.lit(True).alias("_ok")), ["name", "url"], "left")
    verdict = F.when(~F.col("collect"), "passed").when(F.col("_ok"), "accepted").otherwise("rejected")
    marked = marked.withColumn("verdict", verdict).drop("_ok")
    linked = marked.where("verdict <> 'rejected'").select("name", F.explode("documents").alias("url")).distinct()
    named = accepted.select("name", "ordinal", "title", F.explode("attachment_urls").alias("url"))
    first = named.groupBy("name", "url").agg(F.min_by("title", "ordinal").alias("parent_title"))
    return Collected(marked, accepted.drop("ordinal"), linked.join(first, ["name", "url"], "left"))
