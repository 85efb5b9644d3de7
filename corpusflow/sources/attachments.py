"""Attachments end to end: files with their download headers to documents, with a status for every file.

A file's type comes from a cascade over its address, header name, content type and first bytes, as
expressions. Contents are read in one pass over the files, archives member by member, so bytes are never
shuffled. What cannot be read is a row with a status and a reason, beside the documents; the flags of
`Collection` say whether such rows are passed over or end the job.
"""

from __future__ import annotations

import html.parser
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hwp import clean_lines
from ..functions.text import member_id, short_id
from ..functions.titles import html_title, text_title
from ..functions.urls import part
from .archives import MEMBER_BYTES, header_file_name, hwp_text, hwpx_text, members_of, suffix_of_bytes, suffix_of_content_type

# Suffixes and the types that they stand for; addresses that serve files under any name.
TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown", ".hwp": "hwp", ".hwpx": "hwpx", ".zip": "zip",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image", ".bmp": "image", ".gif": "image", ".webp": "image",
}
KEPT_FOR_DOWNLOAD = (".hwp", ".hwpx", ".zip")
DOWNLOAD_ADDRESS = "downloadbbsfile.do"
#: What a reader hands on at once: small files share a frame, a large one has its own; what a row counts beside its text.
FRAME_BYTES, ROW_BYTES = 4 * 1024 * 1024, 256

Reader = Callable[[bytes], str]


class _Blocks(html.parser.HTMLParser):
    """Texts of blocks, one a line; heads, scripts and styles are no text."""

    SILENT, INLINE = {"script", "style", "head", "template"}, {"a", "b", "i", "em", "strong", "span", "u", "sub", "sup", "code", "small", "mark"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.open, self.silent = [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in self.SILENT
        if tag not in self.INLINE:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in self.SILENT))
        if tag not in self.INLINE:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.open.append(data)

    def end_line(self) -> None:
        line = " ".join("".join(self.open).split())
        if line:
            self.lines.append(line)
        self.open = []


def html_text(content: bytes) -> str:
    parser = _Blocks()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    parser.end_line()
    return "\n".join(parser.lines)


#: Readers by type, cheapest first; those of PDF, DOCX and images are the caller's.
READERS: dict[str, tuple[Reader, ...]] = {
    "hwpx": (hwpx_text,), "hwp": (hwp_text,), "html": (html_text,), "markdown": (lambda b: b.decode("utf-8", "replace"),)
}


@dataclass(frozen=True)
class Collection:
    """Settings: what a source's documents get, and which files are passed over."""

    category: str | None = None
    department: str | None = None
    skip_images: bool = False
    skip_unsupported: bool = False
    skip_failed: bool = True
    most_member_bytes: int = MEMBER_BYTES
    readers: dict[str, tuple[Reader, ...]] = field(default_factory=dict, repr=False)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """source and content of the files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.col("path").alias("source"), "content")


def file_suffix(source: Column, content: Column, content_type: Column, disposition: Column) -> Column:
    """Suffix of a file: of its own address; of a download by header name or address, content type, then first bytes."""
    suffix = lambda name: F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))
    address = F.regexp_extract(part(source, "path"), "([^/]*)$", 1)
    own = suffix(address)
    is_url = source.rlike("(?i)^https?://")
    named = suffix(F.coalesce(F.nullif(header_file_name(disposition), F.lit("")), address))
    by_type = suffix_of_content_type(content_type)
    direct = ~is_url | (own.isin(*[s for s in TYPES if s not in KEPT_FOR_DOWNLOAD]) & ~F.lower(source).contains(DOWNLOAD_ADDRESS))
    return (
        F.when(direct, own).when(named.isin(*TYPES), named).when(by_type.isin(*TYPES), by_type).otherwise(suffix_of_bytes(F.substring(content, 1, 64)))
    )


def file_type(suffix: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in TYPES.items() for x in item]), suffix), F.lit("file"))


def _read(options: Collection):
    readers = {**READERS, **options.readers}

    def text(kind: str, content: bytes) -> tuple[str, str | None, str | None]:
        """status, text and reason of one file."""
        if kind == "image" and options.skip_images:
            return "image", None, None
        if kind == "file" or kind not in readers:
            return "unsupported", None, f"no reader of {kind}"
        reason = None
        for reader in readers[kind]:
            try:
                found = reader(content).strip()
            except Exception as e:  # noqa: BLE001 - a file's own fault is a value, as readers raise anything
                found, reason = "", f"{type(e).__name__}: {e}"
            if found:
                return "ok", found, None
        return ("failed", None, reason) if reason else ("empty", None, None)

    def rows(kind: str, content: bytes) -> Iterator[tuple]:
        if kind != "zip":
            yield None, kind, *text(kind, content), content if kind == "html" else None
            return
        try:
            for name, data in members_of(content, options.most_member_bytes):
                suffix = re.search(r"\.[^./]+$", name.lower())
                inner = TYPES.get(suffix[0], "file") if suffix else "file"
                yield name, inner, *text(inner, data), data if inner == "html" else None
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, OSError) as e:
            yield None, kind, "failed", None, f"{type(e).__name__}: {e}", None

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "member", "source_type", "status", "content", "reason", "page"]
        found, held = [], 0
        for pdf in frames:
            for source, kind, content in zip(pdf["source"], pdf["source_type"], pdf["content"], strict=True):
                for r in rows(kind, bytes(content) if content is not None else b""):
                    found.append((source, *r))
                    held += ROW_BYTES + len(r[3] or "") + len(r[5] or b"")
                    if held >= FRAME_BYTES:
                        yield pd.DataFrame(found, columns=columns)
                        found, held = [], 0
        if found:
            yield pd.DataFrame(found, columns=columns)

    return read


def collect_attachments(files: DataFrame, options: Collection | None = None, collected_at: Column | None = None) -> DataFrame:
    """`files` has source and content and, of downloads, content_type and disposition. One row per file or member.

    Columns are those of documents, then status (ok, image, unsupported, empty, failed) and reason. An
    archive gives a row per usable member, at any depth, and none itself unless it is broken. Without
    skip_unsupported or skip_failed a file of that status ends the job. A null content is empty.
    """
    o = options or Collection()
    given = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")
    typed = files.select(
        "source", "content", file_type(file_suffix(F.col("source"), F.col("content"), given("content_type"), given("disposition"))).alias("source_type")
    )
    read = typed.mapInPandas(_read(o), "source string, member string, source_type string, status string, content string, reason string, page binary")
    lines = F.when(F.col("source_type") == "hwp", clean_lines(F.col("content"))).otherwise(F.col("content"))
    read = read.withColumn("content", F.nullif(lines, F.lit("")))
    read = read.withColumn("status", F.when((F.col("status") == "ok") & F.col("content").isNull(), "empty").otherwise(F.col("status")))
    for status, skip in (("unsupported", o.skip_unsupported), ("failed", o.skip_failed)):
        if not skip:
            told = F.concat_ws(" ", F.lit(status), F.col("source"), F.col("member"), F.col("reason"))
            read = read.withColumn("status", F.when(F.col("status") == status, F.raise_error(told)).otherwise(F.col("status")))
    url = F.concat_ws("#", "source", "member")
    named = F.when(F.col("source_type") == "html", html_title(F.decode("page", "utf-8")))
    title = F.coalesce(F.substring(named, 1, 300), text_title(F.col("content"), F.coalesce("member", "source")))
    return read.select(
        F.when(F.col("member").isNull(), short_id("doc", F.col("source"))).otherwise(member_id(F.col("source"), F.col("member"))).alias("doc_id"),
        "source_type", url.alias("source_url"), F.when(F.col("status") == "ok", title).alias("title"), "content",
        F.lit(o.category).cast("string").alias("category"), F.lit(o.department).cast("string").alias("department"), F.lit(o.department).cast("string").alias("author_department"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"), F.array().cast("array<string>").alias("attachment_urls"),
        (collected_at if collected_at is not None else F.lit(None)).cast("timestamp_ntz").alias("collected_at"), "status", "reason",
    )


def collected_documents(rows: DataFrame) -> DataFrame:
    """The documents among the rows of collect_attachments."""
    return rows.where("status = 'ok'").drop("status", "reason")
