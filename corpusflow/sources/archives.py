"""Attachments: types from bytes and headers, archive members, text of word-processor files.

Binaries come from spark.read.format("binaryFile"). Types and header names are expressions; reading
inside a file needs Python, per file, and a broken file gives an error instead of failing the job.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hwp import clean_lines
from ..functions.text import member_id, short_id

# Suffixes that are read from archives, largest member, first bytes of file types.
MEMBER_SUFFIXES = (".pdf", ".docx", ".html", ".htm", ".md", ".markdown", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp", ".hwp", ".hwpx", ".zip")
MEMBER_BYTES = 25 * 1024 * 1024
SIGNATURES = (("255044462D", ".pdf"), ("25504446", ".pdf"), ("504B0304", ".zip"), ("D0CF11E0A1B11AE1", ".hwp"))
SECTIONS = ("section", "contents", "body")


def suffix_of_bytes(content: Column) -> Column:
    """Suffix by first bytes; empty if unknown."""
    out = None
    for magic, suffix in SIGNATURES:
        test = F.startswith(content, F.unhex(F.lit(magic)))
        out = F.when(test, suffix) if out is None else out.when(test, suffix)
    head = F.substring(content, 1, 512).try_cast("string")
    return out.when(head.rlike(r"^\s*(<!doctype html|<html)"), ".html").otherwise("")


def suffix_of_content_type(content_type: Column) -> Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(low.contains("pdf"), ".pdf").when(low.contains("wordprocessingml.document") | low.contains("msword"), ".docx")
        .when(low.contains("zip"), ".zip").otherwise("")
    )


@F.pandas_udf(T.StringType())
def _unquoted(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unquote(v))


def header_file_name(disposition: Column) -> Column:
    """File name of a Content-Disposition header: filename*=UTF-8'' first; + stays +."""
    encoded = F.nullif(F.regexp_extract(disposition, r"(?i)filename\*=UTF-8''([^;]+)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(disposition, r'(?i)filename="?([^";]+)"?', 1), F.lit(""))
    return _unquoted(F.trim(F.coalesce(F.regexp_replace(F.trim(encoded), r'^"+|"+$', ""), plain)))


def members_of(content: bytes, most_bytes: int = MEMBER_BYTES, around: tuple[bytes, ...] = ()) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of usable members; members of inner archives, at any depth, come as outer#inner.

    An archive that holds itself is handed on as a file.
    """
    around = (*around, hashlib.sha256(content).digest())
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            suffix = re.search(r"\.[^./]+$", info.filename.lower())
            if info.is_dir() or not suffix or suffix[0] not in MEMBER_SUFFIXES or info.file_size > most_bytes:
                continue
            data = archive.read(info)
            if suffix[0] == ".zip" and hashlib.sha256(data).digest() not in around:
                for name, inner in members_of(data, most_bytes, around):
                    yield f"{info.filename}#{name}", inner
            else:
                yield info.filename, data


def _archive_rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for source, content in zip(pdf["source"], pdf["content"], strict=True):
            try:
                rows = [(source, name, data, None) for name, data in members_of(bytes(content))]
            except (zipfile.BadZipFile, RuntimeError, zlib.error, OSError) as e:
                rows = [(source, None, None, f"{type(e).__name__}: {e}")]
            if rows:
                yield pd.DataFrame(rows, columns=["source", "member", "content", "error"])


def archive_members(archives: DataFrame) -> DataFrame:
    """`archives` has source and content (bytes): one row per member, with doc_id and source_url source#member.

    A broken archive is one row with an error.
    """
    rows = archives.select("source", "content").mapInPandas(_archive_rows, "source string, member string, content binary, error string")
    own = F.when(F.col("member").isNull(), short_id("doc", F.col("source"))).otherwise(member_id(F.col("source"), F.col("member")))
    return rows.withColumn("doc_id", own).withColumn("source_url", F.concat_ws("#", "source", "member"))


def hwpx_text(content: bytes) -> str:
    """Texts of all elements of the section files, in order of file name; broken XML is skipped."""
    lines = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in sorted(archive.namelist()):
            low = name.lower()
            if low.endswith(".xml") and any(s in low for s in SECTIONS):
                try:
                    root = ElementTree.fromstring(archive.read(name))
                except ElementTree.ParseError:
                    continue
                lines += [t for e in root.iter() if (t := (e.text or "").strip())]
    return "\n".join(lines)


def hwp_text(content: bytes) -> str:
    """Text of the body streams of an OLE file, its lines as they are; needs olefile."""
    import olefile

    parts = []
    with olefile.OleFileIO(io.BytesIO(content)) as ole:
        header = ole.openstream("FileHeader").read() if ole.exists("FileHeader") else b""
        packed = len(header) > 36 and header[36] & 1
        for path in sorted(ole.listdir(streams=True)):
            if len(path) > 1 and path[0] == "BodyText":
                data = ole.openstream(path).read()
                text = (zlib.decompress(data, -15) if packed else data).decode("utf-16le", errors="ignore")
                parts.append(text)
    return "\n".join(p for p in parts if p)


def extract_text(files: DataFrame, kind: str, tiers: list[Callable[[bytes], str]] | None = None) -> DataFrame:
    """Adds text and error to `files` (source, content). The first tier that gives text wins.

    Tiers default to the reader of `kind` (hwpx, hwp, html, markdown); others, as for pdf, are given
    by the caller, cheapest first. Lines of hwp texts are cleaned.
    """
    readers = {"hwpx": hwpx_text, "hwp": hwp_text, "html": lambda b: b.decode("utf-8", "replace"), "markdown": lambda b: b.decode("utf-8", "replace")}
    chain = tiers or [readers[kind]]

    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, errors = [], []
            for content in pdf["content"]:
                text, error = "", None
                for tier in chain:
                    try:
                        text = tier(bytes(content)).strip()
                    except Exception as e:  # a file's own fault is a value, as converters raise anything
                        error = f"{type(e).__name__}: {e}"
                    if text:
                        break
                texts.append(text or None)
                errors.append(None if text else error)
            yield pd.DataFrame({"source": pdf["source"], "text": texts, "error": errors})

    read = files.select("source", "content").mapInPandas(rows, "source string, text string, error string")
    return read.withColumn("text", F.nullif(clean_lines(F.col("text")), F.lit(""))) if kind == "hwp" else read
