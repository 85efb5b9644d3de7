"""Overlapping windows of text, and which chunks get an embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_markdown, squash
from ..functions.urls import DOWNLOAD

SIZE, OVERLAP = 1000, 200
# Source types whose chunks count as attachments.
ATTACHMENT_TYPES = ("pdf", "docx", "hwp", "hwpx", "zip", "image")


def check_options(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and less than size")


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<string> of windows: the last one is the first that reaches the end of the text."""
    check_options(size, overlap)
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n), lambda k: F.trim(F.substring(text, k * step + 1, F.lit(size))))
    return F.when(F.length(text) > 0, F.filter(cut, lambda w: w != "")).otherwise(F.array().cast("array<string>"))


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, clean: bool = True) -> DataFrame:
    """One row per chunk: chunk_id, doc_id, chunk_index, text and the document's columns."""
    text = squash(clean_markdown(F.col("content"), F.col("source_url")) if clean else F.col("content"))
    exploded = docs.withColumn("_text", text).select(
        *[c for c in docs.columns if c != "content"], F.posexplode(windows(F.col("_text"), size, overlap)).alias("chunk_index", "text")
    )
    return exploded.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("-chunk-"), F.col("chunk_index")))


def is_attachment(source_type: Column, source_url: Column) -> Column:
    return F.coalesce(source_type.isin(*ATTACHMENT_TYPES), F.lit(False)) | F.coalesce(F.lower(source_url).contains(DOWNLOAD), F.lit(False))


def select_for_embedding(chunks: DataFrame, limit: int | None, attachment_limit: int | None, order: list[str]) -> DataFrame:
    """Per source the first `limit` chunks, then up to `attachment_limit` further attachment chunks.

    Both None selects all; limit None alone selects all, 0 selects none of the first kind.
    """
    if limit is None:
        return chunks
    marked = chunks.withColumn("_att", is_attachment(F.col("source_type"), F.col("source_url")))
    ranked = marked.withColumn("_n", F.row_number().over(Window.partitionBy("source_name").orderBy(*order)))
    main = F.col("_n") <= limit
    if not attachment_limit:
        return ranked.where(main).drop("_att", "_n")
    later = Window.partitionBy("source_name", F.col("_att") & ~main).orderBy(*order)
    return ranked.withColumn("_m", F.row_number().over(later)).where(main | (F.col("_att") & (F.col("_m") <= attachment_limit))).drop("_att", "_n", "_m")
