"""The ingest job: parsed documents of all sources to survivors, chunks, vectors and a report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents, select_for_embedding
from ..operators.dedup import best_rows, dedup_metrics, named, version_names
from ..sources.services import Encoder, embed
from ..sources.shared import pin

COUNTS = ("raw_documents", "documents", "exact_duplicates_removed", "version_duplicates_removed", "chunks", "embedded_chunks", "stored_chunks")
# Why a source has its status.
REASONS = {
    "no_content_discovered": "No crawlable documents were discovered from the source.",
    "fully_deduplicated": "Documents were discovered but removed as duplicates or older versions.",
    "empty_board_or_filtered": "FAQ board was empty or filtered out as a non-detail page.",
    "filtered_out_or_empty": "Documents were discovered but filtered out or reduced to zero usable items.",
    "ok": "Source produced usable documents.",
}


def source_status(raw: Column, documents: Column, exact: Column, versions: Column, category: Column) -> Column:
    return (
        F.when(raw == 0, "no_content_discovered").when((documents == 0) & (exact + versions > 0), "fully_deduplicated")
        .when((documents == 0) & F.coalesce(category == "faq", F.lit(False)), "empty_board_or_filtered").when(documents == 0, "filtered_out_or_empty").otherwise("ok")
    )


def status_reason(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in REASONS.items() for x in item]), status)


@dataclass
class IngestOptions:
    """Settings of a run; embedding limits are per source."""

    size: int = 1000
    overlap: int = 200
    versions: bool = True
    skip_embed: bool = False
    store_vectors: bool = False
    embedding_limit: int | None = None
    attachment_limit: int | None = None
    encoder: Encoder | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.skip_embed and self.store_vectors:
            raise ValueError("vectors cannot be stored without embedding")


@dataclass
class IngestResult:
    documents: DataFrame
    chunks: DataFrame
    embedded: DataFrame | None
    report: DataFrame


def source_report(sources: DataFrame, metrics: DataFrame, chunks: DataFrame, embedded: DataFrame | None, stored: bool = False) -> DataFrame:
    """One row per source, those without documents included."""
    count = lambda df, name: df.groupBy("source_name").agg(F.count(F.lit(1)).alias(name))
    rows = sources.select("source_name", "category").join(metrics, "source_name", "left").join(count(chunks, "chunks"), "source_name", "left")
    if embedded is not None:
        rows = rows.join(count(embedded, "embedded_chunks"), "source_name", "left")
    else:
        rows = rows.withColumn("embedded_chunks", F.lit(0))
    rows = rows.withColumnsRenamed({"total_input": "raw_documents", "total_output": "documents"})
    rows = rows.withColumn("stored_chunks", F.col("embedded_chunks") if stored else F.lit(0))
    rows = rows.select("source_name", "category", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])
    status = source_status(F.col("raw_documents"), F.col("documents"), F.col("exact_duplicates_removed"), F.col("version_duplicates_removed"), F.col("category"))
    return rows.withColumn("status", status).withColumn("status_reason", status_reason(F.col("status")))


def run_totals(report: DataFrame) -> DataFrame:
    """Sums over all sources, in one row."""
    return report.agg(F.count(F.lit(1)).alias("sources"), *[F.sum(c).alias(c) for c in COUNTS])


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def ingest(docs: DataFrame, sources: DataFrame, options: IngestOptions | None = None) -> IngestResult:
    """`docs` has the document columns, source_name and seq; `sources` has source_name and category."""
    o = options or IngestOptions()
    # Keys are made once; which rows stay, and the report's counts of them, follow from names alone.
    best = best_rows(docs)
    names = version_names(docs, best) if o.versions else best
    kept = named(docs, names, "left_semi")
    chunks = pin(chunk_documents(kept, o.size, o.overlap))
    embedded = None
    if not o.skip_embed:
        embedded = embed(select_for_embedding(chunks, o.embedding_limit, o.attachment_limit, ["seq", "chunk_index"]), o.encoder)
    report = source_report(sources, dedup_metrics(docs, best, names), chunks, embedded, o.store_vectors)
    return IngestResult(kept, chunks, embedded, report)
