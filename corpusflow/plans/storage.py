"""Canonical tables of an ingest: sources, documents, attachments, chunks and runs.

A table is a folder of versions v=0, v=1, ...; a run reads the newest, merges, and writes the next
one beside it. A reader sees a version only once its _SUCCESS file stands, so a lost run changes
nothing. Runs are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..functions.urls import file_name, file_type
from ..operators.store import document_type, upsert, upsert_hashed
from .ingest import COUNTS, IngestResult

KEYS = {"sources": ["source_name"], "documents": ["doc_id"], "chunks": ["chunk_id"], "attachments": ["doc_id", "attachment_url"]}


def versions(spark: SparkSession, folder: str, table: str) -> list[int]:
    """Numbers of complete versions, ascending, by the file system that Spark uses for the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done if n.startswith("v="))


def current(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    found = versions(spark, folder, table)
    return spark.read.parquet(f"{folder}/{table}/v={found[-1]}") if found else None


def _store(new: DataFrame, folder: str, table: str, as_of: Column, hashed: bool) -> None:
    spark = new.sparkSession
    found = versions(spark, folder, table)
    old = spark.read.parquet(f"{folder}/{table}/v={found[-1]}") if found else None
    keys = KEYS[table]
    if hashed:
        empty = new.withColumn("status", F.lit("active")).withColumn("last_seen_at", as_of).limit(0)
        merged = upsert_hashed(old if old is not None else empty, new, keys, as_of)
    else:
        staged = new.withColumn("last_seen_at", as_of)
        merged = upsert(old if old is not None else staged.limit(0), staged, keys)
    merged.write.mode("overwrite").parquet(f"{folder}/{table}/v={found[-1] + 1 if found else 0}")


def store_result(result: IngestResult, sources: DataFrame, folder: str, run_id: str, as_of: Column) -> None:
    """Stores what an ingest produced, sources first and the run last, one run row per source."""
    docs = result.documents
    _store(sources.select("source_name", "category", F.lit("active").alias("status")), folder, "sources", as_of, hashed=False)
    kept = docs.select(
        "doc_id", "source_name", "source_type", "source_url", F.substring("title", 1, 300).alias("title"), "content", "category", "department", "published_at",
        content_hash(F.col("content")).alias("content_hash"), document_type(F.col("source_type"), F.col("category")).alias("doc_type"),
    )
    _store(kept, folder, "documents", as_of, hashed=True)
    if "attachment_urls" in docs.columns:
        files = docs.select("doc_id", F.explode(F.array_distinct("attachment_urls")).alias("attachment_url"))
        files = files.select(
            "doc_id", "attachment_url", file_name(F.col("attachment_url")).alias("file_name"), file_type(F.col("attachment_url")).alias("file_type"),
            F.lit("discovered").alias("extraction_status"),
        )
        _store(files, folder, "attachments", as_of, hashed=False)
    chunks = result.chunks.select("chunk_id", "doc_id", "chunk_index", "text", content_hash(F.col("text")).alias("content_hash"))
    _store(chunks, folder, "chunks", as_of, hashed=True)
    runs = result.report.select(F.lit(run_id).alias("run_id"), "source_name", "status", F.col("status_reason").alias("reason"), *COUNTS, as_of.alias("completed_at"))
    runs.write.mode("append").parquet(f"{folder}/runs")


def prune(folder: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Current documents, and those of the chunks whose document still has as many of them."""
    docs, chunks = current(spark, folder, "documents"), current(spark, folder, "chunks")
    latest = chunks.groupBy("doc_id").agg(F.max("last_seen_at").alias("last_seen_at"))
    return docs, chunks.join(latest, ["doc_id", "last_seen_at"], "left_semi")
