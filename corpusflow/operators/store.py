"""Keyed upserts with change detection, deletes, and the backfill of missing vectors.

A table is a DataFrame; an upsert is a full outer join on the key, to be written beside the old
version and swapped in. Rows that a run does not mention stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import with_position


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """`new` replaces `old` by key; columns named in `keep` hold their old value where there is one."""
    columns = [c for c in new.columns if c not in keys]
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")

    def value(c: str) -> Column:
        if c not in old.columns:
            return F.col(f"n.{c}")
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[value(c).alias(c) for c in columns])


def upsert_hashed(old: DataFrame, new: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Upsert of rows with content_hash: status is updated where the hash changed, else active.

    last_seen_at becomes `as_of` for all rows of `new`.
    """
    before = old.select(*keys, F.col("content_hash").alias("_before"))
    changed = F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col("content_hash"))
    staged = new.join(before, keys, "left").withColumn("status", F.when(changed, "updated").otherwise("active")).withColumn("last_seen_at", as_of)
    return upsert(old, staged.drop("_before"), keys)


def upsert_by_name(old: DataFrame, new: DataFrame) -> DataFrame:
    """Seed rows: identity is the name; new names get ids after the largest one, in order of name."""
    known = old.select("name", "id")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = with_position(new.join(known, "name", "left_anti"), [F.col("name")], "_n")
    fresh = fresh.withColumn("id", (F.lit(top) + F.col("_n")).cast("long")).drop("_n")
    seen = new.join(known, "name")
    return upsert(old, seen.unionByName(fresh), ["name"])


def delete_documents(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors of all other documents."""
    return vectors.join(docs.select("doc_id").distinct(), "doc_id", "left_anti")


def with_source_metadata(embedded: DataFrame, sources: DataFrame) -> DataFrame:
    """Embedded chunks (with source_name) as rows of the vector table: category and department are their source's.

    A chunk whose source is not known has neither. Sources are few beside chunks but not bounded, so Catalyst picks the join.
    """
    named = sources.select("source_name", F.col("category").alias("_category"), F.col("department").alias("_department")).dropDuplicates(["source_name"])
    kept = [c for c in embedded.columns if c not in ("category", "department")]
    return embedded.select(*kept).join(named, "source_name", "left").withColumnsRenamed({"_category": "category", "_department": "department"})


def replace_vectors(vectors: DataFrame, docs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-ingest of `docs`: their vectors go, those of `new` come by chunk_id. Also one row of counts.

    deleted_documents counts distinct documents, with vectors or not; a document without new chunks loses
    its old ones; before and after are the table's rows.
    """
    gone = docs.select("doc_id").distinct()
    after = upsert(vectors.join(gone, "doc_id", "left_anti"), new, ["chunk_id"])
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = count(vectors, "before").join(count(gone, "deleted_documents")).join(count(new, "stored")).join(count(after, "after"))
    return after, counts


def replace_documents(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors of the documents in `new` are deleted, then its rows inserted by chunk_id."""
    return upsert(delete_documents(vectors, new), new, ["chunk_id"])


def pending_chunks(chunks: DataFrame, docs: DataFrame, vectors: DataFrame, limit: int | None = None, source_name: str | None = None) -> DataFrame:
    """Active chunks without a vector, newest first: inner join, anti join, then top n."""
    named = docs.select("doc_id", "source_name", "title", "source_url", "category", "department")
    rows = chunks.where(F.col("status") == "active").join(named, "doc_id")
    if source_name is not None:
        rows = rows.where(F.col("source_name") == source_name)
    rows = rows.join(vectors.select("chunk_id"), "chunk_id", "left_anti").orderBy(F.desc("last_seen_at"), "chunk_id")
    return rows if limit is None else rows.limit(limit)


def document_type(source_type: Column, category: Column) -> Column:
    """Kind of a stored document, by category, then source type."""
    return (
        F.when(category == "academic_schedule", "calendar").when(category == "faq", "faq")
        .when(source_type.isin("pdf", "docx", "hwp", "hwpx", "zip", "file"), "file")
        .when(F.coalesce(category, F.lit("")) != "", category).otherwise(source_type)
    )
