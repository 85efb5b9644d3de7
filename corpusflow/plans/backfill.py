"""Backfill: stored chunks that have no vector yet are embedded batch by batch, newest first.

The order of all active chunks is made once, with the running number of those that have no vector, and
kept in the job's folder; batches are ranges of it. A batch's vectors are written before its line of the
journal, so a run that breaks goes on where the journal ends: what a lost batch has already written is
found among the vectors and not written again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_markdown
from ..operators.rank import with_running_sum
from ..sources.services import Encoder, embed
from ..sources.shared import pin

JOURNAL = "batch long, upto long, selected long, embedded long, skipped_existing long, failed long, reason string"
VECTOR = "chunk_id string, doc_id string, chunk_index int, text string, title string, source_url string, source_type string, published_at timestamp_ntz, embedding array<float>, embedding_model string"


@dataclass(frozen=True)
class BackfillOptions:
    """At most `limit` chunks are tried, in batches of so many rows of the order."""

    limit: int = 100
    batch_size: int = 10
    model: str = "hashing-64"
    source_name: str | None = None
    encoder: Encoder | None = field(default=None, repr=False)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of a folder, empty while nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def plan_backfill(chunks: DataFrame, docs: DataFrame, vectors: DataFrame, options: BackfillOptions) -> DataFrame:
    """Active chunks of known documents, with their position in the order and, where they have no vector, their number among these.

    `vectors` needs chunk_id only. A row with a vector has the number of the last one before it.
    """
    named = docs.select("doc_id", "source_name", "published_at").dropDuplicates(["doc_id"])
    rows = chunks.where(F.col("status") == "active").join(named, "doc_id")
    if options.source_name is not None:
        rows = rows.where(F.col("source_name") == options.source_name)
    stored = vectors.select("chunk_id", F.lit(True).alias("stored")).distinct()
    rows = rows.join(stored, "chunk_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    return with_running_sum(rows, [F.desc_nulls_last("last_seen_at"), F.asc("chunk_id")], F.when(F.col("stored"), 0).otherwise(1), "number")


def backfill(chunks: DataFrame, docs: DataFrame, folder: str, options: BackfillOptions | None = None) -> DataFrame:
    """Embeds what has no vector in `folder`/vectors and adds it there. Returns one row of counts.

    selected are the chunks tried, blank ones included: a text that is empty after cleaning counts toward the
    limit and as skipped. skipped_existing are these and the rows with a vector that were passed on the way.
    A batch whose encoder raises ends the run: failed is 1, the batches before it stay, and the next call
    goes on from there with what is left of the limit. A finished run begins anew.
    """
    o = options or BackfillOptions()
    spark = chunks.sparkSession
    if o.limit <= 0 or o.batch_size <= 0:
        raise ValueError("limit and batch size must be positive")
    vectors, runs = f"{folder}/vectors", _read(spark, f"{folder}/runs", "run string, done boolean")
    open_runs = runs.groupBy("run").agg(F.max("done").alias("done")).where("not done").collect()  # one run at a time is open
    run = open_runs[0]["run"] if open_runs else uuid.uuid4().hex
    plan, journal = f"{folder}/plan-{run}", f"{folder}/journal-{run}"
    if not open_runs:
        plan_backfill(chunks, docs, _read(spark, vectors, VECTOR), o).write.parquet(plan)
        spark.createDataFrame([(run, False)], "run string, done boolean").write.mode("append").parquet(f"{folder}/runs")
    order = spark.read.parquet(plan)
    total = order.count()
    told = _read(spark, journal, JOURNAL).where("failed = 0").agg(F.max("upto").alias("upto"), F.sum("selected").alias("selected"), F.max("batch").alias("batch")).first()
    at, tried, batch = told["upto"] or 0, told["selected"] or 0, (told["batch"] or 0) + (told["batch"] is not None)
    failed = False
    while tried < o.limit and at < total and not failed:
        last = min(at + o.batch_size, total)
        rows = order.where(F.col("position").between(at + 1, last))
        # Beyond the limit's chunk the walk stops at the next one without a vector.
        rows = rows.where(F.col("number") <= o.limit)
        # Written by a run that broke before its journal.
        known = _read(spark, vectors, VECTOR).select("chunk_id")
        clean = pin(rows.withColumn("text", F.when(~F.col("stored"), clean_markdown(F.col("text"), F.col("source_url")))))
        counts = clean.agg(
            F.count_if(~F.col("stored")).alias("new"), F.count_if("stored").alias("old"), F.count_if(F.col("text") != "").alias("full")
        ).first()
        full, blank = clean.where(F.col("text") != ""), counts["new"] - counts["full"]
        # The batch's ids go to the vectors, of which there are many more, not the vectors' ids to the batch.
        known = known.join(F.broadcast(full.select("chunk_id")), "chunk_id", "left_semi")
        try:
            made = embed(full.join(F.broadcast(known), "chunk_id", "left_anti"), o.encoder, o.model)
            made.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in VECTOR.split(", ")]).write.mode("append").parquet(vectors)
            line = (batch, last, counts["new"], counts["new"] - blank, counts["old"] + blank, 0, None)
        except Exception as e:  # noqa: BLE001 - the encoder is the caller's and raises anything; the journal keeps the reason
            failed = True
            line = (batch, at, 0, 0, 0, 1, str(e)[:500])
        spark.createDataFrame([line], JOURNAL).coalesce(1).write.mode("append").parquet(journal)
        at, tried, batch = line[1], tried + line[2], batch + 1
    if not failed:
        spark.createDataFrame([(run, True)], "run string, done boolean").write.mode("append").parquet(f"{folder}/runs")
    return _read(spark, journal, JOURNAL).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("selected", "embedded", "skipped_existing")],
        F.lit(int(failed)).cast("long").alias("failed"), F.count_if(F.col("failed") == 0).alias("batches"),
    )
