"""Re-crawls as a stream: each micro-batch is upserted with change detection into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators.store import upsert_hashed


def ingest_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps `folder`/v=<batch> the table after each batch; the newest version is current.

    `stream` has doc_id, content and collected_at. A batch writes a new version beside the old one,
    so a repeated batch after a failure overwrites its own version only.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = batch.groupBy("doc_id").agg(F.max_by(F.struct("content", "collected_at"), "collected_at").alias("r")).select("doc_id", "r.*")
        new = columns.withColumn("content_hash", content_hash(F.col("content")))
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in new.schema)}, status string, last_seen_at timestamp"
        old = spark.read.schema(schema).parquet(f"{folder}/v={number - 1}") if number else spark.createDataFrame([], schema)
        upsert_hashed(old, new, ["doc_id"], F.col("collected_at").cast("timestamp")).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
