"""Bounded samples of labelled documents to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pin

#: Rows of a sample over all labels together.
MOST_ROWS = 100_000


def bounded_sample(labelled: DataFrame, docs: DataFrame, per_label: int, label_chars: int, all_chars: int) -> list[tuple[str, int, str]]:
    """(label, id, text) of some documents of every label, with their whole texts.

    `labelled` has id and label, `docs` has id and text. Of a label at most `per_label` documents are
    taken, in order of a hash of the id, so the sample is spread evenly and reruns agree; the first,
    and then as many as have `label_chars` characters together, shorter texts first where one text
    alone is over a quarter of that. If labels are so many that all would have more than `all_chars`
    characters or MOST_ROWS rows, each has its share of those, and every label has at least one row. Ids are picked
    over the narrow table first; per_label rows a label are broadcast to pick their texts.
    """
    named = labelled.where("id is not null and label is not null").select("id", F.col("label").cast("string"), F.xxhash64("id").alias("h"))
    named = named.groupBy("id", "h").agg(F.min("label").alias("label"))
    n_labels = named.select("label").distinct().count()
    if not n_labels:
        return []
    rows, chars = max(1, min(per_label, MOST_ROWS // n_labels)), max(1, min(label_chars, all_chars // n_labels))
    first = Window.partitionBy("label").orderBy("h", "id")
    wanted = pin(named.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= rows).drop("nth"))
    found = docs.join(F.broadcast(wanted), "id").where("text is not null").select("label", "id", "h", "text", F.xxhash64("text").alias("t"))
    once = found.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("t"))).where("nth = 1")
    order = Window.partitionBy("label").orderBy(F.length("text") > chars // 4, "h", "id")
    upto = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = once.withColumn("nth", F.row_number().over(order)).withColumn("upto", upto).where((F.col("nth") == 1) | (F.col("upto") <= chars))
    return sorted((r["label"], r["id"], r["text"]) for r in fits.select("label", "id", "text").collect())
