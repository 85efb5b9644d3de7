"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts the digests of its rows into a run with one entry per digest. Partitions
then exchange their runs in rounds, as in a butterfly network: after round r, a slot holds what
fan**r partitions had of the digests whose last r digits name the slot. A slot merges the sorted
runs that it gets and keeps one entry per digest: the winning identifier, the number of rows and a
second checksum, by which two entries are verified to be of one text. After the last round each
slot has the whole truth about its share of the digests, and no slot ever saw more than one entry
of a digest from any partition, so a text with a billion copies costs no more than a rare one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, anti_join, free, lookup, pin

ENTRY = "slot int, leaf int, digest binary, check long, id long, uid long, n long"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        texts = [b"" if t is None else t.lower() for t in texts]  # bytes.lower() changes A-Z only
        yield pa.record_batch(
            {
                "id": batch.column("id"),
                "uid": batch.column("uid"),
                "digest": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                "check": pa.array([(xxhash.xxh64_intdigest(t) >> 1) ^ len(t) for t in texts], pa.int64()),
            }
        )


def _merger(largest: bool):
    def better(a: dict, b: dict) -> dict:
        key = lambda e: (e["id"] is not None, (e["id"] or 0) * (1 if largest else -1), -e["uid"])
        return a if key(a) >= key(b) else b

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slot and digest; entries of one digest follow each other."""
        held: dict | None = None
        for batch in batches:
            done = []
            for e in batch.to_pylist():
                if held is not None and held["digest"] == e["digest"] and held["slot"] == e["slot"]:
                    if held["check"] != e["check"]:
                        raise ValueError("two different texts have one digest")
                    held = better(held, e) | {"n": held["n"] + e["n"]}
                    continue
                if held is not None:
                    done.append(held)
                held = e
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=batch.schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=batch.schema)

    return merge


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", rounds: int | None = None
) -> DataFrame:
    """One row per row of `docs`: id_col, keep_id, group_size, kept, text_sha256, digest and uid.

    Texts are equal if they are the same after lower-casing A-Z; a null text counts as empty. Of
    equal texts the row with the smallest (or largest) id stays. A null id loses to any other, and
    of rows with one id exactly one stays. An empty table gives an empty result. Columns other than
    the two named are not read, so their names cannot clash.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
        .mapInArrow(_digests, "id long, uid long, digest binary, check long")
    )
    rows = pin(rows)
    total = rows.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = rounds or (2 if partitions <= 256 else 3)
    fan = max(2, math.ceil(partitions ** (1 / rounds)))
    slots = fan**rounds
    merge = _merger(keep == "largest")
    digit = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")

    def merged(runs: DataFrame) -> DataFrame:
        ranked = F.desc("id") if keep == "largest" else F.asc("id")
        return runs.sortWithinPartitions("slot", "digest", ranked).mapInArrow(merge, ENTRY)

    runs = rows.withColumn("leaf", F.pmod(F.spark_partition_id(), F.lit(slots)).cast("int")).select(
        F.col("leaf").alias("slot"), "leaf", "digest", "check", "id", "uid", F.lit(1).cast("long").alias("n")
    )
    runs = merged(runs)
    for r in range(1, rounds + 1):
        low = fan**r
        slot = (F.col("leaf") - F.pmod("leaf", F.lit(low)) + F.pmod(digit, F.lit(low))).cast("int")
        runs = merged(runs.withColumn("slot", slot).repartition(slots, "slot"))
    final = runs.select("digest", F.col("id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size"))
    return lookup(rows.select("id", "uid", "digest"), pin(final), "digest", "group_size", total).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns.

    Rows that go are picked out by their ids, so texts are not shuffled while these are few. Only where
    an id has rows that stay and rows that go are texts compared again; rows that agree in id and
    text are one document, of which one row stays. A null id is such an id if it repeats.
    """
    found = exact_duplicates(docs, id_col, text_col, keep).select(F.col(id_col).alias("id"), "kept", "text_sha256")
    by_id = found.groupBy("id").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n")).where("stay < n")
    (own,) = free(docs, "kept_id")
    open_ids = pin(by_id.select(F.col("id").alias(own), "stay"))
    rest = anti_join(docs, open_ids.select(own), F.col(id_col).eqNullSafe(F.col(own)))
    mixed = open_ids.where("stay > 0").select(own)
    if mixed.isEmpty():
        return rest
    text, of, nth = free(docs.withColumn(own, F.lit(0)), "own_text", "kept_text", "nth")
    stay = found.where("kept").join(mixed, F.col("id").eqNullSafe(F.col(own)), "left_semi").select(F.col("id").alias(own), F.col("text_sha256").alias(of))
    lowered = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), 256)
    joined = docs.withColumn(text, lowered).join(stay, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(text) == F.col(of)))
    first = F.row_number().over(Window.partitionBy(own, of).orderBy(of))
    once = joined.withColumn(nth, first).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return rest.unionByName(once)
