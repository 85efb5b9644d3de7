"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot if it has more than one row in HOT_SHARE, so at most HOT_SHARE keys are.
HOT_SHARE = 1000
HOT_LEAST = 1000
#: Identifiers up to this many (16 MB) are broadcast to pick out rows; more are joined by shuffle.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, set as the checkpoint folder.

    Where it is unset (tests on one machine) a temporary folder takes its place; on a cluster that
    would be wrong, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusflow-"))
    return sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until `df` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The third of the documents that no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join on a unique key of `right`, without sending a hot key's rows to one task.

    `weight` is the number of `left` rows of each `right` row. Keys over total / HOT_SHARE rows are
    at most HOT_SHARE many, so that part is broadcast; all other keys are joined by shuffle.
    """
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot = right.where(F.col(weight) > least)
    cold = right.where(F.col(weight) <= least)
    keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(
        left.join(keys, key, "left_anti").join(cold, key, "left")
    )


def anti_join(rows: DataFrame, ids: DataFrame, on: Column) -> DataFrame:
    """Rows without a match in `ids`, which are broadcast if they are few, else joined by shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, "left_anti")


def whole_blocks(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a block ends, and where their blocks start. Rows come sorted by the keys of blocks."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for key in keys:
            codes = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        at = starts(held)
        if len(at) > 1:  # the last block may go on in the next batch
            yield held.slice(0, int(at[-1])), at[:-1]
            held = held.slice(int(at[-1]))
    if held is not None and len(held):
        yield held, starts(held)
