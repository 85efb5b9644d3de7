"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys, a few URLs' length each, that may go to every task.
FEW = 200_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, set as its checkpoint folder; a temporary one in local tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusflow-"))
    return sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def to_all(keys: DataFrame, n: int) -> DataFrame:
    """Keys for a join, n at most: few go to every task, so the other side is not shuffled."""
    return F.broadcast(keys) if n <= FEW else keys
