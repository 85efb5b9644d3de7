"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing and best-fit packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import free, held_out, shared_folder, table
from corpusflow.llm.exact_dedup import drop_exact_duplicates
from corpusflow.llm.langid import UNDETERMINED, identify_rows
from corpusflow.llm.mixing import mixed_documents
from corpusflow.llm.near_dedup import drop_near_duplicates
from corpusflow.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null texts and texts without a letter.

    A null id is never held out and never learned from; repeated rows get equal results; an empty
    table stays empty. Columns keep their names whatever they are; very long texts are read whole.
    """
    learn = docs.where(~held_out(F.col("doc_id")))
    labelled = learn.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    pred, score = free(docs, "lang_pred", "score")
    found = identify_rows(docs, labelled, learn.select(F.col("doc_id").alias("id"), "text"), "text", pred, score)
    return found.where(F.col(pred) != UNDETERMINED).drop(pred, score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the row with the smallest doc_id stays.

    Null texts count as empty. A null id loses to any other; of rows that agree in id and text one
    stays. Further columns stay as they are, names that clash too; an empty table stays empty.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest id: shingles of five words, similarity 0.8.

    Texts without a word are linked with nothing and stay, and so do rows with a null id. Rows that
    repeat an id stay or go together. Further columns stay; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most; those that it does not take go.

    A null source is a source; texts without a word take no room and go; ties of the order end in
    id and text, so reruns agree. Further columns stay; an empty table stays empty.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents, or their pieces, in sequences of 2048 words.

    A document longer than a sequence is cut into pieces, all of which are placed; one without a
    word has a piece of no words. Copies that the mix repeats are of one duplicate cluster and get
    different sequences. A null id or source is a value like others; an empty table gives no rows.
    """
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express language ID and packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
