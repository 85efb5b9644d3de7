"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a queue of its documents in shuffled order, repeated `max_repeats` times. A copy of
a document has a virtual finish time: the words of its source up to its end, divided by the
source's target. All copies are ordered by finish time over all sources, and those are taken whose
running total of words stays within the budget. Running totals are taken in two steps, over the
sums of small buckets and then inside each bucket, so no source and no task holds a long window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, pin, words

WEIGHTS = (5, 2, 1)
#: Rows that a bucket of a running total has on average.
BUCKET_ROWS = 2000


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the running sum of `value` in each group, in `order`; `bucket` must ascend with `order`.

    A group's buckets are summed first, so a window over rows never spans more than one bucket.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(upto), F.lit(0).cast("long")).alias("_base"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_in", F.sum(value).over(inside))
        .join(base, [*group, bucket])
        .withColumn(name, F.col("_in") + F.col("_base"))
        .drop("_in", "_base")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """`sizes` has a row per source (source, source_size); adds weight and target.

    Sources in order of code point, null last, get the weights in turn and share the total by
    weight. A target stops at max_repeats times its source's size; what is over is shared again.
    Sources reach their stop in order of max_repeats * size / weight, so one pass in that order
    finds all that stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    full = (F.col("source_size") * max_repeats).alias("full")
    weighed = sizes.withColumn("weight", weight).withColumn("full", full)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(first), none)) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(first), none)
    )
    stops = weighed.withColumn("stops", level * F.col("weight") > F.col("full"))
    left = F.sum("source_size").over(whole) - F.sum(F.when(F.col("stops"), F.col("full")).otherwise(none)).over(whole)
    share = left / F.sum(F.when(F.col("stops"), none).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("stops"), F.col("full").cast("double")).otherwise(share * F.col("weight"))
    return stops.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = 3,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `docs`: id_col, source_col, size, source_size, target, copies, taken.

    size is the number of words (null text: 0), copies how often the mix takes the document, taken
    the words that makes. The budget is the size of all documents together. The shuffle orders a
    source by the MD5 of the id; ties go by id, then size, so reruns agree; among rows alike in all
    three it does not matter which is taken. A document without words, or of a source without any,
    is never taken. A null source is a source, and the last. An empty table gives an empty result.
    Columns named in `extra` are carried along; no others are read.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_shuffle"),
        *[F.col(c).alias(f"_x_{c}") for c in extra],
    )
    rows = pin(rows)
    n = rows.count()
    digits = 1
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    keyed = rows.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_bucket", F.substring("_shuffle", 1, digits))
    queued = running_sum(keyed, ["_s"], "_bucket", ["_shuffle", "_id", "size"], "size", "_upto")
    queued = queued.join(targets.drop("source", "weight"), "_s")
    queued = pin(queued)
    steps = max(16, 16**digits)
    turns = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    copies = queued.where("size > 0").select("_s", "_shuffle", "_id", "size", turns.alias("_turn"), "source_size", "target", "_upto")
    finish = (F.col("_turn") * F.col("source_size") + F.col("_upto")) / F.col("target")
    copies = copies.select("_s", "_shuffle", "_id", "size", "_turn", finish.alias("_finish"), F.floor(finish * steps).alias("_step"))
    # The budget runs out in one step: those before it are taken whole, that one is ordered.
    sums = copies.groupBy("_step").agg(F.sum("size").alias("_sum"))
    upto = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    at = pin(sums.withColumn("_upto", F.sum("_sum").over(upto)))
    edge = at.where(F.col("_upto") > budget).agg(F.min("_step")).first()[0]
    before = at.where(F.col("_upto") <= budget).agg(F.max("_upto")).first()[0] or 0
    whole = copies.where(F.lit(True) if edge is None else F.col("_step") < edge).select("_s", "_shuffle", "_id", "size")
    last = copies.where(F.lit(False) if edge is None else F.col("_step") == edge)
    last = last.withColumn("_fine", F.floor((F.col("_finish") * steps - F.col("_step")) * steps))
    last = running_sum(last, ["_step"], "_fine", ["_finish", "_s", "_shuffle", "_id", "size", "_turn"], "size", "_total")
    last = last.where(F.col("_total") + before <= budget).select("_s", "_shuffle", "_id", "size")
    taken = whole.unionByName(last).groupBy("_s", "_shuffle", "_id", "size").agg(F.count(F.lit(1)).alias("_copies"))
    # Rows alike in source, id and size share what was taken of them, the first ones first.
    alike = Window.partitionBy("_s", "_shuffle", "size").orderBy("_id", *[f"_x_{c}" for c in extra])
    same = Window.partitionBy("_s", "_shuffle", "size")
    dealt = queued.withColumn("_nth", F.row_number().over(alike)).withColumn("_rows", F.count(F.lit(1)).over(same))
    joined = dealt.join(taken.drop("_id"), ["_s", "_shuffle", "size"], "left")
    share = F.coalesce(F.col("_copies"), F.lit(0).cast("long"))
    own = F.floor(share / F.col("_rows")) + (F.col("_nth") <= share % F.col("_rows")).cast("long")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        F.coalesce("target", F.lit(0.0)).alias("target"),
        own.alias("copies"),
        (own * F.col("size")).alias("taken"),
        *[F.col(f"_x_{c}").alias(c) for c in extra],
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The documents that the mix takes, all columns kept, each as often as it is taken."""
    m_id, m_source, m_size, m_copies, m_rows, k_source, k_size, own, copy = free(
        docs, "mix_id", "mix_source", "mix_size", "mix_copies", "mix_rows", "own_source", "own_size", "own_copies", "copy"
    )
    mark = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    mixed = mix(docs, id_col, text_col, source_col, **options)
    plan = mixed.groupBy(F.col(id_col).alias(m_id), mark.alias(m_source), F.col("size").alias(m_size)).agg(
        F.sum("copies").alias(m_copies), F.count(F.lit(1)).alias(m_rows)
    )
    plan = plan.where(F.col(m_copies) > 0)
    keyed = docs.withColumn(k_source, mark).withColumn(k_size, words(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(m_id)) & (F.col(k_source) == F.col(m_source)) & (F.col(k_size) == F.col(m_size))
    nth = F.row_number().over(Window.partitionBy(m_id, m_source, m_size).orderBy(text_col))
    share = F.floor(F.col(m_copies) / F.col(m_rows)) + (nth <= F.col(m_copies) % F.col(m_rows)).cast("long")
    return (
        keyed.join(plan, same)
        .withColumn(own, share.cast("int"))
        .where(F.col(own) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
