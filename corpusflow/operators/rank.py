"""Positions and running sums in a global order, without a window over all rows.

Rows are dealt by ranges of the order and sorted within; a row's place in its partition is counted as it
passes, and what lies before a partition is a sum over one small row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import pin

#: monotonically_increasing_id() counts a partition's rows in its lower bits.
ROW_BITS = 33


def _dealt(rows: DataFrame, order: list[Column], *extra: Column) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return pin(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_place"), *extra))


def _before(dealt: DataFrame, **totals: Column) -> DataFrame:
    """Per partition each total of those before it, from one pass; one row each, so they are few at any size."""
    sums = {r["_part"]: r for r in dealt.groupBy("_part").agg(*[total.alias(name) for name, total in totals.items()]).collect()}
    rows, seen = [], dict.fromkeys(totals, 0)
    for part in sorted(sums):
        rows.append((part, *seen.values()))
        seen = {name: seen[name] + (sums[part][name] or 0) for name in totals}
    return F.broadcast(dealt.sparkSession.createDataFrame(rows, ", ".join(["_part int", *[f"{name} long" for name in totals]])))


def with_position(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the row's position from 1 in the order, which should end in a unique key.

    Rows that tie in all keys get neighbouring positions in no stated order and lie in one partition.
    """
    dealt = _dealt(rows, order)
    before = _before(dealt, _before=F.count(F.lit(1)))
    position = F.col("_before") + F.col("_place") + 1
    return dealt.join(before, "_part").withColumn(name, position.cast("long")).drop("_part", "_place", "_before")


def with_running_sum(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows up to and with this one in the order; position from 1 as well."""
    dealt = _dealt(rows.withColumn(name, value.cast("long")), order)
    before = _before(dealt, _before=F.count(F.lit(1)), _value_before=F.sum(name))
    upto = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(name, F.sum(name).over(upto)).join(before, "_part")
    return summed.select(
        *[c for c in rows.columns], (F.col("_before") + F.col("_place") + 1).cast("long").alias("position"), (F.col(name) + F.col("_value_before")).alias(name)
    )
