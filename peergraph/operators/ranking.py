"""Ranks over whole tables without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergraph.sources.scratch import table


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with its 0-based position in the global ``order``.

    Rows are dealt by range; a position is the place inside the range plus the sizes of
    the ranges before it, of which only one number each comes to the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = table(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_at", F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33))
    before, seen = {}, 0
    for row in sorted(ranged.groupBy("_part").count().collect()):
        before[row["_part"]], seen = seen, seen + row["count"]
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.expr("cast(map() as map<int,int>)")
    return ranged.withColumn(name, (F.element_at(starts, F.col("_part")) + F.col("_at")).cast("long")).drop("_part", "_at")


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, ties, below): of every distinct non-null value, its rows and the rows below it."""
    return counted_ranks(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("ties")), value)


def counted_ranks(counts: DataFrame, value: str) -> DataFrame:
    """(value, ties, below) from distinct values and their ``ties``."""
    ranged = counts.repartitionByRange(F.col(value)).withColumn("_part", F.spark_partition_id())
    ranged = table(ranged, "values")
    before, seen = {}, 0
    for row in sorted(ranged.groupBy("_part").agg(F.sum("ties").alias("n")).collect()):
        before[row["_part"]], seen = seen, seen + row["n"]
    starts = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]) if before else F.expr("cast(map() as map<long,long>)")
    inside = F.sum("ties").over(Window.partitionBy("_part").orderBy(value)) - F.col("ties")
    return ranged.withColumn("below", F.element_at(starts, F.col("_part").cast("long")) + inside).drop("_part")


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based average rank of ``value`` over all rows; null values have none."""
    ranks = value_ranks(df, value).select(
        F.col(value).alias("_v"), (F.col("below") + (F.col("ties") + 1) / F.lit(2).cast("double")).alias(name)
    )
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def percentiles(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """``df`` with (average rank - 1) / (n - 1) * 100; a single row has percentile 0."""
    n = df.where(F.col(value).isNotNull()).count()
    out = average_ranks(df, value, "_rank")
    share = (F.col("_rank") - 1) / F.lit(float(max(n - 1, 1))) * 100
    return out.withColumn(name, share if n > 1 else F.lit(0.0)).drop("_rank")
