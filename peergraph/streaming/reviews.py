"""Append-only logs as streams: the latest row of each key, and windowed counts with late data.

An extension: the batch form of the same rule is :func:`peergraph.operators.scoring.latest`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """A streaming aggregation that keeps the newest row of each key (update or complete mode)."""
    rest = [c for c in log.columns if c not in (*key, order)]
    new = log.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return new.select(*key, f"_r.{order}", *[f"_r.{c}" for c in rest])


def windowed_counts(log: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window start, by, n): tumbling counts; rows later than ``late`` behind the newest are dropped by the watermark."""
    return log.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")
