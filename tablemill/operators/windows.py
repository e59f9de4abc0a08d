"""Aggregates over positions of samples: envelopes and edges of silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelope(rows: DataFrame, group: str, position: str, value: str, width: int, cap: int) -> DataFrame:
    """(group, point, peak): largest magnitude per `width` samples, then pooled so that no more
    than `cap` points a group remain."""
    first = rows.groupBy(group, F.floor(F.col(position) / width).alias("_slot")).agg(F.max(F.abs(F.col(value))).alias("peak"))
    counted = first.groupBy(group).agg(F.count("*").alias("_n"))
    pooled = first.join(counted, group).withColumn("point", F.floor(F.col("_slot") / F.ceil(F.greatest(F.col("_n") / cap, F.lit(1)))))
    return pooled.groupBy(group, "point").agg(F.max("peak").alias("peak"))


def silence_edges(rows: DataFrame, group: str, position: str, value: str, per_second: float, floor: float = 0.001) -> DataFrame:
    """(group, head_ms, tail_ms): silence before the first and after the last audible sample; an
    all-silent group is head only."""
    loud = F.when(F.abs(F.col(value)) > floor, F.col(position))
    ends = rows.groupBy(group).agg(F.min(loud).alias("_first"), F.max(loud).alias("_last"), F.max(position).alias("_end"))
    ms = 1000.0 / per_second
    return ends.select(
        group, (F.coalesce("_first", F.col("_end") + 1) * ms).alias("head_ms"),
        F.when(F.col("_last").isNull(), 0.0).otherwise((F.col("_end") - F.col("_last")) * ms).alias("tail_ms"),
    )
