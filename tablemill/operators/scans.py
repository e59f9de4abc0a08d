"""Scans along an order that need no task with a whole group: rows are dealt by ranges of the
order, numbered inside a range, and what stands before a range is carried to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.storage import stash

#: Positions that share a task in a window over neighbours.
BLOCK = 4096


def numbered(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """`rows` with `column`: 0, 1, 2 .. along `order` (which has no ties) within each `group`.

    A group of any size spreads over as many tasks as its rows fill. Only a row for each group and range is
    counted up along the ranges. Null groups are groups; the table is written once, so ranges stay as dealt."""
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id())
    placed = stash(placed.withColumn("_range", F.shiftright("_id", 33)), "ranges")
    ranges = placed.groupBy(*group, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")
    named = [F.col(c).alias(f"_g_{c}") for c in group]
    starts = ranges.select(*named, F.col("_range").alias("_r"), (before - F.col("_first")).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("_id") + F.col("_start")).alias(column))


def runs(rows: DataFrame, group: str, order: list[str], flag: Column, position: str | None = None) -> DataFrame:
    """(group, run, length): maximal runs of consecutive rows where `flag` holds. `position` may name a column that
    numbers the rows of a group without gaps."""
    placed = rows if position else numbered(rows, [group], order, "_nth")
    at = position or "_nth"
    held = numbered(placed.where(F.coalesce(flag, F.lit(False))).select(group, at), [group], [at], "_k")
    return held.groupBy(group, (F.col(at) - F.col("_k")).alias("run")).agg(F.count("*").alias("length"))


def neighbours(rows: DataFrame, group: str, position: str, columns: dict[str, tuple[Column, int, int]], block: int = BLOCK) -> DataFrame:
    """`rows` with new columns, each (aggregate, from, to): the aggregate over the rows whose `position`
    (0, 1, 2 .. in a group) is from `from` to `to` places away. Rows near the end of a block of positions are
    sent to the next block as well, so that a window never spans more than a block and its edges."""
    before, after = max(0, *(-a for _, a, _ in columns.values())), max(0, *(b for _, _, b in columns.values()))
    at = F.col(position)
    blocks = F.sequence(F.floor(F.greatest(at - after, F.lit(0)) / block), F.floor((at + before) / block))
    dealt = rows.withColumn("_block", F.explode(blocks))
    near = Window.partitionBy(group, "_block").orderBy(position)
    found = dealt.select(*rows.columns, "_block", *(c.over(near.rowsBetween(a, b)).alias(name) for name, (c, a, b) in columns.items()))
    return found.where(F.col("_block") == F.floor(at / block)).drop("_block")
