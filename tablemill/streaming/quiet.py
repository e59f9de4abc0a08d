"""Keys that fall quiet: a stateful processor with event-time timers, and the same in whole batches."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tablemill.storage import read_text, scratch, stash, write_text

# The process that sets a stateful processor up has no search path for this package, so the class travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Quiet(StatefulProcessor):
    """Of each key's rows, the one after which `quiet` milliseconds of event time passed without
    another: debounced events, or what is past its time of retention.

    State holds a key's last row and its timer. The rows of a batch and the held one are taken in order of time; a row that comes
    more than `quiet` after the one before lets that go at once, the timer lets the last go when the
    watermark has passed. `n` counts the rows that went into it. Late rows are dropped by the watermark.
    A key's rows of a batch are plain tuples and what they let go is one table, as most keys have few rows."""

    def __init__(self, quiet: int, key: list[str], at: str, columns: list[str], schema: str):
        self.quiet, self.key, self.at, self.columns, self.schema = quiet, key, at, columns, schema

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema + ", _ms long, _n long")

    def out(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row[:-2], row[-1]) for row in rows], columns=[*self.key, *self.columns, "n"])

    def handleInputRows(self, key, rows, timerValues):
        given = []
        for pdf in rows:
            ms = pdf[self.at].to_numpy("datetime64[us]").view("int64") // 1000
            given.extend((*row, 1) for row in zip(ms.tolist(), *(pdf[c].tolist() for c in self.columns)))
        held, gone = self.last.get(), []
        if held is not None:
            given.append((held[-2], *held[:-2], held[-1]))
        given.sort()
        last, n = given[0], 0
        for row in given:
            if row[0] - last[0] > self.quiet:
                gone.append((*last[1:-1], last[0], n))
                n = 0
            last, n = row, n + row[-1]
        if held is None or held[-2] != last[0]:
            if held is not None:
                self.handle.deleteTimer(int(held[-2]) + self.quiet + 1)
            self.handle.registerTimer(last[0] + self.quiet + 1)
        self.last.update((*last[1:-1], last[0], n))
        if gone:
            yield self.out(key, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.last.get()
        self.last.clear()
        yield self.out(key, [held])

    def close(self) -> None:
        pass


def quiet_after(stream: DataFrame, key: list[str], at: str, columns: list[str], quiet: int, delay: str = "0 seconds") -> DataFrame:
    """(key, columns, n): of each run of a key's rows that follow each other within `quiet` milliseconds of the time
    `at`, the last one and how many there are, once the watermark has passed the run's end. Equal times are ordered by
    `columns`, whose values are no nulls. Needs the state store provider RocksDB (`session.stateful`)."""
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in columns)
    given = stream.where(" and ".join(f"`{c}` is not null" for c in [*key, at])).select(*key, F.col(at).cast("timestamp").alias(at), *(c for c in columns if c != at)).withWatermark(at, delay)
    out = ", ".join(f"{c} {fields[c]}" for c in key) + f", {schema}, n long"
    return given.groupBy(*key).transformWithStateInPandas(Quiet(quiet, key, at, columns, schema), outputStructType=out, outputMode="append", timeMode="eventTime")


class QuietBatches:
    """What `quiet_after` gives, batch by batch, with every key's last row in a stored table: a batch is one window over its own rows and the
    held ones, where a stateful processor is called for each key. Batches are numbered from 0; one that comes again is done again."""

    def __init__(self, spark: SparkSession, folder: str, stream: DataFrame, key: list[str], at: str, columns: list[str], quiet: int, delay: int):
        self.spark, self.folder, self.key, self.at, self.columns, self.quiet, self.delay = spark, folder.rstrip("/"), key, at, columns, quiet, delay
        fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
        self.held = ", ".join(f"{c} {fields[c]}" for c in [*key, *columns]) + ", _ms long, _n long"
        self.out = ", ".join(f"{c} {fields[c]}" for c in [*key, *columns]) + ", n long"

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in a batch: rows at or before the watermark are late and go; the watermark, in milliseconds, moves on with the batch's last time."""
        spark = batch.sparkSession
        before = int(read_text(spark, f"{self.folder}/watermark-{number - 1}")) if number else -(1 << 62)
        rows = batch.select(*self.key, *self.columns, F.unix_millis(F.col(self.at).cast("timestamp")).alias("_ms"), F.lit(1).cast("long").alias("_n")).dropna(subset=[*self.key, "_ms"])
        last = rows.agg(F.max("_ms")).first()[0]  # one row
        mark = max(before, last - self.delay) if last is not None else before
        rows = rows.where(F.col("_ms") > before)
        if number:
            rows = rows.unionByName(spark.read.schema(self.held).parquet(f"{self.folder}/held-{number - 1}"))
        order = Window.partitionBy(*self.key).orderBy("_ms", *self.columns)
        told = rows.withColumn("_next", F.lead("_ms").over(order)).withColumn("_total", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        ends = told.where(F.col("_next").isNull() | (F.col("_next") - F.col("_ms") > self.quiet))
        ends = ends.withColumn("_n", F.col("_total") - F.coalesce(F.lag("_total").over(order), F.lit(0)))
        waits = F.col("_next").isNull() & (F.col("_ms") + self.quiet >= mark)
        with scratch(spark):
            ends = stash(ends.withColumn("_waits", waits).drop("_next", "_total"), "run-ends")
            ends.where("_waits").drop("_waits").write.mode("overwrite").parquet(f"{self.folder}/held-{number}")
            ends.where("not _waits").select(*self.key, *self.columns, F.col("_n").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/gone/batch={number}")
        write_text(spark, f"{self.folder}/watermark-{number}", str(mark))

    def gone(self) -> DataFrame:
        """(key, columns, n) of all that fell quiet so far."""
        return self.spark.read.schema(self.out).parquet(f"{self.folder}/gone").select(*self.key, *self.columns, "n")
