"""Structured Streaming: file listings and events as they come, applied batch by batch."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tablemill import schemas
from tablemill.streaming.store import BucketStore


def listing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Listings (path, filename, size_bytes, mtime) as JSON files that arrive in `folder`."""
    return spark.readStream.schema(schemas.LISTING).json(folder)


def distinct_work(events: DataFrame, key: list[str], at: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once while it is within `delay`: what is queued is not queued again."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def counts_by_window(events: DataFrame, at: str, width: str, delay: str, *group: str) -> DataFrame:
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, width), *group).agg(F.count("*").alias("n"))


def running_sums(blocks: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total, squares, peak) of all values so far: bounded accumulators in the state of
    a stream without end; a batch table gives the same."""
    x = F.col(value)
    return blocks.groupBy(key).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.max(F.abs(x)).alias("peak"))


def apply_batches(
    stream: DataFrame, store: BucketStore, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str,
    notify: Callable[[int, set[int]], None] | None = None, keep: int = 2,
) -> StreamingQuery:
    """Apply each batch of `stream` to a stored table, which has its first version: batch n makes version n + 1 and
    reads and writes the buckets that its keys fall in. A batch that is run again finds its version there, so a restart
    neither loses nor doubles changes. `notify` gets the batch's number and the changed buckets, once a batch that
    changed anything. Versions before the last `keep` are forgotten. Runs over what has arrived, then ends."""

    def run(batch: DataFrame, number: int) -> None:
        changed = store.apply(batch, step, number + 1)
        if changed and notify is not None:
            notify(number, changed)
        store.forget(keep)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressEvery(StreamingQueryListener):
    """Calls `tell` with the rows read so far, at most once for every `step` of them."""

    def __init__(self, step: int, tell: Callable[[int], None]):
        self.step, self.tell, self.rows, self.told = step, tell, 0, 0
        self.ended, self.change = 0, threading.Condition()

    def wait_for(self, runs: int, seconds: float = 60.0) -> None:
        """Until the end of so many streams has been heard of, which comes after all of their progress."""
        with self.change:
            self.change.wait_for(lambda: self.ended >= runs, seconds)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended += 1
            self.change.notify_all()

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if self.rows // self.step > self.told:
            self.told = self.rows // self.step
            self.tell(self.rows)
