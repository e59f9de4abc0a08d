"""Streams over stored events: what has arrived is taken in as micro-batches, and the state after
the last one is the answer. Events arrive in parts, one run of the stream for each, on one checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators import state
from tablemill.plans.base import query
from tablemill.plans.duplicates import COMPONENTS_SQL, TIMED_SQL, timed
from tablemill.plans.library import TRACKS_SQL, tracks
from tablemill.storage import scratch, table, workspace
from tablemill.streaming import quiet, watch
from tablemill.streaming.duplicates import ClassIndex
from tablemill.streaming.store import BucketStore

PARTS = 4


#: Rows of a bucket of a stored table, about.
BUCKET_ROWS = 1 << 18


def buckets_for(rows: int) -> int:
    """Buckets of a table that will have about so many rows: each has its own file and task in a write, so small tables take few."""
    return max(8, -(-rows // BUCKET_ROWS))


def arriving(rows: DataFrame, folder: str, part: Column, parts: int) -> Iterator[DataFrame]:
    """The stream over `folder` again and again, each time after another part of `rows` has been put there."""
    spark = rows.sparkSession
    for n in range(parts):
        rows.where(part == n).write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)


def quarters(events: DataFrame) -> DataFrame:
    """Events with `part`, by quarters of their ids."""
    last = events.agg(F.max("event_id").alias("_last"))  # one row
    return events.crossJoin(F.broadcast(last)).withColumn("part", F.floor(F.col("event_id") * PARTS / (F.col("_last") + 1)).cast("int")).drop("_last")


@query("SM9", """
select user_id, count(*)::bigint as n, round(sum(value), 4) as total, round(sum(value * value), 3) as squares, round(max(abs(value)), 4) as peak from events group by 1""")
def stream_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulators of each user in a stream's state; a batch writes those that it changed."""
    events = quarters(table(spark, sf_dir, "events")).select("event_id", "user_id", "value", "part")
    with scratch(spark) as keep, workspace(spark, "stream-sums") as at:
        schema = watch.running_sums(events, "user_id", "value").schema
        store = BucketStore(spark, f"{at}/state", schema, ["user_id"])
        store.write(spark.createDataFrame([], schema))

        def put(before: DataFrame, changed: DataFrame) -> DataFrame:
            return before.join(changed, "user_id", "left_anti").unionByName(changed)

        def write(batch: DataFrame, number: int) -> None:
            store.apply(batch, put, number + 1)
            store.forget()

        for stream in arriving(events, f"{at}/events", F.col("part"), PARTS):
            sums = watch.running_sums(stream, "user_id", "value")
            sums.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return keep(store.read().select("user_id", "n", F.round("total", 4).alias("total"), F.round("squares", 3).alias("squares"), F.round("peak", 4).alias("peak")), "sums")


@query("SM1 SM2 SK1 SK29", f"""
with t as (select id, path, status from ({TRACKS_SQL})),
e as (select 'p' || (event_id % 900) as path, event_type = 'error' as gone, event_id % 2 as size_bytes, event_id, (event_id * 4 // (max(event_id) over () + 1))::int as part from events
  union all select path, false, 1, 1000000000 + id, 4 from t where status = 'filed' and id >= 900),
ends as (select i, path, min(event_id) filter (not gone and size_bytes <> 1) as changed, max(event_id) filter (gone) as removed, arg_max(gone, event_id) as last_gone, arg_max(size_bytes, event_id) as last_size
  from (select unnest(range(0, 5)) as i) join e on part <= i group by 1, 2),
base as (select i, path, status from t cross join (select unnest(range(-1, 5)) as i)),
met as (select coalesce(base.i, ends.i) as i, coalesce(base.path, ends.path) as path, status, changed, last_gone, last_size,
    status is not null and case when status = 'pending' then removed is not null else coalesce(removed > changed, false) end as taken
  from base full join ends on base.i = ends.i and base.path = ends.path),
now as (select i, path, case when status is null or taken or changed is not null then 'pending' else status end as status,
    case when status is null or taken or changed is not null then last_size else 1 end as size_bytes
  from met where not ((status is null or taken) and last_gone)),
moved as ((select i, path, status, size_bytes from now where i >= 0 except select i + 1, path, status, size_bytes from now)
  union all (select i + 1, path, status, size_bytes from now where i < 4 except select i, path, status, size_bytes from now))
select 'row' as kind, path, status, size_bytes from now where i = 4 union all select distinct 'changed', 'batch ' || i, null, null from moved""")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks after file events that arrive in parts, and a notification for each part that changed any:
    upserts, and removals of pending ones. The last part says again what is known."""
    rows = tracks(spark, sf_dir, F.lit(1).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime"))
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("modify")
    path = F.concat(F.lit("p"), (F.col("event_id") % 900).cast("string"))
    events = quarters(table(spark, sf_dir, "events")).select(path.alias("path"), kind.alias("kind"), (F.col("event_id") % 2).alias("size_bytes"), F.lit(0).cast("long").alias("mtime"), "event_id", "part")
    known = rows.where("status = 'filed' and id >= 900")
    events = events.unionByName(known.select("path", F.lit("modify").alias("kind"), F.lit(1).cast("long").alias("size_bytes"), "mtime", (F.col("id") + 1_000_000_000).alias("event_id"), F.lit(PARTS).alias("part")))
    told: list[int] = []
    with scratch(spark) as keep, workspace(spark, "stream-state") as at:
        store = BucketStore(spark, f"{at}/state", rows.schema, ["path"], counter="id")
        store.write(rows)
        for stream in arriving(events, f"{at}/events", F.col("part"), PARTS + 1):
            step: Callable = lambda before, batch: state.apply_events(before, batch, "event_id", store.largest())
            watch.apply_batches(stream, store, step, f"{at}/log", lambda number, _: told.append(number)).awaitTermination()
        notes = spark.createDataFrame([("changed", f"batch {n}", None, None) for n in told], "kind string, path string, status string, size_bytes long")
        return keep(store.read().select(F.lit("row").alias("kind"), "path", "status", "size_bytes").unionByName(notes), "state")


@query("SM5 JN11 JN12", f"""
with recursive alive as (select * from ({TIMED_SQL}) where duration is not null and not (id % 10 = 0 and id % 3 <> 2)),
e as (select a.id as a_id, b.id as b_id from alive a join alive b on a.id < b.id and abs(a.duration - b.duration) <= 0.002 and a.p = b.p), {COMPONENTS_SQL}
select id, component from c""")
def stepped_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups after three batches: new rows, new rows, and new and gone rows together."""
    rows = timed(spark, sf_dir).where("duration is not null").select("id", F.col("duration").alias("value"), F.col("p").alias("content"))
    come = rows.withColumn("part", (F.col("id") % 3).cast("int")).withColumn("gone", F.lit(False))
    go = rows.where("id % 10 = 0 and id % 3 <> 2").withColumn("part", F.lit(2)).withColumn("gone", F.lit(True))
    changes = come.unionByName(go)
    n, classes = come.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("value", "content"))).first()
    with scratch(spark) as keep, workspace(spark, "stepped-duplicates") as at:
        index = ClassIndex(spark, f"{at}/index", "string", 0.002, lambda a, b: F.when(a == b, 1.0).otherwise(0.0), buckets=buckets_for(n), class_buckets=buckets_for(classes))
        for stream in arriving(changes, f"{at}/changes", F.col("part"), 3):
            stream.writeStream.foreachBatch(lambda batch, number: index.apply(batch, number + 1)).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return keep(index.groups(), "groups")


QUIET_SQL = """
x as (select *, epoch_ms(ts) as ms, epoch_ms(ts) - lag(epoch_ms(ts)) over (partition by user_id, event_type order by epoch_ms(ts), event_id) > {quiet} as starts from events),
runs as (select *, coalesce(sum(starts::int) over (partition by user_id, event_type order by ms, event_id), 0) as run from x),
lasts as (select user_id, event_type, max(ms) as ms, arg_max(event_id, (ms, event_id)) as event_id, count(*)::bigint as n from runs group by user_id, event_type, run)"""
HOUR, WEEK = 3_600_000, 7 * 24 * 3_600_000


def quiet_runs(spark: SparkSession, sf_dir: str, milliseconds: int, end: Column) -> DataFrame:
    """What fell quiet until an hour before `end`, the time of a last event under no user; events come at most an hour late."""
    events = quarters(table(spark, sf_dir, "events")).select("event_id", "ts", "user_id", "event_type", "part")
    marker = events.agg(F.lit(-1).cast("long").alias("event_id"), end.alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(PARTS).alias("part"))
    rows = events.unionByName(marker.where("ts is not null"))
    with scratch(spark) as keep, workspace(spark, "stream-quiet") as at:
        runs = quiet.QuietBatches(spark, f"{at}/state", rows, ["user_id", "event_type"], "ts", ["event_id"], milliseconds, HOUR)
        for stream in arriving(rows, f"{at}/events", F.col("part"), PARTS + 1):
            stream.writeStream.foreachBatch(runs.apply).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return keep(runs.gone().select("user_id", "event_type", "event_id", "n"), "quiet")


@query("SM1", f"with {QUIET_SQL.format(quiet=HOUR)} select user_id, event_type, event_id, n from lasts")
def stream_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each run of a user's events of one type that follow within an hour."""
    return quiet_runs(spark, sf_dir, HOUR, F.max("ts") + F.expr("interval 3 hours"))


@query("SM6", f"with {QUIET_SQL.format(quiet=WEEK)} select user_id, event_type, event_id, n from lasts where (select max(epoch_ms(ts)) from events) - ms > {WEEK}")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user left a week or more before the last event, or before coming back: past its retention."""
    return quiet_runs(spark, sf_dir, WEEK, F.max("ts") + F.expr("interval 1 hour"))


@query("SK1 SK29 SM3", """
with t as (select o_orderkey as id, 'p' || o_orderkey as path, o_custkey as size_bytes, case when o_orderkey % 4 = 0 then 'pending' else 'filed' end as status, 'ok' as verdict, 'r' as report_json from orders where o_orderkey % 3 <> 0),
l as (select 'p' || o_orderkey as path, case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as size_bytes from orders where o_orderkey % 2 = 0),
a as (select t.path, coalesce(l.size_bytes, t.size_bytes)::bigint as size_bytes, case when l.size_bytes <> t.size_bytes then 'pending' else status end as status, verdict,
  case when l.size_bytes <> t.size_bytes then null else report_json end as report_json from t left join l using (path)
  union all select path, size_bytes, 'pending', null, null from l where path not in (select path from t))
select * from a where not (status = 'pending' and substr(path, 2)::bigint % 5 = 0)""")
def stored_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after two batches: a listing's upserts, then pending-only removals by path."""
    orders = table(spark, sf_dir, "orders")
    path, size = F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey")
    none = F.lit(0).cast("long").alias("mtime")
    rows = orders.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("id"), path, size.alias("size_bytes"), none, F.when(F.col("o_orderkey") % 4 == 0, "pending").otherwise("filed").alias("status"), F.lit("ok").alias("verdict"), F.lit("r").alias("report_json"),
    )
    listing = orders.where("o_orderkey % 2 = 0").select(path, F.when(F.col("o_orderkey") % 7 == 0, size + 1).otherwise(size).alias("size_bytes"), none)
    gone = orders.where("o_orderkey % 5 = 0").select(path)
    with scratch(spark) as keep, workspace(spark, "stored-upserts") as at:
        store = BucketStore(spark, at, rows.schema, ["path"], counter="id")
        store.write(rows)
        store.apply(listing, lambda before, given: state.upsert_files(before, given, store.largest()), 1)
        store.apply(gone, lambda before, given: before.join(given.withColumn("_gone", F.lit(True)), "path", "left").where("_gone is null or status <> 'pending'").drop("_gone"), 2)
        return keep(store.read().select("path", "size_bytes", "status", "verdict", "report_json"), "stored-upserts")
