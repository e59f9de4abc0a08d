"""The undoable journal: batches, latest live actions, retention. Events stand for actions: the
user is the batch, a value below 5 is undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.operators import joins
from tablemill.plans.base import query
from tablemill.storage import table


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("batch_id"), F.col("event_type").alias("type"), F.pmod("event_id", F.lit(97)).alias("track_id"),
        (F.col("value") < 5).alias("undone"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "value",
    )


def batches(rows: DataFrame) -> DataFrame:
    """One row per batch: its lowest action, distinct tracks, and undone only if all are."""
    return rows.groupBy("batch_id").agg(
        F.min("id").alias("first_id"), F.count_distinct("track_id").alias("tracks"), F.min(F.col("undone").cast("int")).alias("all_undone"),
        F.max(F.col("undone").cast("int")).alias("any_undone"), F.max("at").alias("last_at"),
    )


def expired(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Whole batches of `kept` older than the cutoff, neither half-reverted nor holding an action
    pinned among all `rows`."""
    newest = rows.where("not undone").groupBy("track_id").agg(F.max("id").alias("id"), F.max("value").alias("most")).where("most > 300").select("id")
    pinned = rows.where("value > 250").select("id").union(rows.where("id % 1013 = 0").select("id")).union(newest).distinct()
    held = kept.join(pinned, "id", "left_semi").select("batch_id").distinct()
    old = batches(kept).where((F.col("last_at") < 1706400000) & (F.col("all_undone") == F.col("any_undone")))
    return old.join(held, "batch_id", "left_anti").select("batch_id")


@query("JN8 AG6 SO5 WN1", """
with a as (select event_id as id, user_id as batch_id, event_type as type, event_id % 97 as track_id, value < 5 as undone from events where event_type <> 'error'),
b as (select batch_id, min(id) as first_id, count(distinct track_id)::bigint as tracks, min(undone::int)::int as all_undone from a group by 1)
select b.batch_id, first_id, type, tracks, all_undone from b join a on a.id = first_id order by first_id desc limit 100""")
def batch_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = actions(spark, sf_dir).where("type <> 'error'")
    first = rows.select(F.col("id").alias("first_id"), "type")
    return batches(rows).join(first, "first_id").select("batch_id", "first_id", "type", "tracks", "all_undone").orderBy(F.desc("first_id")).limit(100)


@query("WN2 SO6 JN23", """
select event_id % 97 as track_id, max(event_id)::bigint as id, arg_max(event_type, event_id) as type from events where value >= 5 group by 1""")
def latest_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.prefer(actions(spark, sf_dir).where("not undone").select("track_id", "id", "type"), ["track_id"], -F.col("id")).select("track_id", "id", "type")


@query("AG7 JN9 ST1 PF11 SK15 SM6", """
with a as (select event_id as id, user_id * 10000 + floor(epoch(ts) / 604800)::bigint as batch_id, event_id % 97 as track_id, value < 5 as undone, floor(epoch(ts))::bigint as sec, value from events),
pinned as (select id from a where value > 250 union select id from a where id % 1013 = 0 union select max(id) from a where not undone group by track_id having max(value) > 300),
g as (select batch_id, max(sec) as last_at, min(undone::int) as u0, max(undone::int) as u1 from a group by 1)
select g.batch_id from g where last_at < 1706400000 and u0 = u1 and not exists (select 1 from a join pinned using (id) where a.batch_id = g.batch_id)""")
def expired_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired batches where a batch is all that a user did in a week, so that every action is
    judged in exactly one batch."""
    rows = actions(spark, sf_dir)
    rows = rows.withColumn("batch_id", F.col("batch_id") * 10000 + F.floor(F.col("at") / 604800))
    return expired(rows, rows)


@query("AG7 JN9 ST1 PF11 SK15 SM6", """
with a as (select event_id as id, user_id, floor(epoch(ts) / 86400)::bigint as day, event_id % 97 as track_id, value < 5 as undone, floor(epoch(ts))::bigint as sec, value from events),
pinned as (select id from a where value > 250 union select id from a where id % 1013 = 0 union select max(id) from a where not undone group by track_id having max(value) > 300),
g as (select user_id, day, max(sec) as last_at, min(undone::int) as u0, max(undone::int) as u1 from a group by 1, 2)
select g.user_id, g.day from g where last_at < 1706400000 and u0 = u1 and not exists (select 1 from a join pinned using (id) where a.user_id = g.user_id and a.day = g.day)""")
def expired_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired batches where a batch is all that a user did in a day (UTC), so that every action
    is judged in exactly one batch."""
    rows = actions(spark, sf_dir)
    rows = rows.withColumn("batch_id", F.struct(F.col("batch_id").alias("user_id"), F.floor(F.col("at") / 86400).alias("day")))
    return expired(rows, rows).select("batch_id.user_id", "batch_id.day")


@query("WN10 SK14", """
with a as (select event_id as id, user_id as batch_id, event_id % 97 as track_id from events where value >= 5),
n as (select *, max(id) over (partition by track_id) as newest from a)
select batch_id, count(*)::bigint as live, count(*) filter (id < newest)::bigint as superseded,
  case when count(*) filter (id < newest) = 0 then 'revertible' else 'refused' end as outcome from n group by 1""")
def revert_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a batch may be undone: not where a newer live action of a track stands elsewhere."""
    live = actions(spark, sf_dir).where("not undone")
    newest = live.groupBy("track_id").agg(F.max("id").alias("newest"))
    counted = live.join(newest, "track_id").groupBy("batch_id").agg(F.count("*").alias("live"), F.count_if(F.col("id") < F.col("newest")).alias("superseded"))
    return counted.withColumn("outcome", F.when(F.col("superseded") == 0, "revertible").otherwise("refused"))


@query("AG36 FD3 FD4", """
select strftime(ts + interval 1 hour, '%Y-%m-%d') as day, user_id % 5 as session, count(*)::bigint as n, min(event_id)::bigint as first_id from events group by 1, 2""")
def day_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by local day (UTC+1) and session."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+01:00")
    return table(spark, sf_dir, "events").groupBy(F.date_format(local, "yyyy-MM-dd").alias("day"), (F.col("user_id") % 5).alias("session")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("AG16 WN3", """
with d as (select l_orderkey, l_partkey, l_linenumber, l_suppkey, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey) as rn,
  count(*) over (partition by l_orderkey, l_partkey) as n from lineitem)
select l_orderkey, l_partkey, l_linenumber, case when rn = 1 then 'keep' else 'remove' end as action from d where n > 1""")
def playlist_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_partkey")
    ranked = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(w.orderBy("l_linenumber", "l_suppkey")).alias("rn"), F.count("*").over(w).alias("n"),
    )
    return ranked.where("n > 1").select("l_orderkey", "l_partkey", "l_linenumber", F.when(F.col("rn") == 1, "keep").otherwise("remove").alias("action"))
