"""State transitions on deterministic snapshots of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators import joins, state
from tablemill.plans.base import query
from tablemill.storage import scratch, table

STORED_SQL = "select doc_id, n_chars as size_bytes, case when doc_id % 7 = 0 then 'filed' else 'pending' end as status from documents where doc_id % 5 <> 0"
LISTED_SQL = "select doc_id, case when doc_id % 11 = 0 then n_chars + 1 else n_chars end as size_bytes from documents where doc_id % 6 <> 0"


@query("JN18 ST2 SM3", f"""
with s as ({STORED_SQL}), l as ({LISTED_SQL})
select coalesce(s.doc_id, l.doc_id) as doc_id, case when s.doc_id is null then 'added' when l.doc_id is null and status = 'pending' then 'removed' when l.doc_id is null then 'kept'
  when s.size_bytes = l.size_bytes then 'unchanged' else 'updated' end as change from l full join s on s.doc_id = l.doc_id""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    stored = docs.where("doc_id % 5 <> 0").select("doc_id", F.col("n_chars").alias("size_bytes"), F.when(F.col("doc_id") % 7 == 0, "filed").otherwise("pending").alias("status"))
    listed = docs.where("doc_id % 6 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size_bytes"))
    return joins.snapshot_diff(listed, stored, "doc_id", ["size_bytes"], F.col("status") == "pending")


@query("SK1 SK29 AG39", """
with t as (select o_orderkey as id, 'p' || o_orderkey as path, o_custkey as size_bytes, 'filed' as status, 'ok' as verdict, 'r' as report_json from orders where o_orderkey % 3 <> 0),
l as (select 'p' || o_orderkey as path, case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as size_bytes from orders where o_orderkey % 2 = 0)
select t.path, coalesce(l.size_bytes, t.size_bytes)::bigint as size_bytes, case when l.size_bytes <> t.size_bytes then 'pending' else status end as status, verdict,
  case when l.size_bytes <> t.size_bytes then null else report_json end as report_json from t left join l using (path)
union all select path, size_bytes, 'pending', null, null from l where path not in (select path from t)""")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))
    tracks = orders.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("id"), path.alias("path"), F.col("o_custkey").alias("size_bytes"), F.lit(0).cast("long").alias("mtime"),
        F.lit("filed").alias("status"), F.lit("ok").alias("verdict"), F.lit("r").alias("report_json"),
    )
    size = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    listing = orders.where("o_orderkey % 2 = 0").select(path.alias("path"), size.alias("size_bytes"), F.lit(0).cast("long").alias("mtime"))
    return state.upsert_files(tracks, listing).select("path", "size_bytes", "status", "verdict", "report_json")


@query("AG39 JN19", """
with f as (select distinct lower(trim(p_name)) as name from part where lower(trim(p_name)) not in (select lower(s_name) from supplier))
select count(*)::bigint as n, min(id)::bigint as low, max(id)::bigint as high, count(distinct id)::bigint as distinct_ids from (
  select (select max(s_suppkey) from supplier) + row_number() over (order by name) as id from f)""")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("name"))
    fresh = table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("name")).distinct().join(known, "name", "left_anti")
    out = state.with_new_ids(fresh, table(spark, sf_dir, "supplier"), "s_suppkey", F.col("name"))
    return out.agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"), F.max("s_suppkey").alias("high"), F.count_distinct("s_suppkey").alias("distinct_ids"))


@query("SK5 SK23 SK2", """
with m as (select c_custkey as track_id, c_name as artist, c_mktsegment as cover from customer where c_custkey % 2 = 0),
g as (select c_custkey as track_id, upper(c_name) as artist, case when c_custkey % 4 = 0 then 'new' end as cover from customer where c_custkey % 3 = 0)
select coalesce(m.track_id, g.track_id) as track_id, case when g.track_id is not null then g.artist else m.artist end as artist, coalesce(g.cover, m.cover) as cover from m full join g using (track_id)""")
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "track_id")
    old = rows.where("track_id % 2 = 0").select("track_id", F.col("c_name").alias("artist"), F.col("c_mktsegment").alias("cover"))
    new = rows.where("track_id % 3 = 0").select("track_id", F.upper("c_name").alias("artist"), F.when(F.col("track_id") % 4 == 0, "new").alias("cover"))
    return state.upsert_metadata(old, new, "track_id", ["artist"], ["cover"])


@query("SK6 AG17", """
with k as (select l_orderkey, l_returnflag as genre, min(l_linenumber) as ord from lineitem where l_orderkey % 2 = 1 group by 1, 2),
n as (select l_orderkey, l_linestatus as genre, min(l_linenumber + 10) as ord from lineitem where l_orderkey % 2 = 0 group by 1, 2)
select * from k union all select * from n""")
def replace_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    old = lines.groupBy("l_orderkey", F.col("l_returnflag").alias("genre")).agg(F.min("l_linenumber").alias("ord"))
    given = lines.where("l_orderkey % 2 = 0").select("l_orderkey", F.concat(F.lit(" "), "l_linestatus").alias("genre"), (F.col("l_linenumber") + 10).alias("ord"))
    return state.replace_children(old, given, "l_orderkey", "genre", "ord")


@query("FS29 SK10", """
with r as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) + (case when p_name like 'red%' then 1 else 0 end) as n from part)
select p_partkey, p_name || case when n = 1 then '' else ' (' || n || ')' end || '.mp3' as name from r""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit("mp3").alias("ext"))
    taken = rows.where("p_name like 'red%'").select("p_name", "ext", F.lit(1).alias("n")).distinct()
    with scratch(spark) as keep:
        return keep(state.unique_names(rows, taken, "p_name", "ext", "p_partkey").select("p_partkey", "name"), "names")


@query("SK24", """
select s_suppkey, case when status = 'ambiguous' and wanted = 'pending' and list_contains(string_split(candidates, ','), (s_suppkey % 7)::varchar) then 'pending'
  when status in ('pending', 'ambiguous') and wanted = 'dismissed' then 'dismissed' else status end as status,
  case when status = 'ambiguous' and wanted = 'pending' and list_contains(string_split(candidates, ','), (s_suppkey % 7)::varchar) then (s_suppkey % 7)::varchar else candidates end as candidates
from (select s_suppkey, case s_suppkey % 3 when 0 then 'pending' when 1 then 'ambiguous' else 'applied' end as status, '1,2,3' as candidates,
  case when s_suppkey % 5 = 0 then 'dismissed' when s_suppkey % 2 = 0 then 'pending' end as wanted from supplier)""")
def sync_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    syncs = rows.select("s_suppkey", F.when(k % 3 == 0, "pending").when(k % 3 == 1, "ambiguous").otherwise("applied").alias("status"), F.lit("1,2,3").alias("candidates"))
    requests = rows.select("s_suppkey", F.when(k % 5 == 0, "dismissed").when(k % 2 == 0, "pending").alias("wanted"), (k % 7).alias("chosen")).where("wanted is not null")
    return state.advance_syncs(syncs, requests, "s_suppkey")


@query("SK25 SM4", """
select user_id, event_type, max(event_id)::bigint as event_id, round(arg_max(value, (ts, event_id)), 2) as value from events group by 1, 2""")
def latest_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return joins.prefer(rows, ["user_id", "event_type"], -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")).select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))


@query("SK27 PF17 FS28", """
with n as (select lower(trim(c_mktsegment)) as k, min(trim(c_mktsegment)) as name from customer group by 1)
select count(*)::bigint as customers, count(distinct k)::bigint as segments, 25 + count(distinct k)::bigint as dimension_rows, count(distinct k)::bigint as ids from customer join n on lower(trim(c_mktsegment)) = k""")
def find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    rows, dimension = state.find_or_create(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), nations, "c_mktsegment", "id", "name")
    size = dimension.agg(F.count("*").alias("dimension_rows"))  # one row
    found = rows.agg(F.count("*").alias("customers"), F.count_distinct(F.lower("c_mktsegment")).alias("segments"), F.count_distinct("id").alias("ids"))
    return found.join(F.broadcast(size)).select("customers", "segments", "dimension_rows", "ids")
