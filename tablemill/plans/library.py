"""The library's upkeep: listings, caches, settings, sources, transitions and shaping of rows.
Orders stand for tracks, events for actions, suppliers for sources, regions for settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions import text
from tablemill.operators import aggregates, filters, state
from tablemill.plans.base import query
from tablemill.sources import catalogues, files
from tablemill.storage import table

STATUS = {"O": "pending", "F": "filed", "P": "resourcing"}
TRACKS_SQL = "select o_orderkey as id, 'p' || o_orderkey as path, case o_orderstatus when 'O' then 'pending' when 'F' then 'filed' else 'resourcing' end as status from orders"


def tracks(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    status = F.element_at(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair)), F.col("o_orderstatus"))
    path = F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), path.alias("path"), status.alias("status"), *more)


@query("SC2", "select * from (values ('benchmark.parquet'), ('conversations.parquet'), ('customer.parquet'), ('documents.parquet'), ('embeddings.parquet'), ('events.parquet'), ('labels.parquet'), ('lineitem.parquet'), ('nation.parquet'), ('orders.parquet'), ('pages.parquet'), ('part.parquet'), ('region.parquet'), ('supplier.parquet')) t(filename)")
def volume_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder's own files (parts of one stored table count as that table)."""
    found = files.listing(spark, sf_dir, audio_only=False).where(F.lower("filename").endswith(".parquet") & (F.col("size_bytes") > 0))
    parent = F.regexp_extract("path", r"/([^/]+\.parquet)/[^/]+$", 1)
    return found.select(F.when(parent != "", parent).otherwise(F.col("filename")).alias("filename")).distinct()


FILES_SQL = """select doc_id, source || '/' || doc_id || case doc_id % 6 when 0 then '.MP3' when 1 then '.flac' when 2 then '.txt' when 3 then '' when 4 then '.Aiff' else '.ogg.part' end as path, n_chars from documents"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*map(F.lit, (".MP3", ".flac", ".txt", "", ".Aiff", ".ogg.part")))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.get(endings, (F.col("doc_id") % 6).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "n_chars")


@query("SC1 SC5", f"""
with f as ({FILES_SQL}), e as (select *, lower(regexp_extract(path, '/[^/]+(\\.[^./]+)$', 1)) as ext from f)
select doc_id, path, case when ext in ('.flac', '.wav', '.aif', '.aiff') then 'lossless' else 'lossy' end as rail from e where ext in ('.mp3', '.flac', '.wav', '.aif', '.aiff', '.m4a', '.aac', '.ogg', '.opus')""")
def audio_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio files of a listing by extension, and the rail that each declares."""
    rows = listed(spark, sf_dir)
    return rows.where(files.is_audio(F.col("path"))).select("doc_id", "path", files.declared_rail(F.col("path")).alias("rail"))


@query("SC16", f"""
with t as ({TRACKS_SQL}), g as (select 'p' || (page_id * 3) as path from pages union select 'q' || page_id from pages where page_id % 5 = 0)
select path, 'pending' as status from g where path not in (select path from t)""")
def loose_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose files whose path is not known yet come in as pending; known ones are no change."""
    pages = table(spark, sf_dir, "pages")
    given = pages.select(F.concat(F.lit("p"), (F.col("page_id") * 3).cast("string")).alias("path")).union(pages.where("page_id % 5 = 0").select(F.concat(F.lit("q"), F.col("page_id").cast("string"))))
    return given.distinct().join(tracks(spark, sf_dir).select("path"), "path", "left_anti").select("path", F.lit("pending").alias("status"))


@query("SC8 JN20", """
with e as (select l_orderkey, l_partkey, count(*)::bigint as times from lineitem group by 1, 2 having count(*) > 1)
select e.l_orderkey, e.l_partkey, times, coalesce(o_orderpriority, '?') as playlist, p_name as track from e left join orders on o_orderkey = l_orderkey and o_orderkey % 4 <> 0 left join part on p_partkey = l_partkey and p_partkey % 3 <> 0""")
def named_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate playlist entries with the names of playlist and track where they are known."""
    twice = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("times")).where("times > 1")
    names = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    parts = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("track"))
    met = twice.join(names, "l_orderkey", "left").join(parts, "l_partkey", "left")
    return met.select("l_orderkey", "l_partkey", "times", F.coalesce("o_orderpriority", F.lit("?")).alias("playlist"), "track")


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))


@query("SC12 SK22", """
with s as (select r_name as key, case when r_name = 'ASIA' then 'new' else r_regionkey::varchar end as value from region union all select 'theme', 'dark'),
w as (select unnest(['ASIA', 'AFRICA', 'theme', 'absent']) as key)
select key, coalesce(value, 'fallback') as value from w left join s using (key)""")
def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings after writes, read with a default."""
    given = spark.createDataFrame([("ASIA", "new"), ("theme", "dark")], "key string, value string")
    wanted = spark.createDataFrame([("ASIA",), ("AFRICA",), ("theme",), ("absent",)], "key string")
    after = state.set_values(settings(spark, sf_dir), given, "key")
    return wanted.join(after, "key", "left").select("key", F.coalesce("value", F.lit("fallback")).alias("value"))


CACHE_SQL = "select s_suppkey as volume, s_suppkey % 3 as version, case when s_suppkey % 4 = 0 then 100 else 90 end as free_bytes, case when s_suppkey % 5 = 0 then null when s_suppkey % 5 = 1 then '' else '{\"bytes\": ' || (s_suppkey * 10) || '}' end as body from supplier where s_suppkey % 7 <> 0"


def usage_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "").otherwise(F.concat(F.lit('{"bytes": '), (k * 10).cast("string"), F.lit("}")))
    return table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(k.alias("volume"), (k % 3).alias("version"), F.when(k % 4 == 0, 100).otherwise(90).alias("free_bytes"), body.alias("body"))


@query("SC13 FJ1", f"""
with c as ({CACHE_SQL})
select volume, (json_extract_string(nullif(body, ''), '$.bytes'))::bigint as bytes, 0::bigint as file_count from c where version = 1 and free_bytes = 90 and nullif(body, '') is not null""")
def usage_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached usages of the current version while the free bytes are the same; fields that the
    stored JSON lacks have their defaults."""
    parsed = F.from_json("body", "bytes long, file_count long")
    rows = usage_cache(spark, sf_dir).where("version = 1 and free_bytes = 90").withColumn("p", parsed).where("p.bytes is not null")
    return rows.select("volume", F.col("p.bytes").alias("bytes"), F.coalesce("p.file_count", F.lit(0).cast("long")).alias("file_count"))


@query("SK16 FD2", """
with old as (select s_suppkey as volume, 1 as version, 0::bigint as stamp from supplier where s_suppkey % 2 = 0), new as (select s_suppkey as volume, 2 as version, epoch(timestamp '2024-02-01 00:00:00')::bigint as stamp from supplier where s_suppkey % 3 = 0)
select volume, version, stamp from old where volume not in (select volume from new) union all select * from new""")
def usage_cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries after writes by key, stamped in epoch seconds."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("volume"))
    old = suppliers.where("volume % 2 = 0").select("volume", F.lit(1).alias("version"), F.lit(0).cast("long").alias("stamp"))
    new = suppliers.where("volume % 3 = 0").select("volume", F.lit(2).alias("version"), F.unix_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("stamp"))
    return state.set_values(old, new, "volume")


@query("SC14 SK28", f"""
with c as ({CACHE_SQL}), k as (select s_suppkey as volume from supplier)
select k.volume, case when c.version = 1 and nullif(c.body, '') is not null then c.body else 'computed ' || k.volume end as body from k left join c using (volume)""")
def report_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from the cache where it is current and not empty; only the others are computed."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("volume"))

    def compute(misses: DataFrame) -> DataFrame:
        return misses.withColumn("body", F.concat(F.lit("computed "), F.col("volume").cast("string")))

    return state.read_through(keys, usage_cache(spark, sf_dir), "volume", "body", 1, compute)


@query("SC15", r"""
with l as (select page_id, case when page_id % 3 = 0 then 'lossy;320;' || page_id || '.5;ok;-;-3;;' else 'lossless;-;' || page_id || ';fake;320;;-9;' end || url || ';x' as line from pages)
select page_id, string_split(line, ';')[1] as rail, try_cast(nullif(string_split(line, ';')[2], '-') as double) as bitrate, try_cast(string_split(line, ';')[3] as double) as cutoff, url || ';x' as file
from l join pages using (page_id)""")
def semicolon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a semicolon table whose last field may hold semicolons itself."""
    k = F.col("page_id").cast("string")
    head = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("lossy;320;"), k, F.lit(".5;ok;-;-3;;"))).otherwise(F.concat(F.lit("lossless;-;"), k, F.lit(";fake;320;;-9;")))
    lines = table(spark, sf_dir, "pages").select("page_id", F.concat(head, "url", F.lit(";x")).alias("value"))
    return lines.select("page_id", files.measured_fields(F.col("value")).alias("m")).select("page_id", "m.rail", "m.bitrate", "m.cutoff", "m.file")


RESULTS_SQL = """select s_suppkey, s_suppkey % 4 as n from supplier"""


@query("SC10 FJ3 FS24", """
select s_suppkey, 0::int as pos, case when s_suppkey % 3 = 0 then 'Band ' || s_suppkey else 'Band ' || s_suppkey || ' Two' end as artist, 'Song' as title, case when s_suppkey % 2 = 0 then 'Label' end as label,
  case when s_suppkey % 4 = 0 then null else (1990 + s_suppkey % 9) end::bigint as year from supplier""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of JSON search responses: empty titles skipped, first label that is not empty,
    years as numbers, stars and numbers in parentheses taken off artists."""
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("*Band "), k.cast("string"), F.lit("* (7)"))).otherwise(F.concat(F.lit("Band "), k.cast("string"), F.lit(" Two (12)")))
    labels = F.when(k % 2 == 0, F.array(F.lit(""), F.lit("Label"), F.lit("Other"))).otherwise(F.array(F.lit("")))
    year = F.when(k % 4 == 0, "unknown").otherwise((1990 + k % 9).cast("string"))
    result = F.struct(F.concat(name, F.lit(" - Song")).alias("title"), year.alias("year"), labels.alias("label"), k.alias("id"))
    empty = F.struct(F.lit("").alias("title"), F.lit("1").alias("year"), labels.alias("label"), k.alias("id"))
    body = F.to_json(F.struct(F.array(result, empty).alias("results")))
    found = catalogues.candidates(table(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body")), "s_suppkey", "body")
    return found.select("s_suppkey", "pos", "artist", "title", "label", "year")


@query("SC6", "select s_suppkey as track_id, '/music/' || s_name || ' 100%.mp3' as path from supplier")
def collection_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an exported collection with their local paths."""
    entry = F.concat(F.lit('<TRACK TrackID="'), F.col("s_suppkey").cast("string"), F.lit('" Location="file://localhost/music/'), F.replace("s_name", F.lit("#"), F.lit("%23")), F.lit(' 100%25.mp3"/>'))
    parsed = F.from_xml(entry, "_TrackID long, _Location string")
    rows = table(spark, sf_dir, "supplier").select(parsed.alias("t"))
    return rows.select(F.col("t._TrackID").alias("track_id"), F.concat(F.lit("/"), catalogues.local_path(F.col("t._Location"))).alias("path"))


@query("SK3 SK4 SK2", f"""
with t as (select id, status, case when id % 2 = 0 then 'ok' end as verdict, 'r' as report_json, id % 3 as attempts from ({TRACKS_SQL})),
f as (select *, id % 10 = 1 as failed, id % 10 = 2 and status = 'pending' as reset from t)
select id, case when failed or reset then null else verdict end as verdict, case when failed then '' when reset then null else report_json end as report_json,
  case when failed then attempts + 1 when reset then 0 else attempts end::int as analysis_attempts from f""")
def failures_and_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed analyses leave an empty report and one attempt more; resets of pending tracks, none."""
    k = F.col("o_orderkey")
    rows = tracks(spark, sf_dir, F.when(k % 2 == 0, "ok").alias("verdict"), F.lit("r").alias("report_json"), (k % 3).cast("int").alias("analysis_attempts"), F.lit(1).alias("analyzed_at"), F.lit("f").alias("fingerprint"))
    ids = rows.select("id")
    failed = state.persist_failures(rows, ids.where("id % 10 = 1"), ["verdict", "analyzed_at", "fingerprint"])
    return state.reset_analysis(failed, ids.where("id % 10 = 2")).select("id", "verdict", "report_json", "analysis_attempts")


@query("SK7 JN7", """
with a as (select event_id as id, event_id % 97 as track_id, event_type as type from events where event_id % 5 = 0), s as (select max(r_regionkey::varchar) as v from region where r_name = 'ASIA'), m as (select max(id) as top from a)
select count(*)::bigint as n, max(id)::bigint as last_id, count(distinct id)::bigint as ids, count(*) filter (session = (select v from s))::bigint as in_session from (
  select id, null as session from a union all select (select top from m) + row_number() over (order by s_suppkey), (select v from s) from supplier)""")
def appended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal rows with the session of the settings table, read once for all."""
    actions = table(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("id"), (F.col("event_id") % 97).alias("track_id"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("session_id"))
    given = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_id"), F.lit("file").alias("type"))
    out = state.append_actions(actions, given, settings(spark, sf_dir), "ASIA")
    return out.agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids"), F.count("session_id").alias("in_session"))


@query("SK11 SK12 SK26", f"""
with t as ({TRACKS_SQL})
select case when id % 4 = 0 and status in ('pending', 'filed') then 'resourcing' when id % 4 = 1 and status = 'resourcing' then 'pending' else status end as status,
  count(*)::bigint as n, count(*) filter (id % 4 = 0 and status in ('pending', 'filed'))::bigint as rejected, count(*) filter (id % 4 = 1 and status = 'resourcing')::bigint as requeued from t group by 1""")
def rejects_and_requeues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected tracks with their journal rows, then requeued ones, whose live rejects are undone."""
    rows = tracks(spark, sf_dir)
    actions = spark.createDataFrame([], "id long, track_id long, type string, from_path string, undone boolean")
    past = rows.where("id % 4 = 1 and status = 'resourcing'").select(F.col("id").alias("track_id"), F.lit("reject").alias("type"), F.col("path").alias("from_path"), F.lit(False).alias("undone"))
    actions = actions.unionByName(state.with_new_ids(past, actions, "id", F.col("track_id")).select("id", "track_id", "type", "from_path", "undone"))
    moved, actions = state.move_tracks(rows, actions, rows.where("id % 4 = 0").select("id"), "reject", "resourcing", ["pending", "filed"])
    back, actions = state.requeue(moved, actions, rows.where("id % 4 = 1").select("id"))
    # A track has one journal row here, so both flags come by one join.
    flags = actions.select(F.col("track_id").alias("id"), F.when(F.expr("type = 'reject' and not undone"), 1).alias("rejected"), F.when(F.col("undone"), 1).alias("requeued"))
    met = back.join(flags, "id", "left")
    return met.groupBy("status").agg(F.count("*").alias("n"), F.count("rejected").alias("rejected"), F.count("requeued").alias("requeued"))


@query("SK13", """
select event_id as id, case when event_id % 9 = 0 then 'closed' when event_id % 7 > 3 then 'kept' when event_id % 2 = 0 then 'purged' else 'failed' end as outcome from events where event_type = 'error'""")
def trash_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    trash = table(spark, sf_dir, "events").where("event_type = 'error'").select(k.alias("id"), F.when(k % 9 != 0, k).alias("track_id"))
    removed = trash.where("track_id is not null and id % 7 <= 3").select("track_id", (F.col("id") % 2 == 0).alias("ok"))
    return state.purge_trash(trash, removed)


@query("SK21", """
with g as (select distinct regexp_replace(case when c_custkey % 2 = 0 then 'Supplier#' || lpad((c_custkey % 50)::varchar, 9, '0') || '/' else 'Folder' || (c_custkey % 40) end, '(.)/+$', '\\1') as path from customer)
select path, s_suppkey is null as fresh from g left join supplier on s_name = path""")
def added_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by canonical path: insert or ignore."""
    k = F.col("c_custkey")
    path = F.when(k % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 50).cast("string"), 9, "0"), F.lit("/"))).otherwise(F.concat(F.lit("Folder"), (k % 40).cast("string")))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"))
    return state.add_sources(sources, table(spark, sf_dir, "customer").select(path.alias("path"))).select("path", "fresh")


@query("SK21", """
with s as (select s_suppkey as id, case when s_suppkey % 2 = 0 then 'red' end as colour, s_suppkey % 3 = 0 as given, case s_suppkey % 4 when 0 then 'blue' when 1 then 'pink' when 2 then null else 'green' end as wanted from supplier)
select id, case when given and (wanted is null or wanted <> 'pink') then wanted else colour end as colour, case when not given then 'untouched' when wanted = 'pink' then 'refused' else 'set' end as outcome from s""")
def source_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of a five-value domain."""
    k = F.col("id")
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).withColumn("colour", F.when(k % 2 == 0, "red"))
    wanted = F.when(k % 4 == 0, "blue").when(k % 4 == 1, "pink").when(k % 4 == 3, "green")
    return state.set_colours(sources, sources.where("id % 3 = 0").select("id", wanted.alias("colour")), ["red", "orange", "yellow", "green", "blue"])


@query("JN25 SK21", f"""
with t as ({TRACKS_SQL}), lost as (select id from t where id % 6 = 0)
select (select count(*) from supplier where s_suppkey % 6 <> 0)::bigint as sources, (select count(*) from t where id % 6 <> 0)::bigint as tracks,
  (select count(*) from lineitem where l_orderkey not in (select id from lost))::bigint as children, (select count(*) from events where event_id in (select id from t) and event_id not in (select id from lost))::bigint as linked_actions""")
def deleted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources deleted with their tracks and children; journal rows lose their track only."""
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    rows = tracks(spark, sf_dir, (F.col("o_orderkey") % 6).alias("rest")).withColumn("source_id", F.when(F.col("rest") == 0, F.lit(-1)).otherwise(F.lit(-2)).cast("long"))
    marked = sources.union(spark.createDataFrame([(-1,)], "id long"))
    children = {"genres": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track_id"), "l_linenumber")}
    journal = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("track_id")).join(rows.select(F.col("id").alias("track_id")), "track_id", "left_semi")
    gone = marked.where("id = -1 or id % 6 = 0")
    left, kept, lists, after = state.delete_sources(marked, rows, children, journal.select("id", "track_id"), gone)
    one = left.agg(F.count("*").alias("sources")).join(F.broadcast(kept.agg(F.count("*").alias("tracks"))))
    return one.join(F.broadcast(lists["genres"].agg(F.count("*").alias("children")))).join(F.broadcast(after.agg(F.count("track_id").alias("linked_actions"))))


@query("SK18", """
with c as (select lower(p_name) as k, count(*) as n from part where p_partkey % 3 <> 0 group by 1), w as (select distinct lower(p_name) as k from part union select 'absent ' || s_suppkey from supplier)
select w.k, case when coalesce(n, 0) = 0 then 'not-tracked' when n = 1 then 'patched' else 'drifted' end as outcome from w left join c using (k)""")
def path_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a path to be patched in an exported catalogue."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("k"))
    wanted = names.select("k").union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("absent "), F.col("s_suppkey").cast("string")))).distinct()
    return state.patch_outcomes(wanted, names.where("p_partkey % 3 <> 0").select("k"), "k")


@query("SK19", """
select event_id, case when json_extract_string(props, '$.k') is not null and (json_extract_string(props, '$.k'))::bigint < 50 then 2 else 1 end as version,
  case when json_extract_string(props, '$.k') is not null and (json_extract_string(props, '$.k'))::bigint < 50 then null else event_type end as verdict from events""")
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration's backfill: rows that a JSON path selects get the new version and lose their verdict."""
    old = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint") < 50, F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", F.when(old, 2).otherwise(1).alias("version"), F.when(~old, F.col("event_type")).alias("verdict"))


@query("SM10", """
select s_suppkey as id, (s_suppkey % 4 + (s_suppkey % 2 = 0)::int)::int as attempts, case when s_suppkey % 4 + (s_suppkey % 2 = 0)::int >= 3 then 'terminal' when s_suppkey % 4 + (s_suppkey % 2 = 0)::int > 0 then 'due' else 'new' end as state from supplier""")
def retry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).cast("int").alias("attempts"))
    return state.retried(rows, rows.where("id % 2 = 0"), 3)


@query("SM7", """
select o_orderstatus as status, count(*)::bigint as n, max(o_orderkey)::bigint as newest, (count(*) <> 100 or max(o_orderkey) <> 100) as stale from orders group by 1""")
def cache_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures (rows, newest) of cached selections, and whether a cached one is stale."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))
    return found.withColumn("stale", (F.col("n") != 100) | (F.col("newest") != 100))


@query("PF10 PF26", """
select event_id, user_id from events where user_id = 13 and event_type = 'error' union all select event_id, user_id from events where event_id = 7""")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional parameters, one of them absent, and a lookup by key."""
    events = table(spark, sf_dir, "events")

    def asked(user: int | None, kind: str | None, key: int | None) -> DataFrame:
        given = (filters.optional_equals(F.col(c), v) for c, v in (("user_id", user), ("event_type", kind), ("event_id", key)))
        return events.where(filters.all_of(*given)).select("event_id", "user_id")

    return asked(13, "error", None).unionAll(asked(None, None, 7))


@query("PF13", """
select l_orderkey, l_linenumber, coalesce(l_quantity > 0 and abs(l_quantity - l_extendedprice / 1000) > 1.0, false) as mismatch from lineitem""")
def duration_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against decoded durations more than a second apart, where there is a decoded one."""
    found = filters.duration_mismatch(F.col("l_extendedprice") / 1000, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("mismatch"))


@query("PF15 PF20", """
select doc_id from documents where contains(lower(text), '100%') or contains(lower(source), '100%') or contains(lower(text), 'über_') union select doc_id from documents where contains(lower(source), 'c1')""")
def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts are literal, not patterns, and override the toggle beside them."""
    docs = table(spark, sf_dir, "documents")
    fields = (F.col("text"), F.col("source"))
    hits = filters.any_of(*(filters.queue_search(needle, F.col("n_chars") < 0, *fields) for needle in ("100%", "über_")))
    return docs.where(hits | filters.queue_search("c1", F.col("n_chars") < 0, F.col("source"))).select("doc_id")


@query("PF21 PF23 PF24", """
with s as (select p_partkey, case p_partkey % 4 when 0 then '' else p_brand end as artist, case p_partkey % 3 when 0 then '' else p_name end as title, 'in/' || p_type || ' - ' || p_name || '.mp3' as path from part)
select p_partkey, case when artist <> '' and title <> '' then artist || ' — ' || title else split_part(path, '/', 2) end as display,
  case when artist <> '' or title <> '' then artist else split_part(split_part(path, '/', 2), ' - ', 1) end as shown_artist, case when artist <> '' or title <> '' then title else split_part(substring(path, 1, length(path) - 4), ' - ', 2) end as shown_title from s""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for display, and identities: stored if either field is there, else from the file name."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k, F.when(k % 4 == 0, "").otherwise(F.col("p_brand")).alias("artist"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.concat(F.lit("in/"), "p_type", F.lit(" - "), "p_name", F.lit(".mp3")).alias("path"),
    )
    who = text.stored_or_named(F.col("artist"), F.col("title"), F.col("path"))
    return rows.select("p_partkey", text.display_name(F.col("artist"), F.col("title"), F.col("path")).alias("display"), who["artist"].alias("shown_artist"), who["title"].alias("shown_title"))


@query("AG40", """
select (select count(distinct l_orderkey) from lineitem)::bigint as playlists, (select count(distinct l_partkey) from lineitem)::bigint as tracks, (select max(l_shipdate) from lineitem) > (select max(o_orderdate) from orders) as drifted""")
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists and tracks of the linked catalogue and whether it is newer than the last read."""
    lines = table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("playlists"), F.count_distinct("l_partkey").alias("tracks"), F.max("l_shipdate").alias("_there"))
    seen = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("_seen"))  # one row
    return lines.join(F.broadcast(seen)).select("playlists", "tracks", (F.col("_there") > F.col("_seen")).alias("drifted"))


@query("AG41", "select 14::bigint as tables, 6::bigint as order_columns")
def schema_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tables stand in the folder, and the width of one."""
    columns = len(table(spark, sf_dir, "orders").columns)
    return volume_listing(spark, sf_dir).agg(F.count("*").alias("tables")).withColumn("order_columns", F.lit(columns).cast("long"))


@query("FS26 FS32 FA1", r"""
with s as (select p_partkey, case when p_partkey % 2 = 0 then p_name || ' (' || p_type || ' Mix)' else p_name end as title, p_partkey * 0.77 as secs, p_partkey || ',x,' || (p_partkey + 1) || ',' as list from part)
select p_partkey, case when p_partkey % 2 = 0 then trim(regexp_extract(title, '^(.*)\(([^(]*)\)$', 1)) else title end as plain, case when p_partkey % 2 = 0 then regexp_extract(title, '^(.*)\(([^(]*)\)$', 2) end as version,
  floor(secs / 60)::bigint || ':' || lpad(round(secs - floor(secs / 60) * 60)::bigint::varchar, 2, '0') as clock, p_partkey || ',' || (p_partkey + 1) as numbers from s""")
def formatted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles split from versions, durations as m:ss, number lists without bad tokens."""
    k = F.col("p_partkey")
    title = F.when(k % 2 == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(" Mix)"))).otherwise(F.col("p_name"))
    parts = text.trailing_version(title)
    numbers = text.integer_list(F.concat(k.cast("string"), F.lit(",x,"), (k + 1).cast("string"), F.lit(",")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", parts["title"].alias("plain"), parts["version"].alias("version"), text.clock(k * F.lit(0.77)).alias("clock"),
        F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",").alias("numbers"),
    )


@query("FD1 PF11", """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, ts < timestamp '2024-02-01 00:00:00' - interval 30 day + interval 20 day as old from events""")
def cutoff_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants as UTC text, and the age limit of a given now."""
    at = F.col("ts").cast("timestamp")
    limit = F.lit("2024-02-01 00:00:00").cast("timestamp") - F.expr("interval 30 days") + F.expr("interval 20 days")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), (at < limit).alias("old"))


@query("AG19", """
select r_name as source, count(*)::bigint as playlists from region join nation on n_regionkey = r_regionkey group by 1""")
def playlist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a flattened playlist tree: regions are folders, nations the playlists in them."""
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("source"))
    leaves = table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    tree = regions.select("source", F.array("source").alias("path"), F.lit(True).alias("is_folder")).unionByName(leaves.select("source", F.array("source", "n_name").alias("path"), F.lit(False).alias("is_folder")))
    return catalogues.playlist_count(tree)


@query("SK17 JN19", f"""
with f as (select path, id % 7 as folder from ({TRACKS_SQL}) where status = 'filed'), c as (select s_suppkey as id, 'p' || (s_suppkey * 2) as path from supplier)
select f.path, f.folder, c.id as old_id, c.id is null as added, true as numbered from f left join c using (path)""")
def exported_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed tracks appended to a catalogue: known ones keep their id, others get ids of their own
    that follow the largest; doing it again adds nothing."""
    filed = tracks(spark, sf_dir).where("status = 'filed'").select("path", (F.col("id") % 7).alias("folder"))
    catalogue = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("p"), (F.col("s_suppkey") * 2).cast("string")).alias("path"))
    fresh = state.with_new_ids(filed.join(catalogue, "path", "left_anti"), catalogue, "id", F.col("path"))
    top, count = (fresh.agg(e.alias("x")) for e in (F.min("id"), F.count_distinct("id")))  # one row each
    range_ok = catalogue.agg(F.max("id").alias("largest")).join(F.broadcast(top.withColumnRenamed("x", "first"))).join(F.broadcast(count.withColumnRenamed("x", "ids"))).join(F.broadcast(fresh.agg(F.count("*").alias("rows"), F.max("id").alias("last"))))
    good = F.coalesce((F.col("first") == F.col("largest") + 1) & (F.col("ids") == F.col("rows")) & (F.col("last") == F.col("largest") + F.col("rows")), F.col("rows") == 0)
    out = filed.join(catalogue.withColumnRenamed("id", "old_id"), "path", "left").join(fresh.select("path", F.col("id").alias("new_id")), "path", "left")
    return out.join(F.broadcast(range_ok)).select("path", "folder", "old_id", F.col("old_id").isNull().alias("added"), (good & (F.col("old_id").isNull() == F.col("new_id").isNotNull())).alias("numbered"))


@query("SK27 PF17", """
with d as (select lower(trim(n_name)) as k from nation), c as (select c_custkey, case c_custkey % 5 when 0 then ' nation_3 ' when 1 then 'Nation_' || (c_custkey % 40) when 2 then '' else c_mktsegment end as name from customer),
r as (select lower(trim(name)) as k, count(*)::bigint as rows from c group by 1)
select r.k, rows, case when r.k = '' then 0 else 1 end::bigint as ids, r.k <> '' and r.k not in (select k from d) as fresh from r""")
def find_or_create_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which id every row gets: one per name without case and outer spaces, a known name's own or
    one beyond the largest; none for an empty name."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, " nation_3 ").when(k % 5 == 1, F.concat(F.lit("Nation_"), (k % 40).cast("string"))).when(k % 5 == 2, "").otherwise(F.col("c_mktsegment"))
    rows, _ = state.find_or_create(table(spark, sf_dir, "customer").select("c_custkey", name.alias("c_name")), nations, "c_name", "id", "name")
    largest = nations.agg(F.max("id").alias("largest"))  # one row
    found = rows.join(F.broadcast(largest)).groupBy(F.lower(F.trim("c_name")).alias("k"))
    return found.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.coalesce(F.min(F.col("id") > F.col("largest")), F.lit(False)).alias("fresh"))


@query("AG8 AG10 FS27", """
with f as (select case doc_id % 3 when 0 then '/' || doc_id || '.JPEG' else '/' || doc_id || '.aif' end as name, case doc_id % 4 when 0 then 'pioneer' when 1 then 'PIONEER' else 'music' end as top, n_chars from documents)
select case when lower(top) = 'pioneer' then '(export)' when name like '%.JPEG' then '.jpg' else '.aiff' end as bucket, sum(n_chars)::bigint as bytes, count(*)::bigint as file_count from f group by 1""")
def usage_with_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage where some files lie in the export folder, in any case, which is a bucket of its own."""
    k = F.col("doc_id")
    top = F.when(k % 4 == 0, "pioneer").when(k % 4 == 1, "PIONEER").otherwise("music")
    path = F.concat(top, F.lit("/"), k.cast("string"), F.when(k % 3 == 0, ".JPEG").otherwise(".aif"))
    found = aggregates.usage(table(spark, sf_dir, "documents"), text.usage_bucket(path), F.col("n_chars"))
    return found.select(F.when(F.col("bucket") == text.REKORDBOX_BUCKET, "(export)").otherwise(F.col("bucket")).alias("bucket"), "bytes", "file_count")
