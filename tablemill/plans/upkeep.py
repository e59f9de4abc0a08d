"""What keeps a catalogue current: cached results and reports, progress, listings of folders, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators import state
from tablemill.operators.cache import ResultCache, signature
from tablemill.plans.base import query
from tablemill.plans.library import volume_listing
from tablemill.plans.streams import PARTS, arriving, quarters
from tablemill.sources import files, wav
from tablemill.storage import scratch, table, workspace
from tablemill.streaming.watch import ProgressEvery


@query("SM7 AG5", """
with o as (select o_orderstatus as status, o_orderkey from orders), c as (select unnest([1, 2, 3, 4, 5]) as call)
select call, call in (1, 3, 5) as computed, status, count(*)::bigint as n, max(o_orderkey)::bigint as newest
from (select call, status, o_orderkey from c, o union all select call, status, o_orderkey + 1000000 from c, o where call >= 3 and o_orderkey % 10 = 0) group by 1, 2, 3""")
def cached_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five calls of a cached aggregate of a stored table: the first computes it, the second reads what is stored; the third
    comes after rows were added, the fourth reads again, the fifth comes after the cache was told to forget."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey")
    with scratch(spark) as keep, workspace(spark, "cached-counts") as at:
        base, cache = f"{at}/orders", ResultCache(spark, f"{at}/cache")
        rows.write.parquet(base)
        calls = []

        def call(number: int) -> None:
            found, computed = cache.get("counts", signature(spark, base), lambda: spark.read.parquet(base).groupBy("status").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest")))
            calls.append(keep(found.select(F.lit(number).alias("call"), F.lit(computed).alias("computed"), "status", "n", "newest"), "call"))

        call(1), call(2)
        rows.where("o_orderkey % 10 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000).write.mode("append").parquet(base)
        call(3), call(4)
        cache.invalidate("counts")
        call(5)
        out = calls[0]
        for other in calls[1:]:
            out = out.unionByName(other)
        return out


REPORTS_SQL = """select p_partkey as id, p_partkey % 2 as version, case p_partkey % 6 when 0 then '{"grid": [' || p_partkey || ', 2], "v": 1}' when 1 then '{"grid": [], "v": 1}' when 2 then '{"grid": [1' when 3 then '' when 4 then null
  else '{"v": ' || p_partkey || '}' end as body from part where p_partkey % 11 <> 0"""


@query("SC14", f"""
with c as ({REPORTS_SQL} union all select id, 1, body || ' ' from ({REPORTS_SQL}) where id % 12 = 5 or id % 30 = 9),
good as (select id, min(body) as body from c where version = 1 and body <> '' and json_valid(body) and (id % 3 > 0 or json_array_length(body, '$.grid') > 0) group by 1)
select p_partkey as id, coalesce(body, 'computed ' || p_partkey) as body, body is not null as hit from part left join good on id = p_partkey""")
def parsed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from a cache where they are current, parse, and have a grid where one is asked for (every third); some keys
    stand there twice."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey")
    number = k.cast("string")
    body = (
        F.when(k % 6 == 0, F.concat(F.lit('{"grid": ['), number, F.lit(', 2], "v": 1}'))).when(k % 6 == 1, '{"grid": [], "v": 1}').when(k % 6 == 2, '{"grid": [1')
        .when(k % 6 == 3, "").when(k % 6 == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit('{"v": '), number, F.lit("}")))
    )
    cache = parts.where("p_partkey % 11 <> 0").select(k.alias("id"), (k % 2).alias("version"), body.alias("body"))
    again = cache.where("id % 12 = 5 or id % 30 = 9").select("id", F.lit(1).cast("long").alias("version"), F.concat("body", F.lit(" ")).alias("body"))
    parsed = F.from_json("body", "v long, grid array<long>, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    sound = parsed["broken"].isNull() & ((F.col("id") % 3 > 0) | (F.size(parsed["grid"]) > 0))

    def compute(misses: DataFrame) -> DataFrame:
        return misses.withColumn("body", F.concat(F.lit("computed "), F.col("id").cast("string")))

    out = state.read_through(parts.select(k.alias("id")), cache.unionByName(again), "id", "body", 1, compute, sound)
    return out.select("id", "body", (~F.startswith("body", F.lit("computed"))).alias("hit"))


@query("SM8", """
with p as (select (event_id * 4 // (max(event_id) over () + 1))::int as part from events),
c as (select part, sum(count(*)) over (order by part) as seen from p group by 1)
select seen::bigint as told from c qualify seen // 700 > coalesce(lag(seen // 700) over (order by part), 0)""")
def told_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers told while events arrive in four parts, for every 700 of them at most once a part."""
    events = quarters(table(spark, sf_dir, "events")).select("event_id", "part")
    told: list[int] = []
    listener = ProgressEvery(700, told.append)
    spark.streams.addListener(listener)
    try:
        with workspace(spark, "progress") as at:
            for n, stream in enumerate(arriving(events, f"{at}/events", F.col("part"), PARTS), 1):
                run = stream.writeStream.format("noop").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
                run.awaitTermination()
                listener.wait_for(n)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(n,) for n in told], "told long")


#: Folders that the files of a folder are dealt over, so that none of them holds very many.
FOLDERS = 256


@query("SC1", """
with f as (select doc_id, octet_length(encode(coalesce(text, ''))) + 44 as size_bytes, ['MP3', 'flac', 'txt', '', 'Aiff', 'ogg.part', 'wav', 'opus'][doc_id % 8 + 1] as ext from documents)
select doc_id || '.' || ext as filename, size_bytes::bigint as size_bytes from f where lower(ext) in ('mp3', 'flac', 'wav', 'aif', 'aiff', 'm4a', 'aac', 'ogg', 'opus')""")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio files, by extension, of a folder with two below it that documents were written to, each dealt over FOLDERS more."""
    endings = F.array(*map(F.lit, ("MP3", "flac", "txt", "", "Aiff", "ogg.part", "wav", "opus")))
    name = F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS)).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.get(endings, (F.col("doc_id") % 8).cast("int")))
    given = table(spark, sf_dir, "documents").where("doc_id is not null").select(
        name.alias("name"), F.lit(1).alias("channels"), F.lit(8000).alias("sample_rate"), F.lit(8).alias("bits"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"), F.lit(None).cast("long").alias("declared"), "doc_id",
    )
    spark.dataSource.register(wav.WavSource)
    with scratch(spark) as keep, workspace(spark, "folder") as at:
        plain = at.removeprefix("file://") if at.startswith("file:///") else at
        for folder, rest in (("one", 0), ("two/deep", 1)):
            given.where(F.col("doc_id") % 2 == rest).drop("doc_id").write.format("wav").option("path", f"{plain}/{folder}").mode("append").save()
        return keep(files.walk(spark, plain).select("filename", "size_bytes"), "listing")


@query("AG41", """
select 14::bigint as tables, max(r_regionkey)::bigint as version, count(*)::bigint as settings, (select count(*) from nation where n_regionkey not in (select r_regionkey from region))::bigint as orphans from region""")
def catalogue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tables in the folder, the version that the settings tell, and rows that refer to none."""
    settings = table(spark, sf_dir, "region")
    orphans = table(spark, sf_dir, "nation").join(settings, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").agg(F.count("*").alias("orphans"))
    told = settings.agg(F.max("r_regionkey").cast("long").alias("version"), F.count("*").alias("settings"))
    return volume_listing(spark, sf_dir).agg(F.count("*").alias("tables")).crossJoin(told).crossJoin(orphans)  # one row each
