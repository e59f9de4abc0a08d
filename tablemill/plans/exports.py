"""Collections exported as XML, a file a region, and read back: nations are folders, market segments
their playlists, customers the tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.plans.base import query
from tablemill.sources import catalogues
from tablemill.storage import scratch, table, workspace


def written(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """One export for each region, as text: its collection and the tree of its playlists."""
    entry = lambda name, kind, inside: F.concat(F.lit('<NODE Name="'), catalogues.escaped(name), F.lit(f'" Type="{kind}">\n'), inside, F.lit("</NODE>\n"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.concat("c_mktsegment", F.lit(' & "more" <1>')).alias("segment"))
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit('<TRACK Key="'), k.cast("string"), F.lit('"/>'))), "\n")
    songs = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit('<TRACK TrackID="'), k.cast("string"), F.lit('" Location="file://localhost/music/a%20'), k.cast("string"), F.lit('+.mp3"/>'))), "\n")
    lists = customers.groupBy("n_nationkey", "segment").agg(keys.alias("keys"), songs.alias("songs"))
    in_order = F.array_sort(F.collect_list(F.struct("segment", "keys", "songs")))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").join(lists.groupBy("n_nationkey").agg(in_order.alias("lists")), "n_nationkey", "left")
    body = F.array_join(F.transform("lists", lambda s: entry(s["segment"], 1, s["keys"])), "")
    alone = F.concat(F.lit('<NODE Name="'), catalogues.escaped(F.col("n_name")), F.lit('" Type="1"/>\n'))
    nations = nations.select("n_regionkey", F.when(F.col("lists").isNull(), alone).otherwise(entry(F.col("n_name"), 0, body)).alias("node"), F.array_join(F.coalesce("lists.songs", F.array().cast("array<string>")), "\n").alias("songs"), "n_name")
    regions = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "node", "songs"))).alias("n"))
    whole = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<DJ_PLAYLISTS Version="1.0.0">\n<COLLECTION>\n'), F.array_join("n.songs", "\n"), F.lit('\n</COLLECTION>\n<PLAYLISTS>\n<NODE Type="0" Name="ROOT">\n'),
        F.array_join("n.node", ""), F.lit("</NODE>\n</PLAYLISTS>\n</DJ_PLAYLISTS>"),
    )
    regions.select("n_regionkey", whole.alias("value")).write.partitionBy("n_regionkey").text(folder)


@query("SC6 SK17 AG19", """
with c as (select n_regionkey as region, n_name, c_mktsegment || ' & "more" <1>' as segment, c_custkey from customer join nation on n_nationkey = c_nationkey)
select n_regionkey as region, n_name as path, exists (select 1 from c where c.n_name = nation.n_name) as is_folder, 0::bigint as tracks, null::bigint as first, null::bigint as last, 1::int as depth from nation
union all select region, n_name || '/' || segment, false, count(*)::bigint, min(c_custkey)::bigint, max(c_custkey)::bigint, 2 from c group by region, n_name, segment""")
def exported_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The playlists of the exports with their paths."""
    with scratch(spark) as keep, workspace(spark, "exports") as at:
        written(spark, sf_dir, at)
        tree = catalogues.playlists(spark, f"{at}/*/*.txt")
        region = F.regexp_extract("source", r"n_regionkey=(\d+)", 1).cast("int").alias("region")
        ids = F.col("track_ids")
        return keep(tree.select(
            region, F.array_join("path", "/").alias("path"), "is_folder", F.size(ids).cast("long").alias("tracks"), F.get(ids, F.lit(0)).alias("first"),
            F.when(F.size(ids) > 0, F.element_at(ids, -1)).alias("last"), "depth",
        ), "exported-playlists")


@query("SC6 SK18", "select c_custkey as track_id, '/music/a ' || c_custkey || '+.mp3' as path from customer")
def exported_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of the exports by their rows, with local paths."""
    with scratch(spark) as keep, workspace(spark, "exports") as at:
        written(spark, sf_dir, at)
        found = catalogues.collection(spark, f"{at}/*/*.txt")
        return keep(found.select("track_id", F.concat(F.lit("/"), catalogues.local_path(F.col("location"))).alias("path")), "exported-tracks")
