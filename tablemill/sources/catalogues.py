"""External catalogues: exported XML collections and playlists, search responses in JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions import scoring
from tablemill.storage import scratch, stash

COLLECTION = T.StructType([T.StructField("_TrackID", T.LongType()), T.StructField("_Location", T.StringType()), T.StructField("_Name", T.StringType()), T.StructField("_Artist", T.StringType())])
TEXTS = T.ArrayType(T.StringType())
RESPONSE = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("year", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("cover_image", T.StringType()), T.StructField("label", TEXTS), T.StructField("format", TEXTS), T.StructField("style", TEXTS),
])))])


def collection(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, location, name, artist) of the tracks of an XML export."""
    rows = spark.read.format("xml").option("rowTag", "TRACK").schema(COLLECTION).load(path)
    return rows.where("_Location is not null").select(F.col("_TrackID").alias("track_id"), F.col("_Location").alias("location"), F.col("_Name").alias("name"), F.col("_Artist").alias("artist"))


ROOT = "<DJ_PLAYLISTS"
REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG = rf"<NODE\b{REST}|</NODE>|<TRACK\b{REST}"


def unescaped(value: Column) -> Column:
    """An attribute's text: the five named entities and numbers of characters below 65,536 in place."""
    out = value
    for name, letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#9", "\t"), ("#10", "\n"), ("#13", "\r"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(letter))
    return out


def escaped(value: Column) -> Column:
    """A text as an attribute's value."""
    out = value
    for letter, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        out = F.replace(out, F.lit(letter), F.lit(f"&{name};"))
    return out


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag in either kind of quotes; null without it."""
    found = F.regexp_extract_all(tag, F.lit(rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""), F.lit(0))
    return unescaped(F.regexp_extract(F.get(found, F.lit(0)), r"""=\s*["'](.*)["']$""", 1))


def playlist_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(source, seq, level, parent, name, is_folder, track_ids): the nodes of each export's playlist tree in reading
    order, with the number of the node around; those of level 1 stand in the root. A file without the export's root is an error.

    The tree is told by the running number of open nodes, a window along each file's tags; a tag's node is the last
    one opened a level above it."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    checked = F.when(F.contains("value", F.lit(ROOT)), F.col("value")).otherwise(F.raise_error(F.concat(F.col("source"), F.lit(" is no export: its root is missing"))))
    tree = F.regexp_replace(F.regexp_extract(checked, r"(?s)<PLAYLISTS\b[^>]*>(.*)</PLAYLISTS>", 1), "(?s)<!--.*?-->", "")
    tags = text.select("source", F.posexplode(F.regexp_extract_all(tree, F.lit(TAG), F.lit(0))).alias("seq", "tag"))
    node, alone = F.startswith("tag", F.lit("<NODE")), F.endswith("tag", F.lit("/>"))
    step = F.when(F.col("tag") == "</NODE>", -1).when(node & ~alone, 1).otherwise(0)
    along = Window.partitionBy("source").orderBy("seq")
    deep = tags.withColumn("open", F.sum(step).over(along)).where("tag <> '</NODE>'")
    # A node's level counts itself; a track's level is its node's.
    deep = deep.withColumn("is_node", node).withColumn("level", F.when(node & alone, F.col("open") + 1).otherwise(F.col("open")))
    # Each node is told at its own level, and asks, like a track, for the last one told at the level around.
    told = deep.where("is_node").select("source", "seq", "level", F.col("seq").alias("node"), F.lit(None).cast("int").alias("asks"))
    asks = deep.select("source", "seq", F.when(F.col("is_node"), F.col("level") - 1).otherwise(F.col("level")).alias("level"), F.lit(None).cast("int").alias("node"), F.col("seq").alias("asks"))
    by_level = Window.partitionBy("source", "level").orderBy("seq", F.col("asks").isNull().cast("int"))
    around = told.unionByName(asks).withColumn("parent", F.last("node", True).over(by_level)).where("asks is not null").select("source", F.col("asks").alias("seq"), "parent")
    met = deep.join(around, ["source", "seq"])
    keys = met.where("not is_node").groupBy("source", F.col("parent").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", attribute(F.col("tag"), "Key").cast("long").alias("key")))).alias("keys"))
    nodes = met.where("is_node and level > 1").select(
        "source", "seq", (F.col("level") - 1).cast("int").alias("level"), F.when(F.col("level") > 2, F.col("parent")).alias("parent"),
        F.coalesce(attribute(F.col("tag"), "Name"), F.lit("")).alias("name"), (attribute(F.col("tag"), "Type") == "0").alias("is_folder"),
    )
    return nodes.join(keys, ["source", "seq"], "left").select("source", "seq", "level", "parent", "name", F.coalesce("is_folder", F.lit(False)).alias("is_folder"), F.coalesce(F.col("keys.key"), F.array().cast("array<long>")).alias("track_ids"))


def playlists(spark: SparkSession, path: str) -> DataFrame:
    """(source, seq, path, depth, is_folder, track_ids): the playlist tree of each export, flattened; `seq` tells the
    reading order, the root is not listed. A file without the export's root is an error. Paths are put together level by
    level, a join for each level of the deepest tree."""
    with scratch(spark) as keep:
        nodes = stash(playlist_nodes(spark, path), "nodes")
        deepest = nodes.agg(F.max("level")).first()[0] or 0
        above = nodes.where("level = 1").withColumn("path", F.array("name"))
        levels = [above]
        for level in range(2, deepest + 1):
            around = above.select("source", F.col("seq").alias("parent"), F.col("path").alias("_above"))
            above = stash(nodes.where(F.col("level") == level).join(around, ["source", "parent"]).withColumn("path", F.concat("_above", F.array("name"))).drop("_above"), "level")
            levels.append(above)
        whole = reduce(DataFrame.unionByName, levels)
        return keep(whole.select("source", "seq", "path", F.col("level").alias("depth"), "is_folder", "track_ids"), "playlists")


def playlist_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count_if(~F.col("is_folder")).alias("playlists"))


def local_path(location: Column) -> Column:
    """The path of a file URL: host dropped, percent signs decoded (a plus stays a plus)."""
    plain = F.regexp_replace(location, r"^file://localhost/?", "")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def split_artist_title(raw: Column) -> tuple[Column, Column]:
    """`Artist - Title`, the artist without a star and a number in parentheses at its end."""
    at = F.instr(raw, " - ")
    artist = F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise("")
    title = F.when(at > 0, F.substring(raw, at + 3, F.length(raw))).otherwise(raw)
    return F.trim(F.regexp_replace(F.regexp_replace(artist, r"\s*\(\d+\)", ""), r"\*", "")), F.trim(title)


def candidates(responses: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, artist, title, label, year, styles, country, formats, release_id, rank) of every
    result with a title; rank puts originals before compilations and else keeps the order."""
    results = responses.select(key, F.posexplode(F.from_json(F.col(body), RESPONSE)["results"]).alias("pos", "r")).where(F.trim("r.title") != "")

    def texts(c: str) -> Column:
        return F.filter(F.coalesce(F.col(f"r.{c}"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")

    def some(c: Column) -> Column:
        return F.when(c != "", c)

    artist, title = split_artist_title(F.trim("r.title"))
    rows = results.select(
        key, "pos", artist.alias("artist"), title.alias("title"), F.try_element_at(texts("label"), F.lit(1)).alias("label"), F.col("r.year").try_cast("bigint").alias("year"),
        texts("style").alias("styles"), some(F.col("r.country")).alias("country"), some(F.array_join(texts("format"), ", ")).alias("formats"), F.col("r.id").cast("string").alias("release_id"),
    )
    order = Window.partitionBy(key).orderBy(scoring.format_relevance(F.col("formats")).desc(), "pos")
    return rows.withColumn("rank", F.row_number().over(order))
