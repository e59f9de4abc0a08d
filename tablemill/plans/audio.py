"""Audio files made of documents: their bytes stand for samples, their sources for artists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.plans.base import query
from tablemill.sources import properties, wav
from tablemill.storage import scratch, table, workspace


@query("SC4", """
with d as (select doc_id, doc_id % 2 + 1 as channels, hex(encode(text)) as h from documents where doc_id % 7 <> 0 and text <> ''),
f as (select doc_id, channels, len(h) // 2 // channels as frames, h from d)
select doc_id, channels::int as channels, (8000 + doc_id % 3)::int as sample_rate, frames::bigint as frames, ceil(frames / 500.0)::bigint as blocks,
  list_sum(list_transform(range(0, frames * channels), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::int))::bigint as total from f where frames > 0""")
def audio_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files written from the texts' bytes, one in five claiming more than it has and one in seven with a broken
    head, read back in ranges of 4,000 bytes by blocks of 500 frames."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    files = docs.select(
        F.concat(F.when(F.col("doc_id") % 7 == 0, "broken/").otherwise("whole/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("name"),
        (F.col("doc_id") % 2 + 1).cast("int").alias("channels"), (8000 + F.col("doc_id") % 3).cast("int").alias("sample_rate"), F.lit(8).alias("bits"),
        F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"), F.when(F.col("doc_id") % 5 == 0, F.octet_length("text") + 1000).cast("long").alias("declared"),
    )
    spark.dataSource.register(wav.WavSource)
    with scratch(spark) as keep, workspace(spark, "wav") as at:
        plain = at.removeprefix("file://") if at.startswith("file:///") else at
        for folder, broken in (("whole", False), ("broken", True)):
            part = files.where(F.startswith("name", F.lit(folder))).withColumn("name", F.substring_index("name", "/", -1))
            part = part.withColumn("channels", F.lit(0)) if broken else part  # no channels: no PCM file
            part.write.format("wav").option("path", f"{plain}/{folder}").mode("append").save()
        blocks = spark.read.format("wav").option("path", plain).option("blockFrames", "500").option("rangeBytes", "4000").load()
        value = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + F.floor(x * 128 + 128.5))  # F.round goes by decimals, value for value
        rows = blocks.select(
            F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("doc_id"), "channels", "sample_rate", (F.size("samples") / F.col("channels")).cast("long").alias("frames"), value.alias("total"),
        )
        return keep(rows.groupBy("doc_id", "channels", "sample_rate").agg(F.sum("frames").alias("frames"), F.count("*").alias("blocks"), F.sum("total").alias("total")), "wav-blocks")


def number(x: Column, n: int, little: bool = False) -> Column:
    """The `n` bytes of a whole number."""
    digits = F.lpad(F.hex(x), 2 * n, "0")
    return F.unhex(F.regexp_replace(digits, "(..)" * n, "".join(f"${i}" for i in range(n, 0, -1))) if little else digits)


def chunk(name: str, body: Column, little: bool) -> Column:
    return F.concat(F.lit(name.encode()), number(F.octet_length(body).cast("long"), 4, little), body)


def frame(name: str, body: Column) -> Column:
    return F.concat(F.lit(name.encode()), number(F.octet_length(body).cast("long"), 4), F.lit(b"\x00\x00"), body)


def heads(docs: DataFrame) -> DataFrame:
    """(doc_id, head, size_bytes): by remainder of the id an MPEG file behind an ID3 tag, a FLAC, a WAV, or what is none."""
    title, artist = (F.encode(c, "utf-8") for c in (F.concat(F.lit("Été "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise("")))
    n, cover, nothing = F.col("n_chars").cast("long"), F.col("doc_id") % 5 == 0, F.lit(b"")
    tags = F.concat(frame("TIT2", F.concat(F.lit(b"\x03"), title)), frame("TPE1", F.concat(F.lit(b"\x03"), artist)), F.when(cover, frame("APIC", F.lit(b"\x00image/png\x00\x03\x00data"))).otherwise(nothing))
    size = F.octet_length(tags).cast("long")
    sync = number(sum((F.shiftright(size, 7 * i).bitwiseAND(F.lit(127)) * (1 << 8 * i) for i in range(4)), F.lit(0).cast("long")), 4)
    mpeg = F.concat(F.lit(b"ID3\x03\x00\x00"), sync, tags, F.lit(b"\xff\xfb\x90"), F.when(F.col("doc_id") % 8 == 0, F.lit(b"\xc0")).otherwise(F.lit(b"\x00")))
    lines = [F.concat(F.lit(k), v) for k, v in ((b"TITLE=", title), (b"artist=", artist))]
    notes = F.concat(F.lit(b"\x00\x00\x00\x00\x02\x00\x00\x00"), *(part for x in lines for part in (number(F.octet_length(x).cast("long"), 4, True), x)))
    stream = F.concat(F.lit(b"\x00\x00\x00\x22" + b"\x10\x00\x10\x00" + b"\x00" * 6), number(F.lit((48000 << 44) | (1 << 41) | (15 << 36)) + n * 480, 8), F.lit(b"\x00" * 16))
    picture = F.when(cover, F.lit(b"\x06\x00\x00\x02xx")).otherwise(nothing)
    flac = F.concat(F.lit(b"fLaC"), stream, picture, F.lit(b"\x84"), number(F.octet_length(notes).cast("long"), 3), notes)
    padded = lambda v: F.concat(v, F.lit(b"\x00"), F.when((F.octet_length(v) + 1) % 2 == 1, F.lit(b"\x00")).otherwise(nothing))
    info = F.concat(F.lit(b"INFO"), chunk("INAM", padded(title), True), chunk("IART", padded(artist), True))
    form = F.lit(b"\x01\x00\x01\x00" + (22050).to_bytes(4, "little") * 2 + b"\x01\x00\x08\x00")
    riff = F.concat(F.lit(b"RIFF\x00\x00\x00\x00WAVE"), chunk("fmt ", form, True), chunk("LIST", info, True), F.lit(b"data"), number(n * 441, 4, True))
    kind = F.col("doc_id") % 4
    head = F.when(kind == 0, mpeg).when(kind == 1, flac).when(kind == 2, riff).otherwise(F.lit(b"RIFX not audio"))
    full = F.when(kind == 0, size + 10 + n * 160).when(kind == 1, n * 1001).otherwise(F.octet_length(riff) + n * 441)
    return docs.select("doc_id", head.alias("head"), full.alias("size_bytes"))


@query("SC5", """
with d as (select *, doc_id % 4 as kind, 'Été ' || doc_id as t, case when doc_id % 3 <> 0 then nullif(trim(source), '') end as a from documents where n_chars > 0)
select doc_id, ['mpeg', 'flac', 'wav', null][kind + 1] as container, case kind when 0 then case when doc_id % 8 = 0 then 1 else 2 end when 1 then 2 when 2 then 1 else 0 end::int as channels,
  [44100, 48000, 22050, 0][kind + 1]::int as sample_rate, round(case kind when 0 then n_chars / 100.0 when 1 then n_chars / 100.0 when 2 then n_chars / 50.0 else 0 end, 6)::double as duration, [128, 800, 176, null][kind + 1]::int as bitrate,
  case when kind < 3 then a end as artist, case when kind < 3 then t end as title, kind < 2 and doc_id % 5 = 0 as has_cover, kind < 3 and a is not null as tagged from d""")
def audio_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties read from the heads of files made of documents."""
    found = properties.with_properties(heads(table(spark, sf_dir, "documents").where("n_chars > 0")))
    return found.select("doc_id", "container", "channels", "sample_rate", F.round("duration", 6).alias("duration"), "bitrate", "artist", "title", "has_cover", "tagged")
