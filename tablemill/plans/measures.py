"""Signal measures, verdicts and their evaluation. Event values by user stand for samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions import verdict
from tablemill.operators import aggregates, scans, signal, windows
from tablemill.plans.base import query
from tablemill.storage import scratch, stash, table

SERIES_SQL = "select user_id, value, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order of time, numbered by a scan over ranges."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return scans.numbered(rows, ["user_id"], ["ts", "event_id"], "pos").select("user_id", "value", "event_id", "pos")


@query("AG21 WN4", f"""
with s as ({SERIES_SQL}), c as (select *, pos - row_number() over (partition by user_id order by pos) as run from s where value >= 40),
r as (select user_id, run, count(*) as n from c group by 1, 2),
t as (select user_id, count(*) as total, count(*) filter (value >= 40) as hot from s group by 1)
select t.user_id, round(100.0 * hot / total, 4) as clip_pct, count(r.run) filter (n >= 3)::bigint as clip_runs from t left join r using (user_id) group by t.user_id, hot, total""")
def clip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(clipped(series(spark, sf_dir)), "clip-runs")


def clipped(rows: DataFrame) -> DataFrame:
    found = scans.runs(rows, "user_id", ["pos"], F.col("value") >= 40, "pos").groupBy("user_id").agg(F.count_if(F.col("length") >= 3).alias("clip_runs"))
    share = rows.groupBy("user_id").agg(F.round(100.0 * F.count_if(F.col("value") >= 40) / F.count("*"), 4).alias("clip_pct"))
    return share.join(found, "user_id", "left").select("user_id", "clip_pct", F.coalesce("clip_runs", F.lit(0)).alias("clip_runs"))


@query("AG24", f"""
with s as ({SERIES_SQL}), e as (select user_id, min(pos) filter (value > 20) as a, max(pos) filter (value > 20) as b, max(pos) as z from s group by 1)
select user_id, round(coalesce(a, z + 1) * 10.0, 4)::double as head_ms, round(case when b is null then 0 else (z - b) * 10.0 end, 4)::double as tail_ms from e""")
def silence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(windows.silence_edges(series(spark, sf_dir), "user_id", "pos", "value", 100.0, 20.0), "silence-edges")


@query("AG26 FA3 WN8", f"""
with s as ({SERIES_SQL}), f as (select user_id, pos // 8 as slot, max(abs(value)) as peak from s group by 1, 2),
n as (select user_id, count(*) as n from f group by 1)
select user_id, floor(slot / ceil(greatest(n / 5.0, 1)))::bigint as point, max(peak) as peak from f join n using (user_id) group by 1, 2""")
def peak_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(windows.envelope(series(spark, sf_dir), "user_id", "pos", "value", 8, 5), "envelope")


@query("WN5 WN6 WN7", f"""
with s as ({SERIES_SQL})
select user_id, pos::bigint as pos, round(avg(value) over (partition by user_id order by pos rows between 5 preceding and 5 following), 6) as smooth,
  round(avg(value) over (partition by user_id order by pos rows between 1 following and 4 following), 6) as ahead from s""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        mean = F.avg("value")
        near = scans.neighbours(series(spark, sf_dir), "user_id", "pos", {"smooth": (mean, -5, 5), "ahead": (mean, 1, 4)})
        return keep(near.select("user_id", "pos", F.round("smooth", 6).alias("smooth"), F.round("ahead", 6).alias("ahead")), "moving-average")


@query("AG20 AG22 AG23 FM6", """
with e as (select label, (list_extract(embedding, 1))::double as x, (list_extract(embedding, 2))::double as y from embeddings)
select label, round(avg((x + y) / 2), 6) as dc_offset, round(case when sqrt(sum(x*x) * sum(y*y)) < 1e-12 then 0 else sum(x*y) / sqrt(sum(x*x) * sum(y*y)) end, 6) as phase,
  sum((x-y)*(x-y)) / sum(x*x + y*y) < 1e-6 as dual_mono, round(20 * log10(max(greatest(abs(x), abs(y)))), 6) as peak_db from e group by 1""")
def stereo_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    out = signal.stereo_measures(rows, "label", "x", "y")
    return out.select("label", F.round("dc_offset", 6).alias("dc_offset"), F.round("phase", 6).alias("phase"), "dual_mono", F.round("peak_db", 6).alias("peak_db"))


@query("AG25 WN9", f"""
with s as ({SERIES_SQL}), a as (select user_id, max(pos) as z, avg(value * value) as whole from s group by 1),
l as (select user_id, whole, avg(value * value) filter (pos > z - 5) as late from s join a using (user_id) group by 1, 2)
select user_id, sqrt(whole) > 1e-4 and sqrt(late) >= 0.5 * sqrt(whole) as truncated from l""")
def truncated_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(signal.truncated(series(spark, sf_dir), "user_id", "pos", "value", 5), "tails")


@query("AG29 FM8", """
select l_partkey, round(list_sort(list(l_extendedprice))[count(*) // 2 + 1], 2) as median, round(stddev_pop(l_quantity), 6) as spread from lineitem group by 1""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(aggregates.upper_median("l_extendedprice"), 2).alias("median"), F.round(F.stddev_pop("l_quantity"), 6).alias("spread"))


BLOCK = 8192


def played(spark: SparkSession, sf_dir: str, seconds, sample) -> DataFrame:
    """Blocks of one channel for every supplier: `seconds` tells the number of samples, `sample` the one at a place."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_id"))
    keys = keys.repartition(max(1, -(-keys.count() // 500)))  # a key is small and its samples are not
    length = seconds(F.col("track_id"))
    rows = keys.withColumn("n", length).withColumn("block_id", F.explode(F.sequence(F.lit(0), F.floor((length - 1) / BLOCK))))
    places = F.sequence(F.col("block_id") * BLOCK, F.least((F.col("block_id") + 1) * BLOCK, F.col("n")) - 1)
    return rows.select("track_id", F.lit(44100).alias("sample_rate"), F.lit(1).alias("channels"), F.col("block_id").cast("long").alias("block_id"), F.transform(places, lambda i: sample(F.col("track_id"), i)).alias("samples"))


def comb(n, i):
    """At place i the sum of the first `n` multiples of the eighth bin, at full scale, in closed form."""
    turn = i * (2 * math.pi * 8 / 4096)
    return F.when(i % 512 == 0, 1.0).otherwise((F.sin((n + 0.5) * turn) / (2 * F.sin(turn / 2)) - 0.5) / n)


@query("AG27 SC4", "select s_suppkey as track_id, round((8 * (60 + s_suppkey % 90) + 46) * 44100 / 4096.0, 1)::double as cutoff_hz from supplier")
def spectral_cliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combs of tones that end at a bin told by the key: the cutoff is the 46th bin behind it, the last one whose
    band of 47 bins below still holds the end of the comb."""
    out = signal.spectra(played(spark, sf_dir, lambda k: F.lit(20000), lambda k, i: comb(60 + k % 90, i)))
    return out.select("track_id", F.round("cutoff_hz", 1).alias("cutoff_hz"))


@query("AG27 AG28 SC4 FA2")
def spectral_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three measures of the same combs."""
    out = signal.spectra(played(spark, sf_dir, lambda k: F.lit(20000), lambda k, i: comb(60 + k % 90, i)))
    return out.select("track_id", F.round("cutoff_hz", 1).alias("cutoff_hz"), F.round("flat_fixed", 3).alias("flat_fixed"), F.round("flat_top", 3).alias("flat_top"))


def impulses(every: int):
    return lambda k, i: F.when((k % every == 0) & (i % 4096 == 3000), 0.5).otherwise(0.0)


@query("AG27 AG28 SC4 FA2", """
select s_suppkey as track_id, case when s_suppkey % 3 = 2 then 0.0 else 22050.0 end::double as cutoff_hz,
  case when s_suppkey % 3 < 2 then 0.0 end::double as flat_fixed, case when s_suppkey % 3 < 2 then 0.0 end::double as flat_top from supplier""")
def spectral_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals whose spectra are known: one impulse a frame is flat up to half the rate, and so is
    silence; a signal shorter than a frame has no spectrum."""
    out = signal.spectra(played(spark, sf_dir, lambda k: F.when(k % 3 == 2, 1000).otherwise(BLOCK), impulses(3)))
    return out.select("track_id", F.round("cutoff_hz", 1).alias("cutoff_hz"), F.round("flat_fixed", 3).alias("flat_fixed"), F.round("flat_top", 3).alias("flat_top"))


@query("AG30")
def spectrogram_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = played(spark, sf_dir, lambda k: F.lit(20000), lambda k, i: comb(60 + k % 90, i))
    with scratch(spark) as keep:
        return keep(signal.spectrogram(blocks, BLOCK).select("track_id", "column", F.hex("levels").alias("levels")), "grid")


@query("AG30", """
with w as (select 0.5 - 0.5 * cos(2 * pi() * 3000 / 4095) as w), v as (select floor((greatest(10 * log10(0.25 * w * w / (1023.75 * 1023.75)), -100) + 100) / 100 * 255)::int as level from w)
select s_suppkey as track_id, unnest(range(0, 2)) as column, repeat(case when s_suppkey % 2 = 0 then printf('%02X', level) else '00' end, 342) as levels from supplier, v""")
def spectrogram_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of one impulse a frame, whose level is the window's there, and of silence."""
    with scratch(spark) as keep:
        out = signal.spectrogram(played(spark, sf_dir, lambda k: F.lit(BLOCK), impulses(2)), BLOCK)
        return keep(out.select("track_id", "column", F.hex("levels").alias("levels")), "grid")


MEASURED_SQL = """
select l_orderkey, l_linenumber, l_partkey, (l_extendedprice * 7) % 24000 - 500 as cutoff,
  case l_returnflag when 'R' then 'lossless' when 'A' then 'lossy' else 'unknown' end as declared, case when l_quantity > 45 then 'lossy' else 'lossless' end as content,
  case when l_suppkey % 6 = 0 then null else [128, 160, 192, 256, 320][l_suppkey % 5 + 1] end as bitrate,
  case when l_partkey % 3 = 0 then -7.0 when l_partkey % 3 = 1 then -1.0 end as flat_fixed, case when l_partkey % 5 = 0 then -30.0 else -10.0 end as flat_top from lineitem"""
VERDICT_SQL = """case when declared = 'lossless' then case when content = 'lossy' then 'fake' when cutoff <= 0 then 'grey'
    when cutoff >= 20000 then case when coalesce(flat_fixed < -5.8, false) or coalesce(flat_top < -23.8, false) then 'grey' else 'ok' end when cutoff <= 19500 then 'fake' else 'grey' end
  when declared = 'lossy' then case when cutoff <= 0 then 'grey' when bitrate is not null and cutoff < case when bitrate >= 320 then 19000 when bitrate >= 256 then 18000
    when bitrate >= 192 then 16500 when bitrate >= 160 then 15500 when bitrate >= 128 then 14500 else 12000 end then 'fake' else 'ok' end else 'grey' end"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.array(*map(F.lit, (128, 160, 192, 256, 320)))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_extendedprice") * 7) % 24000 - 500).alias("cutoff"),
        F.when(F.col("l_returnflag") == "R", "lossless").when(F.col("l_returnflag") == "A", "lossy").otherwise("unknown").alias("declared"),
        F.when(F.col("l_quantity") > 45, "lossy").otherwise("lossless").alias("content"),
        F.when(F.col("l_suppkey") % 6 != 0, F.get(rates, (F.col("l_suppkey") % 5).cast("int"))).alias("bitrate"),
        F.when(F.col("l_partkey") % 3 == 0, -7.0).when(F.col("l_partkey") % 3 == 1, -1.0).alias("flat_fixed"), F.when(F.col("l_partkey") % 5 == 0, -30.0).otherwise(-10.0).alias("flat_top"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("cutoff", "declared", "content", "bitrate", "flat_fixed", "flat_top")]
    return measured(spark, sf_dir).withColumn("verdict", verdict.verdict(*columns))


@query("FM1 FM2 FM3 FS31 FS34 PF8 PF12 PF25 ST5", f"""
with m as ({MEASURED_SQL})
select declared, {VERDICT_SQL} as verdict, case when cutoff >= 19000 then 320 when cutoff >= 18000 then 256 when cutoff >= 16500 then 192 when cutoff >= 15500 then 160 else 128 end as estimated,
  declared = 'lossless' and content = 'lossy' as mismatch, count(*)::bigint as n, round(sum(cutoff), 1) as total from m group by 1, 2, 3, 4""")
def verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    mismatch = (F.col("declared") == "lossless") & (F.col("content") == "lossy")
    return rows.groupBy("declared", "verdict", verdict.equivalent_bitrate(F.col("cutoff")).alias("estimated"), mismatch.alias("mismatch")).agg(F.count("*").alias("n"), F.round(F.sum("cutoff"), 1).alias("total"))


@query("AG31 JN22", """
with m as (select l.doc_id, quality, case when n_chars is null then 'missing' when n_chars < 400 then 'Fake' when n_chars < 900 then 'Grey' else 'Ok' end as verdict
  from labels l left join documents d on d.doc_id = l.doc_id and d.doc_id % 17 <> 0)
select quality as truth, count(*) filter (verdict = 'Ok')::bigint as ok, count(*) filter (verdict = 'Grey')::bigint as grey, count(*) filter (verdict = 'Fake')::bigint as fake,
  count(*) filter (verdict = 'missing')::bigint as missing, round(100.0 * count(*) filter (verdict = 'Fake') / count(*) filter (verdict <> 'missing'), 4) as rate from m group by 1""")
def quality_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 17 <> 0").select("doc_id", "n_chars")
    kind = F.when(F.col("n_chars").isNull(), "missing").when(F.col("n_chars") < 400, "Fake").when(F.col("n_chars") < 900, "Grey").otherwise("Ok")
    pivoted = (
        table(spark, sf_dir, "labels").join(docs, "doc_id", "left").withColumn("verdict", kind)
        .groupBy(F.col("quality").alias("truth")).pivot("verdict", ["Ok", "Grey", "Fake", "missing"]).count().na.fill(0)
    )
    rate = F.round(100.0 * F.col("Fake") / (F.col("Ok") + F.col("Grey") + F.col("Fake")), 4)
    return pivoted.select("truth", F.col("Ok").alias("ok"), F.col("Grey").alias("grey"), F.col("Fake").alias("fake"), "missing", rate.alias("rate"))


@query("AG32", f"""
with m as ({MEASURED_SQL}), v as (select *, {VERDICT_SQL} as verdict from m)
select bitrate, count(*)::bigint as n, count(*) filter (verdict = 'fake')::bigint as detected, count(*) filter (verdict = 'ok')::bigint as missed,
  count(*) filter (verdict = 'grey')::bigint as grey, round(min(cutoff), 2) as lowest, round(max(cutoff), 2) as highest from v group by 1""")
def encoder_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = {name: F.count_if(F.col("verdict") == v).alias(name) for name, v in (("detected", "fake"), ("missed", "ok"), ("grey", "grey"))}
    return judged(spark, sf_dir).groupBy("bitrate").agg(F.count("*").alias("n"), *count.values(), F.round(F.min("cutoff"), 2).alias("lowest"), F.round(F.max("cutoff"), 2).alias("highest"))


@query("AG33 FM8", """
with r as (select avg(n_chars) as mean, stddev_pop(n_chars) as spread, min(n_chars) as least, list_sort(list(n_chars))[count(*) // 2 + 1] as middle from documents join labels using (doc_id) where quality = 1),
d as (select quality, n_chars, (n_chars - mean) / spread as z, least, middle from documents join labels using (doc_id), r),
u as (select unnest(['z below -0.5', 'below least', 'below half median']) as rule, unnest([z < -0.5, n_chars < least, n_chars < middle / 2.0]) as hit, quality from d)
select rule, count(*) filter (quality = 0 and hit)::bigint as detected, count(*) filter (quality = 1 and hit)::bigint as false_positives, count(*)::bigint as n from u group by 1""")
def rule_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        rows = stash(table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id"), "labelled-lengths")
        return keep(compared(rows), "rule-compare")


def compared(rows: DataFrame) -> DataFrame:
    good = rows.where("quality = 1")
    middle = aggregates.upper_medians(good, [], "n_chars", few=256).select(F.col("median").alias("middle"))  # one row
    reference = good.agg(F.avg("n_chars").alias("mean"), F.stddev_pop("n_chars").alias("spread"), F.min("n_chars").alias("least")).crossJoin(middle)
    z = (F.col("n_chars") - F.col("mean")) / F.col("spread")
    rules = [("z below -0.5", z < -0.5), ("below least", F.col("n_chars") < F.col("least")), ("below half median", F.col("n_chars") < F.col("middle") / 2)]
    long = rows.join(F.broadcast(reference)).select("quality", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), h.alias("hit")) for n, h in rules))).alias("r"))
    return long.groupBy("r.rule").agg(F.count_if(F.col("r.hit") & (F.col("quality") == 0)).alias("detected"), F.count_if(F.col("r.hit") & (F.col("quality") == 1)).alias("false_positives"), F.count("*").alias("n"))
