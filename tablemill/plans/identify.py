"""Identification: names, matches against catalogues, candidate scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.functions import name_parts, scoring, text
from tablemill.operators import joins
from tablemill.operators.filters import normal_path
from tablemill.plans.base import query
from tablemill.storage import table

STEMS_SQL = """
select p_partkey, p_name, p_brand, case p_partkey % 6 when 0 then p_brand || ' - ' || p_name when 1 then p_brand || ' - ' || p_name || ' (' || p_type || ' mix)'
  when 2 then p_name when 3 then p_brand || ' - ' || p_name || ' [320]' when 4 then upper(p_brand) || ' -  ' || p_name || ' (old) edit' else p_brand || ' - ' || p_name || ' (a) (Dub)' end as stem from part"""


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, name = F.col("p_brand"), F.col("p_name")
    kind = F.col("p_partkey") % 6
    plain = F.concat(brand, F.lit(" - "), name)
    stem = (
        F.when(kind == 0, plain).when(kind == 1, F.concat(plain, F.lit(" ("), F.col("p_type"), F.lit(" mix)"))).when(kind == 2, name)
        .when(kind == 3, F.concat(plain, F.lit(" [320]"))).when(kind == 4, F.concat(F.upper(brand), F.lit(" -  "), name, F.lit(" (old) edit")))
        .otherwise(F.concat(plain, F.lit(" (a) (Dub)")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", stem.alias("stem"))


JUNK_SQL = "'kbps|khz|flac|http|www|320|256|192|128|rip|track |\\[|\\]|\\{|\\}|_'"
PARSED_SQL = rf"""
s as ({STEMS_SQL}),
x as (select *, trim(substring(stem, 1, strpos(stem, ' - ') - 1)) as a, trim(case when strpos(stem, ' - ') > 0 then substring(stem, strpos(stem, ' - ') + 3) else stem end) as rest from s),
y as (select *, case when regexp_matches(rest, '\([^(]*\)$') then trim(regexp_extract(rest, '^(.*)\(([^(]*)\)$', 1)) else rest end as t,
  case when regexp_matches(rest, '\([^(]*\)$') then trim(regexp_extract(rest, '^(.*)\(([^(]*)\)$', 2)) end as v from x),
n as (select *, strpos(stem, ' - ') > 0 and a <> '' and t <> '' and not regexp_matches(lower(a), {JUNK_SQL}) and not regexp_matches(lower(t), {JUNK_SQL}) as clean from y)"""


@query("FS1 FS2 FS3 FS4 FS5", f"with {PARSED_SQL} select p_partkey, clean, case when clean then a end as artist, case when clean then t end as title, case when clean then v end as version, v as hint from n")
def parse_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = text.parse_name(F.col("stem"))
    rows = stems(spark, sf_dir).select("p_partkey", parsed.alias("n"), text.version_hint(F.col("stem")).alias("hint"))
    return rows.select("p_partkey", F.col("n").isNotNull().alias("clean"), F.col("n.artist").alias("artist"), F.col("n.title").alias("title"), F.col("n.version").alias("version"), "hint")


@query("FS6 FS7 FS9 FS10 FS35 JN24", rf"""
with {PARSED_SQL},
g as (select *, case p_partkey % 4 when 0 then p_brand when 1 then '' when 2 then p_brand || '_x' else 'Other' end as ta, p_name as tt from n),
h as (select *, trim(ta) <> '' and trim(tt) <> '' and not regexp_matches(lower(ta), {JUNK_SQL}) and not regexp_matches(lower(tt), {JUNK_SQL}) as tags,
  lower(trim(regexp_replace(ta, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(a, '\s+', ' ', 'g'))) and lower(tt) = lower(t) as agree from g),
o as (select p_partkey, case when tags then trim(ta) when clean then a else '' end as artist, case when tags then trim(tt) when clean then t else stem end as title,
  case when clean or tags then v end as version, case when (tags and clean and agree) or (tags and not clean) or (clean and not tags) then 'green' else 'yellow' end as confidence from h)
select *, trim(regexp_replace(translate(artist || ' - ' || title || case when coalesce(version, '') <> '' then ' (' || version || ')' else '' end, '/\:*?"<>|', '         '), '\s+', ' ', 'g')) as filename from o""")
def reconcile_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    tag = F.when(kind == 0, F.col("p_brand")).when(kind == 1, "").when(kind == 2, F.concat("p_brand", F.lit("_x"))).otherwise("Other")
    made = text.reconcile(tag, F.col("p_name"), F.col("stem"), F.col("stem"))
    rows = stems(spark, sf_dir).select("p_partkey", made.alias("m")).select("p_partkey", "m.*")
    name = text.render("{artist} - {title}{version}", F.col("artist"), F.col("title"), F.col("version"))
    return rows.withColumn("filename", name)


@query("FS8 FS13 FS14 FS15 FS16 FS17 FS18 FS19 FS20 FS21 FS22 FS23 FS33 ST4")
def dirty_name_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and the query ladder of made-up dirty names; see tests for a labelled table."""
    rows = stems(spark, sf_dir)
    k = F.col("p_partkey") % 5
    dirty = (
        F.when(k == 0, F.concat(F.lit("A1. "), F.col("stem"))).when(k == 1, F.concat(F.regexp_replace("stem", " ", "_"), F.lit("-ccat")))
        .when(k == 2, F.concat(F.lit("[CAT 012] "), F.col("stem"), F.lit(" 320kbps"))).when(k == 3, F.concat(F.lit("07 - "), F.col("stem"), F.lit("-www.site.example")))
        .otherwise(F.col("stem"))
    )
    found = name_parts.with_terms(rows.select("p_partkey", "p_brand", dirty.alias("stem")), F.col("stem"), F.concat("p_brand", F.lit(" - Best Of")))
    return found.select("p_partkey", "stem", "terms.artist", "terms.title", "terms.version", F.array_join("terms.queries", " | ").alias("queries"))


@query("FS8 FS13 FS14 FS15 FS16 FS17 FS18 FS19 FS20 FS21 FS22 FS23 FS33", """
with p as (select p_partkey, p_partkey % 8 as k, 'Mira ' || p_type as artist, p_name as title from part)
select p_partkey, artist, title, case k when 4 then 'Dub Mix' when 7 then 'Harbour Remix' end as version,
  artist || ' ' || title || case k when 4 then ' Dub Mix' when 7 then ' Harbour Remix' else '' end as first_query, title as readable from p""")
def dirty_names_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names spoilt in eight ways (sides, underscores and tags, catalogue and quality notes, track
    numbers and addresses, brackets, labels, an artist only in the folder, a trailing version),
    which must give back the artist, title and version that they were made of."""
    k, title = F.col("p_partkey") % 8, F.col("p_name")
    artist = F.concat(F.lit("Mira "), "p_type")
    plain = F.concat(artist, F.lit(" - "), title)
    spoilt = (
        F.when(k == 0, F.concat(F.lit("A1. "), plain)).when(k == 1, F.concat(F.replace(plain, F.lit(" "), F.lit("_")), F.lit("-ccat")))
        .when(k == 2, F.concat(F.lit("[CAT 012] "), plain, F.lit(" 320kbps"))).when(k == 3, F.concat(F.lit("07 - "), plain, F.lit("-www.site.example")))
        .when(k == 4, F.concat(plain, F.lit(" (Dub Mix) [FLAC]"))).when(k == 5, F.concat(F.lit("Some Label Records - "), plain))
        .when(k == 6, title).otherwise(F.concat(plain, F.lit(" Harbour Remix")))
    )
    stem = F.concat(F.lit("01 - [CAT] "), F.replace(title, F.lit(" "), F.lit("_")), F.lit(" (vinyl rip) 320 kbps"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", spoilt.alias("stem"), F.concat(artist, F.lit(" - Best Of")).alias("folder"))
    found = name_parts.with_terms(rows, F.col("stem"), F.col("folder"))
    return found.select("p_partkey", "terms.artist", "terms.title", "terms.version", F.try_element_at("terms.queries", F.lit(1)).alias("first_query"), name_parts.clean_stem(stem).alias("readable"))


@query("FS8 FS13 FS14 FS17 FS19 FS22 FS33", """
with p as (select p_partkey, p_partkey % 4 as k, 'Mira ' || p_type as artist, p_name as title, p_brand, p_type from part)
select p_partkey, artist || '|' || title || case k when 3 then '|' || p_brand else '' end as fields,
  case k when 1 then 'version' when 3 then 'plain' else 'noise' end as kind, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as loose,
  case k when 2 then title || ' Harbour' else title end as said, case k when 2 then null else 'Harbour Remix' end as phrase,
  artist || ' ' || title || ' Dub|' || artist || ' ' || title || '|' || title as queries,
  case k when 0 then title || ' (' || p_brand || ') (promo)' else title end as readable from p""")
def name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column expressions for the parts of a dirty name: names put together of a part's columns
    and spoilt in four ways must come apart again."""
    k, title = F.col("p_partkey") % 4, F.col("p_name")
    artist = F.concat(F.lit("Mira "), "p_type")
    plain = F.concat(artist, F.lit(" - "), title)
    spoilt = (
        F.when(k == 0, F.concat(F.replace(plain, F.lit(" "), F.lit("_")), F.lit("-ccat-DEADBEEF"))).when(k == 1, F.concat(artist, F.lit(" \u2014\u00a0 "), title))
        .when(k == 2, F.concat(artist, F.lit("--"), title)).otherwise(F.concat(plain, F.lit(" - "), "p_brand"))
    )
    group = F.when(k == 0, "320 kbps").when(k == 1, F.concat("p_type", F.lit(" mix"))).when(k == 2, "CAT 012").otherwise("some words")
    said = name_parts.trailing_phrase(F.when(k == 2, F.concat(title, F.lit(" Harbour"))).otherwise(F.concat(title, F.lit(" Harbour Remix"))))
    stem = F.when(k == 0, F.concat(F.lit("[CAT] 01. "), title, F.lit(" ("), "p_brand", F.lit(") (promo) 320"))).otherwise(F.concat(F.lit("(Promo) (vinyl RIP) 07 - "), title, F.lit(" kbps [x]")))
    parts = name_parts.fields(name_parts.untagged(name_parts.normalised(spoilt), spoilt.contains("_")))
    dub = F.concat(artist, F.lit("  "), title, F.lit(" Dub"))
    asked = name_parts.queries(dub, F.concat(artist, F.lit(" "), title), F.upper(dub), title, F.lit("a-b"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(parts, "|").alias("fields"), name_parts.kind(group).alias("kind"), name_parts.bare(title).alias("loose"),
        said["title"].alias("said"), said["phrase"].alias("phrase"), F.array_join(asked, "|").alias("queries"), name_parts.clean_stem(stem).alias("readable"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normal_path(F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1)).alias("k"))


PATH_SQL = r"lower(replace(trim(regexp_extract(url, '://[^/]+(/[^?#]*)', 1)), '\', '/'))"


@query("JN14 JN15 JN16 JN17 PF17 PF18", f"""
with l as (select page_id, {PATH_SQL} as k from pages), r as (select page_id as content_id, k from l where page_id % 3 = 0)
select l.page_id, count(content_id)::bigint as n_matches, case count(content_id) when 0 then 'none' when 1 then 'pending' else 'ambiguous' end as match,
  string_agg(content_id, ',' order by content_id) as candidates from l left join r using (k) group by 1""")
def match_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the candidates listed in every row, as its SQL has them; match_status and
    match_members keep them once per key."""
    left = paths(spark, sf_dir)
    right = left.where("page_id % 3 = 0").select(F.col("page_id").alias("content_id"), "k")
    return joins.match_cardinality(left, right, "k", "page_id", "content_id", "content_id")


@query("JN14 JN15 JN16 JN17 PF17 PF18", f"""
with l as (select page_id, {PATH_SQL} as k from pages), r as (select page_id as content_id, k from l where page_id % 3 = 0)
select l.page_id, count(content_id)::bigint as n_matches, case count(content_id) when 0 then 'none' when 1 then 'pending' else 'ambiguous' end as match,
  case when count(content_id) = 1 then min(content_id) end as single from l left join r using (k) group by 1""")
def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As match_cardinality, without a copy of each candidate list for every row."""
    left = paths(spark, sf_dir)
    right = left.where("page_id % 3 = 0").select(F.col("page_id").alias("content_id"), "k")
    return joins.match_status(left, right, "k", "page_id", "content_id")


@query("JN17 PF18", f"""
with r as (select page_id as content_id, {PATH_SQL} as k from pages where page_id % 3 = 0)
select k, content_id from r where k in (select k from r group by 1 having count(*) > 1)""")
def match_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = paths(spark, sf_dir).where("page_id % 3 = 0").select(F.col("page_id").alias("content_id"), "k")
    return joins.match_members(right, "k", "content_id")


CANDIDATES_SQL = """
select p_partkey, p_brand, p_size, p_name || case p_partkey % 7 when 0 then ' (Remix)' when 1 then ' dub dub' when 2 then ' Original Mix' else '' end as track,
  case p_partkey % 5 when 0 then 'Vinyl, 12", EP' when 1 then 'CD, Compilation' when 2 then 'Vinyl, Single' when 3 then 'File, Mixed, Compilation' else null end as formats from part"""


@query("SC10 SO8 ST6 FS25 FX1 FX2 FX3 FX4", rf"""
with c as ({CANDIDATES_SQL}),
w as (select *, list_filter(regexp_split_to_array(regexp_replace(lower(track), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as have,
  list_transform(string_split(coalesce(formats, ''), ','), lambda x: lower(trim(x))) as f from c),
s as (select p_partkey, p_brand, p_size, len(list_filter(['red', 'widget'], lambda x: list_contains(have, x))) + 3 * len(list_filter(['dub'], lambda x: list_contains(have, x)))
  - 2 * len(list_filter(list_distinct(have), lambda x: x in ('remix', 'rmx', 'redub', 'edit', 'version'))) as score,
  len(list_filter(f, lambda x: x in ('vinyl', '12"'))) + 2 * len(list_filter(f, lambda x: x in ('single', 'ep'))) - 3 * len(list_filter(f, lambda x: x in ('compilation', 'mixed'))) as relevance from w)
select p_brand, p_partkey, score::bigint as score, relevance::bigint as relevance, rank::bigint as rank from (
  select *, row_number() over (partition by p_brand order by score desc, relevance desc, p_size, p_partkey) as rank from s) where rank <= 6""")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best candidates of each search: track score, format relevance, given order."""
    k = F.col("p_partkey")
    track = F.concat("p_name", F.when(k % 7 == 0, " (Remix)").when(k % 7 == 1, " dub dub").when(k % 7 == 2, " Original Mix").otherwise(""))
    formats = F.when(k % 5 == 0, 'Vinyl, 12", EP').when(k % 5 == 1, "CD, Compilation").when(k % 5 == 2, "Vinyl, Single").when(k % 5 == 3, "File, Mixed, Compilation")
    rows = table(spark, sf_dir, "part").select(
        "p_brand", "p_partkey", "p_size", scoring.track_score(track, F.lit("Red Widget"), F.lit("(Dub)")).cast("long").alias("score"), scoring.format_relevance(formats).cast("long").alias("relevance"),
    )
    # A limit right over the window lets every task send six rows of a brand.
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), F.desc("relevance"), "p_size", "p_partkey"))
    return rows.withColumn("rank", rank).where("rank <= 6").select("p_brand", "p_partkey", "score", "relevance", F.col("rank").cast("long").alias("rank"))


@query("FX5 ST4", """
with a as (select user_id, event_type as attempt, max(value) as best, count(*) as n from events group by 1, 2),
r as (select *, row_number() over (partition by user_id order by (best > 200) desc, case when best > 200 then 0 else 1 end, case when best > 200 then attempt end, n desc, attempt) as rn from a)
select user_id, attempt from r where rn = 1""")
def attempt_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attempt with a good score wins, else the fullest list."""
    tries = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("attempt")).agg(F.max("value").alias("best"), F.count("*").alias("n"))
    good = F.col("best") > 200
    return joins.prefer(tries, ["user_id"], -good.cast("int"), F.when(good, F.col("attempt")), -F.col("n"), F.col("attempt")).select("user_id", "attempt")
