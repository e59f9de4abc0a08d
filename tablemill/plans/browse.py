"""Browsing: facets, dashboards, histograms, usage. Orders stand for tracks, line items' part
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions import text
from tablemill.operators import aggregates, filters
from tablemill.plans.base import query
from tablemill.storage import table


def genres(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """(o_orderkey, genre, ord): each order's part types, the first line number of each; of all
    orders or of the given ones, to which line items are cut before they are aggregated."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    if orders is not None:
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("genre"))
    return lines.join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey"), "genre").agg(F.min("l_linenumber").alias("ord"))


def browse(spark: SparkSession, sf_dir: str, folder: str | None = None, needle: str | None = None, genre: str | None = None, status: tuple[str, ...] = ("F",)) -> DataFrame:
    """Filed tracks with their identity and ordered genres; all filters are optional and joined
    by AND. The genre filter keeps every genre of the tracks that have it."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    rows = orders.where(filters.all_of(F.col("o_orderstatus").isin(*status), filters.optional_equals(F.col("o_orderpriority"), folder)))
    rows = rows.join(customers, "o_custkey", "left")
    search = filters.contains_any(needle, F.col("c_name"), F.col("c_mktsegment"))
    rows = rows.where(filters.all_of(search))
    # One join by order brings the lines, and the lists are made where they arrive.
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("genre"))
    how = "left" if genre is None else "inner"
    met = rows.select("o_orderkey", "c_name", "o_orderpriority", "o_totalprice").join(lines, "o_orderkey", how).join(parts, "l_partkey", how)
    listed = F.array_distinct(aggregates.ordered_list(F.struct("l_linenumber", "genre"), "genre"))
    kept = met.groupBy("o_orderkey").agg(
        F.first("c_name").alias("c_name"), F.first("o_orderpriority").alias("o_orderpriority"), F.first(F.round("o_totalprice", 2)).alias("price"), F.filter(listed, lambda g: g.isNotNull()).alias("listed")
    )
    if genre is not None:
        kept = kept.where(F.array_contains("listed", genre))
    return kept.select("o_orderkey", "c_name", "o_orderpriority", "price", F.when(F.size("listed") > 0, F.array_join("listed", ", ")).alias("genres"))


GENRES_SQL = """
  select l_orderkey as o_orderkey, p_type as genre, min(l_linenumber) as ord
  from lineitem join part on p_partkey = l_partkey group by 1, 2"""


@query("SC3 PF1 PF2 PF3 PF4 JN1 JN2 JN3 JN13 AG17 SO1", f"""
with g as ({GENRES_SQL}),
lists as (select o_orderkey, string_agg(genre, ', ' order by ord, genre) as genres from g group by 1)
select o.o_orderkey, c_name, o_orderpriority, round(o_totalprice, 2) as price, genres
from orders o left join customer on c_custkey = o_custkey left join lists using (o_orderkey)
where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and (c_name ilike '%9%' or c_mktsegment ilike '%9%')
  and o.o_orderkey in (select o_orderkey from g where genre = 'PROMO')""")
def facet_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse(spark, sf_dir, "1-URGENT", "9", "PROMO").orderBy("c_name", "o_orderkey")


@query("AG1 AG4 AG5 PF8", """
select count(*)::bigint as total, count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH'))::bigint as lossless,
  count(*) filter (o_orderpriority = '3-MEDIUM')::bigint as lossy,
  count(*) filter (o_orderstatus = 'P' and o_custkey % 3 = 1)::bigint as fake,
  count(*) filter (o_orderstatus <> 'O')::bigint as done, coalesce(max(o_orderkey), 0)::bigint as newest
from orders""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = filters.versioned(F.col("o_orderstatus"), F.col("o_custkey") % 3, 1)
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("lossless"),
        F.count_if(F.col("o_orderpriority") == "3-MEDIUM").alias("lossy"), F.count_if(current == "P").alias("fake"),
        F.count_if(F.col("o_orderstatus") != "O").alias("done"), F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("newest"),
    )


@query("AG2 AG3 SO3", """
select 'folder' as facet, o_orderpriority as value, count(*)::bigint as n from orders where o_orderstatus = 'F' group by 2
union all select 'status', o_orderstatus, count(*)::bigint from orders where o_orderstatus = 'F' group by 2
union all select 'artist', c_mktsegment, count(*)::bigint from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F' group by 2""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(customers, "o_custkey", "left")
    return aggregates.facets(rows, {"folder": "o_orderpriority", "status": "o_orderstatus", "artist": "c_mktsegment"}).orderBy("facet", F.desc("n"), "value")


@query("AG2 JN2 SO3", f"with g as ({GENRES_SQL}) select genre, count(*)::bigint as n from g join orders using (o_orderkey) where o_orderstatus = 'F' group by 1")
def genre_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return genres(spark, sf_dir).join(filed, "o_orderkey").groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre")


@query("JN6", """
select c_custkey, count(o_orderkey)::bigint as pending from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'O' group by 1""")
def pending_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(pending, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("pending"))


@query("JN4 JN5 PF16", """
select 'customer' as kind, c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
union all select 'order', o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def anti_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey").join(orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    bare = orders.select("o_orderkey").join(lines, "o_orderkey", "left_anti")
    return customers.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).union(bare.select(F.lit("order"), "o_orderkey"))


@query("AG8 AG10 FS27 SO4", """
with f as (select case when upper(split_part(source || '/' || doc_id || case doc_id % 4 when 0 then '.AIF' when 1 then '.jpeg' when 2 then '.wav' else '' end, '/', 1)) = 'SRC0' then 'SRC0' else '' end as x,
  doc_id, n_chars from documents)
select case doc_id % 4 when 0 then '.aiff' when 1 then '.jpg' when 2 then '.wav' else '(sans extension)' end as bucket,
  sum(n_chars)::bigint as bytes, count(*)::bigint as file_count from f group by 1""")
def usage_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(F.lit(".AIF"), F.lit(".jpeg"), F.lit(".wav"), F.lit("")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending)
    return aggregates.usage(table(spark, sf_dir, "documents"), text.usage_bucket(path), F.col("n_chars")).orderBy(F.desc("bytes"), "bucket")


@query("AG9 AG35 WN11", """
with b as (select source as bucket, sum(n_chars) as bytes, count(*) as file_count from documents group by 1
  union all select 'src' || (page_id % 7), sum(length(html)), count(*) from pages group by 1),
m as (select bucket, sum(bytes)::bigint as bytes, sum(file_count)::bigint as file_count from b group by 1)
select bucket, bytes, file_count, round(100.0 * bytes / sum(bytes) over (), 4) as share,
  case when bucket in ('src0', 'src1', 'src2') then 'first' else 'other' end as family from m""")
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = aggregates.usage(table(spark, sf_dir, "documents"), F.col("source"), F.col("n_chars"))
    pages = aggregates.usage(table(spark, sf_dir, "pages"), F.concat(F.lit("src"), F.pmod("page_id", F.lit(7)).cast("string")), F.length("html"))
    merged = aggregates.merge_usage(docs, pages)
    whole = merged.agg(F.sum("bytes").alias("whole"))  # one row
    return merged.join(F.broadcast(whole)).select(
        "bucket", "bytes", "file_count", F.round(100.0 * F.col("bytes") / F.col("whole"), 4).alias("share"),
        F.when(F.col("bucket").isin("src0", "src1", "src2"), "first").otherwise("other").alias("family"),
    )


@query("AG17 AG18 SK6", """
select conv_id, string_agg(role, '>' order by turn) as roles, count(*)::bigint as turns,
  string_agg(trim(split_part(text, ' ', 1)), '; ' order by turn) filter (trim(split_part(text, ' ', 1)) <> '') as openings
from conversations group by 1""")
def ordered_list_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").withColumn("opening", F.split("text", " ")[0])
    return talks.groupBy("conv_id").agg(
        F.array_join(aggregates.ordered_list("turn", "role"), ">").alias("roles"), F.count("*").alias("turns"),
        aggregates.joined_labels(aggregates.ordered_list("turn", "opening")).alias("openings"),
    )


@query("PF5 PF6 PF7 PF8 PF14", """
with t as (select event_id, event_type, value, user_id,
  case when user_id % 5 <> 0 then event_type end as verdict, user_id % 3 as ver,
  case when event_id % 7 <> 0 then ts end as analyzed, case event_id % 11 when 0 then null when 1 then '' else props end as report from events)
select event_id, (verdict is null or analyzed is null or report is null or ver is distinct from 1) as needs,
  (event_type = 'view' and (analyzed is null or report is null or (verdict is not null and ver is distinct from 1))) as again,
  case when ver = 1 then verdict end as shown from t""")
def analysis_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("user_id") % 5 != 0, F.col("event_type")).alias("verdict"), (F.col("user_id") % 3).alias("ver"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("analyzed"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 11 == 1, "").otherwise(F.col("props")).alias("report"),
    )
    status = F.when(F.col("event_type") == "view", "pending").otherwise("filed")
    args = [F.col(c) for c in ("verdict", "ver", "analyzed", "report")]
    return rows.select("event_id", filters.needs_analysis(*args, 1).alias("needs"), filters.to_reanalyse(status, *args, 1).alias("again"), filters.versioned(args[0], args[1], 1).alias("shown"))


@query("PF19 FJ2", """
select event_id, (json_extract_string(props, '$.k'))::bigint as k from events
where json_extract_string(props, '$.k') is not null and json_extract_string(props, '$.missing') is null and (json_extract_string(props, '$.k'))::bigint > 90""")
def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").where(k.isNotNull() & F.get_json_object("props", "$.missing").isNull() & (k > 90)).select("event_id", k.alias("k"))


@query("AG34 AG37 AG38 PF25", """
select o_orderpriority as format, count(*)::bigint as n, round(sum(o_totalprice) filter (o_orderkey % 13 <> 0), 2) as total,
  count(*) filter (o_orderkey % 13 = 0)::bigint as unknown, count(*) filter (o_orderstatus = 'F')::bigint as ready,
  count(*) filter (o_orderstatus = 'P')::bigint as fake, count(*) filter (o_orderstatus = 'O')::bigint as pending
from orders group by 1""")
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("format")).agg(
        F.count("*").alias("n"), F.round(F.sum(known), 2).alias("total"), F.count_if(known.isNull()).alias("unknown"),
        F.count_if(F.col("o_orderstatus") == "F").alias("ready"), F.count_if(F.col("o_orderstatus") == "P").alias("fake"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"),
    )


@query("SC11 FS28 SO9", r"""
with p as (select distinct regexp_extract(url, '://[^/]+(/[^?#]*)', 1) as path from pages),
s as (select string_split(trim(path, '/'), '/') as parts from p where path <> ''),
d as (select unnest(range(1, len(parts) + 1)) as depth, parts from s)
select array_to_string(parts[1:depth], '/') as bin, depth::int as depth, count(*)::bigint as n from d group by 1, 2""")
def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1)
    parts = table(spark, sf_dir, "pages").select(path.alias("path")).where("path <> ''").distinct().select(F.split(F.trim(F.col("path"), F.lit("/")), "/").alias("parts"))
    rows = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    return rows.groupBy(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("bin"), "depth").agg(F.count("*").alias("n"))


def ranked(orders: DataFrame) -> DataFrame:
    """Orders by rank of their status, then by falling price, a missing one last."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    rows = orders.select("o_orderkey", rank.alias("rank"), "o_totalprice")
    return rows.orderBy("rank", F.desc(F.coalesce("o_totalprice", F.lit(float("-inf")))), "o_orderkey").drop("o_totalprice")


@query("SO2 PF22", """
select o_orderkey, case o_orderstatus when 'P' then 0 when 'F' then 1 else 2 end as rank from orders""")
def rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders by rank and price; `rank_sort_orders` is its older name for the whole table."""
    return ranked(table(spark, sf_dir, "orders"))


@query("SO2 PF22", """
select o_orderkey, case o_orderstatus when 'P' then 0 when 'F' then 1 else 2 end as rank from orders""")
def rank_sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "orders"))


@query("SO5 SO10", "select event_id, event_type, round(value, 2) as value from events order by ts desc, event_id desc limit 50")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", F.round("value", 2).alias("value"))


@query("FS30 AG35", """
select case when lower(text) like '%house%' or lower(text) like '%garage%' then 'house'
  when lower(text) like '%techno%' or lower(text) like '%electro%' or lower(text) like '%industrial%' or lower(text) like '%ebm%' or lower(text) like '%trance%' or lower(text) like '%acid%' or lower(text) like '%minimal%' or lower(text) like '%goa%' then 'techno'
  when lower(text) like '%disco%' or lower(text) like '%funk%' or lower(text) like '%soul%' or lower(text) like '%boogie%' then 'discofunksoul'
  when lower(text) like '%hip hop%' or lower(text) like '%hip-hop%' or lower(text) like '%rap%' or lower(text) like '%r&b%' or lower(text) like '%rnb%' or lower(text) like '%trap%' then 'hiphop'
  else 'autre' end as family, count(*)::bigint as n from documents group by 1""")
def genre_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(text.genre_family(F.col("text")).alias("family")).agg(F.count("*").alias("n"))
