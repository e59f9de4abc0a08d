"""Fingerprints of documents, whose words stand for a recording's items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators import fingerprints
from tablemill.plans.base import query
from tablemill.storage import scratch, stash, table

PRINTS_SQL = """
words as (select doc_id, string_split(text, ' ') as w from documents where doc_id is not null),
prints as (select doc_id, case when len(w) < 4 or w is null then [] else list_transform(range(1, len(w) - 2), lambda k: ('0x' || substr(md5(w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3]), 1, 8))::bigint) end as items from words),
postings as (select doc_id, unnest(items) as item, generate_subscripts(items, 1) as pos from prints),
holders as (select item, min(doc_id) as holder from postings group by 1),
pairs as (select distinct doc_id as a_id, holder as b_id from postings join holders using (item) where doc_id <> holder),
votes as (select a_id, b_id, x.pos - y.pos as shift, count(*) as votes from pairs join postings x on x.doc_id = a_id join postings y on y.doc_id = b_id and y.item = x.item group by 1, 2, 3),
best as (select * from votes qualify row_number() over (partition by a_id, b_id order by votes desc, abs(shift), shift) = 1),
placed as (select best.*, x.items as a, y.items as b, least(len(x.items) - greatest(shift, 0), len(y.items) - greatest(-shift, 0)) as overlap from best join prints x on x.doc_id = a_id join prints y on y.doc_id = b_id),
bits as (select a_id, b_id, k, bit_count(xor(a[k + greatest(shift, 0)], b[k + greatest(-shift, 0)]))::bigint as e from (select *, unnest(range(1, overlap + 1)) as k from placed)),
near as (select *, sum(e) over w < 8 * count(*) over w as low from bits window w as (partition by a_id, b_id order by k rows between 8 preceding and 8 following)),
runs as (select a_id, b_id, e, k - row_number() over (partition by a_id, b_id order by k) as run from near where low),
stretches as (select a_id, b_id, run, count(*) as n from runs group by 1, 2, 3 having sum(e) < 8 * count(*)),
matched as (select a_id, b_id, sum(n) as matched from stretches group by 1, 2)"""


@query("FM4", f"""
with {PRINTS_SQL}
select a_id, b_id, shift, votes, coalesce(matched, 0)::bigint as matched, round(least(1.0, coalesce(matched, 0) / greatest(1, least(len(a), len(b)))), 6)::double as similarity
from placed left join matched using (a_id, b_id)""")
def fingerprint_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the first holder of each of its items."""
    with scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents").where("doc_id is not null")
        prints = stash(docs.select("doc_id", fingerprints.word_items("text").alias("items")), "prints")
        pairs = stash(fingerprints.candidates(prints, "doc_id", "items"), "print-pairs")
        out = fingerprints.similarity(prints, pairs, "doc_id", "items")
        return keep(out.withColumn("similarity", F.round("similarity", 6)), "similarities")
