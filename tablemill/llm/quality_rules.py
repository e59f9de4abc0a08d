"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.storage import scratch, stash

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once a row, also where a lambda refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    The windows' hashes are sorted with their places, so equal ones are neighbours, whose words
    are then compared; texts whose windows are all distinct, found by one hash set, skip the sort."""

    def of_hashes(w: Column, h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def alike(x: Column, y: Column) -> Column:
                return (x["h"] == y["h"]) & (F.slice(w, x["i"] + 1, F.lit(3)) == F.slice(w, y["i"] + 1, F.lit(3)))

            same = F.filter(s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, of_sorted))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(let(hashes, lambda h: of_hashes(w, h)))

    return let(words, of_words)


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def count_of(pattern: str) -> Callable[[], Column]:
    return lambda: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def base_metrics(docs: DataFrame, text: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words beside the given columns."""
    lines = let(worded_lines(F.col(text)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    split = docs.withColumn("_words", words_of(F.col(text)))
    full = F.coalesce(F.col(text), F.lit(""))
    return split.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.regexp_replace(full, SYMBOL + "+", ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


#: Name to predicate (true: reject) over text and the base metrics. All count in integers.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    "dup_lines": lambda: F.col("n_dup_lines") * 3 > F.size(F.split("text", "\n")),
    "long_words": lambda: F.col("word_chars") > F.col("n_words") * 14,
    "short_words": lambda: F.col("word_chars") < F.col("n_words") * 2,
    "capitals": lambda: count_of("[A-Z]+")() * 2 > count_of("[A-Za-z]+")(),
    "digits": lambda: count_of("[0-9]+")() * 5 > F.col("word_chars"),
    "shouts": lambda: count_of("!!")() * 5 > F.col("n_words"),
    "links": lambda: count_of("://")() * 10 > F.col("n_words") * 3,
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def rule_costs(sample: DataFrame, rules: dict[str, Callable[[], Column]], turns: int = 4) -> dict[str, float]:
    """Seconds that each rule takes on the rows of `sample`, `turns` times over, above the time of
    the same job without a rule, which holds all start-up. The least of two runs counts."""
    rows = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(turns))))

    def took(value: Column) -> float:
        job = rows.agg(F.sum(value))
        times = []
        for _ in range(2):
            began = time.perf_counter()
            job.first()
            times.append(time.perf_counter() - began)
        return min(times)

    idle = took(F.col("_turn"))
    return {name: max(took(rule().cast("int")) - idle, 1e-4) for name, rule in rules.items()}


def cascade_order(sample: DataFrame, rules: dict[str, Callable[[], Column]]) -> list[str]:
    """Rule names so that each one rejects the most per second of those rows of the sample that
    the rules before it leave; rules that reject none come last, the cheapest first. The order
    changes what is computed, never the verdict."""
    names = list(rules)
    held = sample.coalesce(1).cache()
    hits = F.array(*(F.coalesce(rules[n](), F.lit(False)) for n in names))
    patterns = [(r["hits"], r["count"]) for r in held.groupBy(hits.alias("hits")).count().collect()]  # at most 2 ** rules, and a row each
    costs = rule_costs(held, rules) if patterns else dict.fromkeys(names, 1.0)
    held.unpersist()
    order: list[str] = []
    while len(order) < len(names):
        left = [(h, n) for h, n in patterns if not any(h[names.index(o)] for o in order)]
        gain = {n: sum(c for h, c in left if h[names.index(n)]) / costs[n] for n in names if n not in order}
        order.append(min(gain, key=lambda n: (-gain[n], costs[n])))
    return order


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, Callable[[], Column]] | None = None, sample_rows: int = 2000) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of
    every row of `docs`.

    The base limits come first; then the rules in the measured order, joined by AND, which
    evaluates a later rule only where all earlier ones passed. The sample is scored with the
    base metrics only where they pass. A null or empty text has no words and fails the base;
    empty tables give no rows; repeated rows give equal rows; columns other than key and text
    are not carried and so cannot clash."""
    rules = RULES if rules is None else rules
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = given.count()
    sample = given.sample(min(1.0, sample_rows / rows) if rows else 1.0, seed=7)
    with scratch(docs.sparkSession):
        order = cascade_order(stash(base_metrics(sample, "text").where(~base_failed()), "rule-sample"), rules)
    kept = ~F.col("base_failed")
    for name in order:
        kept = kept & ~rules[name]()
    scored = base_metrics(given, "text").withColumn("base_failed", base_failed())
    metrics = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return scored.select(F.col("key").alias(key), *metrics, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"))


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
windows as (
  select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as t
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select doc_id, t from windows group by doc_id, t having count(*) > 1),
covered as (
  select doc_id, count(distinct p) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as p from windows join twice using (doc_id, t)) group by doc_id),
m as (
  select d.doc_id, text, len(w)::bigint as n_words,
         length(list_aggregate(w, 'string_agg', ''))::bigint as chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         coalesce(covered.n, 0)::bigint as n_repeat_words
  from d left join covered using (doc_id)),
b as (
  select doc_id, text, n_words, coalesce(chars, 0)::bigint as word_chars, n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words,
         (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed
       and not (n_symbols * 10 > n_words)
       and not (n_dup_lines * 3 > len(string_split(text, chr(10))))
       and not (word_chars > n_words * 14)
       and not (word_chars < n_words * 2)
       and not ((length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) * 2 > length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))
       and not ((length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) * 5 > word_chars)
       and not ((length(text) - length(replace(text, '!!', ''))) * 5 > n_words)
       and not ((length(text) - length(replace(text, '://', ''))) * 10 > n_words * 3) as kept
from b
"""
