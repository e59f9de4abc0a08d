"""Similarity of item lists against plain loops, and joins of keys that hold half of all rows."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.operators import fingerprints, graph, joins


def loops(a, b):
    votes = Counter(i - j for i, x in enumerate(a) for j, y in enumerate(b) if x == y)
    if not votes:
        return 0, 0, 0, 0.0
    shift, n = min(votes.items(), key=lambda v: (-v[1], abs(v[0]), v[0]))
    pairs = [(a[i], b[i - shift]) for i in range(len(a)) if 0 <= i - shift < len(b)]
    bits = [bin(x ^ y).count("1") for x, y in pairs]
    near = []
    for i in range(len(bits)):
        part = bits[max(0, i - fingerprints.REACH) : i + fingerprints.REACH + 1]
        near.append(sum(part) < 8 * len(part))
    matched, i = 0, 0
    while i < len(bits):
        j = i
        while j < len(bits) and near[j] == near[i]:
            j += 1
        if near[i] and sum(bits[i:j]) < 8 * (j - i):
            matched += j - i
        i = j
    return shift, n, matched, min(1.0, matched / min(len(a), len(b)))


@pytest.fixture
def lists():
    rng = random.Random(6)
    base = [rng.getrandbits(32) for _ in range(120)]
    noisy = lambda items, p: [x ^ (1 << rng.randrange(32)) if rng.random() < p else x for x in items]
    out = {1: base, 2: noisy(base, 0.5), 3: base[30:] + [rng.getrandbits(32) for _ in range(40)], 4: [rng.getrandbits(32) for _ in range(25)] + noisy(base[:60], 0.3)}
    out |= {5: [], 6: None, 7: base[:1], 8: [7] * 200, 9: [7] * 150 + base[:20], 10: [rng.getrandbits(32) for _ in range(80)], 11: base, 12: [2**32 - 1, 0] * 40, 13: [0, 2**32 - 1] * 30}
    return out


@pytest.mark.parametrize("frequent", [1 << 14, 10])
def test_similarity_against_loops(spark, lists, monkeypatch, frequent):
    monkeypatch.setattr(fingerprints, "FREQUENT", frequent)
    for x in lists.values():
        for y in lists.values():
            if x and y:
                a, b = np.array(x, np.uint32), np.array(y, np.uint32)
                shift, votes = fingerprints.best_offset(a, b)
                assert (shift, votes) == loops(x, y)[:2]
                assert not votes or fingerprints.matched_items(a, b, shift) == loops(x, y)[2]
    prints = spark.createDataFrame(list(lists.items()), "id long, items array<long>")
    pairs = spark.createDataFrame([(a, b) for a in lists for b in lists], "a_id long, b_id long")
    got = {(r.a_id, r.b_id): (r.shift, r.votes, r.matched, r.similarity) for r in fingerprints.similarity(prints, pairs, "id", "items").collect()}
    assert got == {(a, b): loops(x or [], y or []) for a, x in lists.items() for b, y in lists.items()}
    assert got[1, 2][3] > 0.9 and got[3, 1][:1] == (-30,) and got[1, 10][3] == 0


def test_candidates_pair_each_row_with_first_holders(spark, lists):
    rows = list(lists.items()) + [(None, [1, 2])]
    got = {tuple(r) for r in fingerprints.candidates(spark.createDataFrame(rows, "id long, items array<long>"), "id", "items").collect()}
    holder = {}
    for key, items in sorted(lists.items()):
        for x in items or []:
            holder.setdefault(x, key)
    assert got == {(k, holder[x]) for k, items in lists.items() for x in items or [] if holder[x] != k}


def test_dealt_join_spreads_a_heavy_key(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIGHT", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 500).alias("k"))
        groups = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        for how in ("inner", "left"):
            got = joins.dealt_join(rows, groups, ["k"], ["id"], how)
            assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, rows.join(groups, "k", how).select("id", "k", "v").collect()))
        assert joins.dealt_join(rows.limit(0), groups, ["k"], ["id"]).count() == 0
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = [r.n for r in joins.dealt_join(rows, groups, ["k"], ["id"]).where("k = 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIGHT", 50)
    edges = [(5000, i) for i in range(1000, 1900)] + [(i, i + 1) for i in range(2000, 2040)] + [(2020, 5000), (7, 7), (None, 3)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a_id long, b_id long")).collect()}
    assert got == {**{i: 1000 for i in [*range(1000, 1900), *range(2000, 2041), 5000]}, 7: 7}


def test_items_of_a_long_text_split_it_once(spark):
    words = [f"w{i * 7 % 1000}" for i in range(60_000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "a b c"), (3, "a  b "), (4, None)], "k long, text string")
    began = time.monotonic()
    got = {r.k: r.i for r in rows.select("k", fingerprints.word_items("text").alias("i")).collect()}
    assert time.monotonic() - began < 40  # a split for each item takes minutes
    item = lambda w: int(hashlib.md5(" ".join(w).encode()).hexdigest()[:8], 16)
    assert got == {1: [item(words[i : i + 4]) for i in range(len(words) - 3)], 2: [], 3: [item(["a", "", "b", ""])], 4: []}


def test_similarity_in_rounds_sends_a_list_once_a_block(spark, lists, monkeypatch):
    """A list goes to blocks of its partners, not along with each pair; small blocks and rounds give what one gives."""
    from tablemill.storage import scratch

    prints = spark.createDataFrame(list(lists.items()), "id long, items array<long>")
    pairs = spark.createDataFrame([(a, b) for a in lists for b in lists], "a_id long, b_id long")
    plan = fingerprints.similarity(prints, pairs, "id", "items")._jdf.queryExecution().optimizedPlan().toString()
    assert "_partners" in plan and not any("Join" in line and "a_id" in line for line in plan.splitlines())
    made = []
    stash = fingerprints.stash
    monkeypatch.setattr(fingerprints, "stash", lambda df, name: made.append(name) or stash(df, name))
    for name, value in (("BLOCK", 512), ("LEAST_BLOCK", 128), ("LEAST_ROUND", 1024)):
        monkeypatch.setattr(fingerprints, name, value)
    with scratch(spark):
        got = {(r.a_id, r.b_id): (r.shift, r.votes, r.matched, r.similarity) for r in fingerprints.similarity(prints, pairs, "id", "items").collect()}
    assert got == {(a, b): loops(x or [], y or []) for a, x in lists.items() for b, y in lists.items()}
    assert made.count("similar") > 3


def test_candidates_of_many_ranges_and_other_keys(spark, lists, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 16)
    named = {f"k{k:03}": v for k, v in lists.items()}
    for rows, kind in ((lists, "long"), (named, "string")):
        got = [tuple(r) for r in fingerprints.candidates(spark.createDataFrame(list(rows.items()), f"id {kind}, items array<long>"), "id", "items").collect()]
        holder = {}
        for key, items in sorted(rows.items()):
            for x in items or []:
                holder.setdefault(x, key)
        assert sorted(got) == sorted({(k, holder[x]) for k, items in rows.items() for x in items or [] if holder[x] != k})


def test_a_stash_leaves_no_shuffle_files(spark):
    from tablemill.storage import scratch, stash

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in (str(f) for f in manager.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in n}
    with scratch(spark):
        before = files()
        rows = spark.range(10000).groupBy(F.col("id") % 1000).count()
        assert stash(rows, "counts").count() == 1000
        assert len([n for n in files() - before if n.endswith(".data")]) <= 4  # of the count of the stash, not of what made it
        assert rows.count() == 1000  # made again
