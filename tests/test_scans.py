"""Scans over ranges, windows in blocks and medians by narrowing ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tablemill.operators import aggregates, scans


@pytest.fixture
def rows():
    rng = random.Random(3)
    out = [(0, i, float(rng.randint(0, 9))) for i in range(3000)]  # one group holds nearly all rows
    out += [(g, i, float(rng.randint(0, 9))) for g in range(1, 30) for i in range(rng.randint(1, 9))] + [(None, i, 5.0) for i in range(7)]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "g long, o long, v double").repartition(5)


def ordered(rows):
    groups = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((o, v))
    return groups


def test_numbers_follow_the_order_and_one_group_spreads(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = scans.numbered(frame(spark, rows), ["g"], ["o"], "pos")
        want = {(g, o, v, i) for g, own in ordered(rows).items() for i, (o, v) in enumerate(own)}
        assert {tuple(r) for r in placed.collect()} == want and placed.columns == ["g", "o", "v", "pos"]
        ranges = frame(spark, rows).repartitionByRange("g", "o").where("g = 0").groupBy(F.spark_partition_id()).count().collect()
        assert len(ranges) == 4 and max(r["count"] for r in ranges) < 1200
        assert scans.numbered(frame(spark, rows).limit(0), ["g"], ["o"], "pos").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("position", [None, "pos"])
def test_runs(spark, rows, position):
    given = frame(spark, rows)
    given = scans.numbered(given, ["g"], ["o"], "pos") if position else given
    got = sorted((str(r.g), r.length) for r in scans.runs(given, "g", ["o"], F.col("v") >= 4, position).collect())
    want = []
    for g, own in ordered(rows).items():
        n = 0
        for _, v in [*own, (0, -1.0)]:
            if v >= 4:
                n += 1
            elif n:
                want.append((str(g), n))
                n = 0
    assert got == sorted(want)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_windows_in_blocks(spark, rows, block):
    placed = scans.numbered(frame(spark, [r for r in rows if r[0] is not None and (r[0] or r[1] < 60)]), ["g"], ["o"], "pos")
    got = scans.neighbours(placed, "g", "pos", {"near": (F.sum("v"), -2, 3), "ahead": (F.count("v"), 1, 4)}, block)
    want = set()
    for g, own in ordered([tuple(r)[:3] for r in placed.collect()]).items():
        v = [x for _, x in own]
        want |= {(g, o, x, i, sum(v[max(0, i - 2) : i + 4]), len(v[i + 1 : i + 5])) for i, (o, x) in enumerate(own)}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("few, cuts", [(1 << 20, 1024), (4, 3), (1, 2)])
def test_medians_of_large_groups(spark, few, cuts):
    rng = random.Random(few)
    values = [(0, rng.choice([rng.gauss(0, 1), 2.0, -1e300, 1e300, 1e-300, 5e-324])) for _ in range(401)] + [(1, 7.0)] * 30 + [(2, 1.0), (2, 2.0), (3, None), (None, 3.0), (None, 9.0), (4, float("nan"))]
    given = spark.createDataFrame(values, "g long, v double")
    got = {r.g: r.median for r in aggregates.upper_medians(given, ["g"], "v", few, cuts).collect()}
    groups = {}
    for g, v in values:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert got == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    every = sorted(v for own in groups.values() for v in own)
    assert [r.median for r in aggregates.upper_medians(given, [], "v", few, cuts).collect()] == [every[len(every) // 2]]
    assert aggregates.upper_medians(given.limit(0), [], "v", few, cuts).count() == 0
