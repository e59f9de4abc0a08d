"""Hard negatives against plain loops, SQL, and several blocks of anchors and rows."""

import math
import random
import struct

import duckdb
import pytest

from tablemill.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, slot int, score string, rank int"


def brute(rows, low=80, high=100):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((i, [math.floor(256 * x) for x in v], label))
    by = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, v, label in kept:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in kept if j != i]
        for score, positive, _ in sorted((s for s in scored if s[2] == label), key=by)[:5]:
            near = sorted((s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score), key=by)[:5]
            out += [(i, positive, rank, s[1], score, s[0]) for rank, s in enumerate(near, 1)]
    return sorted(out, key=repr)


def rows_of(n, seed=3, width=6):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    return [(i, [single(x + rng.gauss(0, 0.4)) for x in rng.choice(centre)], rng.randint(0, 3)) for i in range(n)]


@pytest.fixture
def odd():
    rows = rows_of(420)
    same = rows[200][1]
    rows += [(1000 + i, same, i % 3) for i in range(40)]  # ties
    rows += [(2100, [1.0, math.nan] * 3, 1), (2200, None, 1), (2300, [1.0] * 6, None), (2400, [math.inf] * 6, 1), (2500, [None] * 6, 1)]
    rows += [(None, same, 1), (None, same, 2), (2600, [], 1), (2700, [2.0, 1.0], 2), (2800, [0.0] * 6, 3), (2900, [3.0e4] * 6, 2), (300, rows[300][1], rows[300][2])]
    return rows


@pytest.mark.parametrize("block, size, low", [(2048, 16384, 80), (2, 50, 80), (2048, 7, 1)])
def test_against_loops(spark, odd, monkeypatch, block, size, low):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ROWS", size)
    rng = random.Random(block)
    rows = rng.sample(odd, len(odd))
    table = spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA).repartition(3)
    got = negatives.mine(table, low=low)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, low)


def test_huge_components_saturate(spark):
    rows = [(0, [1e300, 1.0], 0), (1, [1e300, 1.0], 1), (2, [1e300, 1.0], 2), (3, [-1e300, 1.0], 2)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), relabel_every=1000)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_empty_table_and_no_anchor(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1, *[None] * 5)], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, [1.0], 1, *[None] * 5)], SCHEMA)).count() == 0


def test_sql_equals_loops():
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding float[], label int)")
    rows = rows_of(320, seed=8) + [(2100, [1.0, math.nan], 1), (2200, None, 1), (400, [0.5] * 6, None)]
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(negatives.ORACLE_SQL).fetchall(), key=repr) == brute(rows)
