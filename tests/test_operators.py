"""Operators against plain loops, with the awkward values."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablemill.functions import text, verdict
from tablemill.operators import dedup, joins, signal, state
from tablemill.operators.graph import components

EDGES = [300.0, 100.0, None, 102.0, 104.0, 102.0, 104.000001, 0.0, None, -5.0, 300.0005, 99.999999, 1e6, 1000001.5, 4.0, 1.9999999999999998]


def naive(values, tolerance=2.0):
    return {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(values), 2) if a is None or b is None or abs(a - b) <= tolerance}


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, v double")


@pytest.mark.parametrize("values", [EDGES, [100 + random.Random(4).choice([0, 1.9, 2, 2.1, 4]) for _ in range(60)], [], [None], [5.0]])
def test_band_pairs_equal_a_double_loop(spark, values):
    got = joins.band_pairs(frame(spark, values), "id", "v", 2.0).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == naive(values)


def test_band_pairs_of_non_finite_values(spark):
    got = {tuple(r) for r in joins.band_pairs(frame(spark, [float("nan"), float("inf"), -float("inf"), 1.0, 2.0, None]), "id", "v", 2.0).collect()}
    assert got == {(3, 4), (0, 5), (1, 5), (2, 5), (3, 5), (4, 5)}


def test_band_pairs_of_a_crowded_slot(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIGHT", 40)
    values = [7.0] * 160 + [float(i) for i in range(160)]  # half of the values are equal
    for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "false" if name.endswith("enabled") else "-1")
    try:
        pairs = joins.band_pairs(frame(spark, values), "id", "v", 2.0)
        rows = pairs.withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == len({(r.a_id, r.b_id) for r in rows}) and {(r.a_id, r.b_id) for r in rows} == naive(values)
    sizes = [sum(r.p == p for r in rows) for p in {r.p for r in rows}]
    assert len(sizes) == 4 and max(sizes) < 0.6 * len(rows)
    fresh = frame(spark, values).where("id % 40 = 1")
    got = {tuple(r) for r in joins.band_pairs(frame(spark, values), "id", "v", 2.0, fresh).collect()}
    assert got == {(i, j) for i in range(1, 320, 40) for j in range(320) if i != j and abs(values[i] - values[j]) <= 2}


def test_components_equal_union_find(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, 500), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a_id long, b_id long")).collect()
    assert {r.id: r.component for r in got} == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a_id long, b_id long")).count() == 0


def test_components_deal_only_where_a_key_has_many_rows(spark, monkeypatch):
    deal, dealt = joins.dealt_join, []
    monkeypatch.setattr(joins, "dealt_join", lambda *a, **k: dealt.append(a[2]) or deal(*a, **k))
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)]
    for light, keys in ((joins.LIGHT, set()), (20, {"y", "c"})):
        monkeypatch.setattr(joins, "LIGHT", light)
        dealt.clear()
        got = components(spark.createDataFrame(edges, "a_id long, b_id long")).collect()
        assert {r.id: r.component for r in got} == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
        assert {k for on in dealt for k in on} == keys


def test_steps_equal_the_whole(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([10.0, 11.5, 13.0, 60.0, None]), [rng.choice([0, 0, 0, -1]) & 0xFFFFFFFF for _ in range(4)]) for i in range(24)]

    def table(ids):
        return spark.createDataFrame([r for r in rows if r[0] in ids], "id long, v double, words array<long>")

    def halved(a, b):
        return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / 4

    edges = spark.createDataFrame([], "a_id long, b_id long, similarity double")
    scanned = spark.createDataFrame([], "id long")
    from tablemill.storage import stash

    for ids in ({*range(10)}, {*range(3, 16)}, {*range(24)} - {5, 6}):
        edges, scanned = dedup.scan_step(edges, scanned, table(ids), "id", "v", "words", 2.0, score=halved)
        edges, scanned = stash(edges, "edges"), stash(scanned, "scanned")
        whole = dedup.similar_edges(joins.band_pairs(table(ids), "id", "v", 2.0), table(ids), "id", "words", halved)
        assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, whole.collect()))
        assert {r.id for r in scanned.collect()} == ids


def test_weakest_link_and_keep(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.7), (8, 9, 0.95)], "a_id long, b_id long, similarity double")
    rows = spark.createDataFrame([(1, False, 320, 100.0), (2, True, None, 99.0), (3, True, 900, None), (8, False, 128, 5.0), (9, False, 128, 5.0)], "id long, l boolean, b long, d double")
    got = {r.id: r for r in dedup.groups(edges, rows, "id", F.col("l"), F.col("b"), F.col("d"), F.lit(False)).collect()}
    assert {i: r.component for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert got[1].similarity == 0.7 and [i for i, r in got.items() if r.recommend_keep] == [3, 8] or sorted(i for i, r in got.items() if r.recommend_keep) == [3, 8]
    assert got[2].reason == "lossless" and got[1].reason == "lossy, 320 kbps"


def test_verdict_limits(spark):
    cases = [
        (21000.0, "lossless", "lossless", None, -1.0, None, "ok"), (21000.0, "lossless", "lossless", None, -5.9, None, "grey"), (21000.0, "lossless", "lossless", None, None, -24.0, "grey"),
        (19500.0, "lossless", "lossless", None, None, None, "fake"), (19700.0, "lossless", "lossless", None, None, None, "grey"), (0.0, "lossless", "lossless", None, None, None, "grey"),
        (21000.0, "lossless", "lossy", None, None, None, "fake"), (18999.0, "lossy", "lossy", 320, None, None, "fake"), (19000.0, "lossy", "lossy", 320, None, None, "ok"),
        (0.0, "lossy", "lossy", 320, None, None, "grey"), (11999.0, "lossy", "lossy", 64, None, None, "fake"), (500.0, "lossy", "lossy", None, None, None, "ok"), (21000.0, "unknown", "unknown", None, None, None, "grey"),
    ]
    rows = spark.createDataFrame(cases, "c double, d string, k string, b long, f double, t double, want string")
    judged = rows.select("want", verdict.verdict(*(F.col(x) for x in "cdkbft")).alias("got")).collect()
    assert [r.got for r in judged] == [r.want for r in judged]


def test_text_functions(spark):
    rows = spark.createDataFrame([("Béatrice", "Él  Niño!", "a/b/Song.AIF"), ("", "x", "PIONEER/x.dat"), (None, "y", ".hidden"), ("A", "B", "pioneer/z"), ("A", "B", "noext")], "a string, t string, p string")
    got = rows.select(text.name_key(F.col("a"), F.col("t")).alias("k"), text.usage_bucket(F.col("p")).alias("b"), text.stem(F.col("p")).alias("s")).collect()
    assert [r.k for r in got] == ["beatrice el nino", "x", "y", "a b", "a b"]
    assert [r.b for r in got] == [".aiff", "PIONEER/", "(sans extension)", "PIONEER/", "(sans extension)"]
    assert [r.s for r in got] == ["Song", "x", ".hidden", "z", "noext"]
    one = spark.range(1).select(text.integer_list(F.lit("1, 2,x,,30")).alias("i"), text.clock(F.lit(119.7)).alias("c"), text.sanitize(F.lit(' a<b>:"c" ')).alias("f")).first()
    assert (one.i, one.c, one.f) == ([1, 2, 30], "1:60", "a b c")


def test_upsert_keeps_the_verdict(spark):
    tracks = spark.createDataFrame([(1, "a", 5, 1, "filed", "ok", "r"), (2, "b", 5, 1, "filed", "ok", "r"), (9, "gone", 1, 1, "filed", None, None)], "id long, path string, size_bytes long, mtime long, status string, verdict string, report_json string")
    listing = spark.createDataFrame([("a", 5, 1), ("b", 6, 1), ("c", 1, 1), ("d", 1, 1)], "path string, size_bytes long, mtime long")
    got = {r.path: r for r in state.upsert_files(tracks, listing).collect()}
    assert (got["a"].status, got["a"].report_json) == ("filed", "r") and (got["b"].status, got["b"].verdict, got["b"].report_json) == ("pending", "ok", None)
    assert {got["c"].id, got["d"].id} == {10, 11} and got["gone"].status == "filed"


def test_snapshot_of_nulls(spark):
    new = spark.createDataFrame([("a", None), ("b", 2), ("c", 1)], "path string, size long")
    old = spark.createDataFrame([("a", None, "pending"), ("b", 1, "pending"), ("x", 1, "pending"), ("y", 1, "filed")], "path string, size long, status string")
    got = {r.path: r.change for r in joins.snapshot_diff(new, old, "path", ["size"], F.col("status") == "pending").collect()}
    assert got == {"a": "unchanged", "b": "updated", "c": "added", "x": "removed", "y": "kept"}


def test_spectrum_of_known_signals():
    import numpy as np

    rate = 44100
    noise = np.random.default_rng(0).normal(size=rate)
    low = np.fft.irfft(np.where(np.fft.rfftfreq(rate, 1 / rate) < 16000, np.fft.rfft(noise), 0), rate)
    assert signal.spectrum_cutoff(np.zeros(100), rate) == 0 and signal.spectrum_cutoff(noise, rate) == rate / 2
    assert 15500 < signal.spectrum_cutoff(low, rate) < 16800
    assert signal.flatness(noise, rate, 16000, 20000) > -4 and signal.flatness(noise, rate, 16000, 16050) is None


def test_stereo_measures_of_blocks(spark):
    blocks = spark.createDataFrame([(1, 2, 8, 0, [0.5, 0.5, -0.5, -0.5]), (1, 2, 8, 1, [0.5, 0.5]), (2, 1, 8, 0, [0.1, 0.2, 0.3])], "track_id long, channels int, sample_rate int, block_id long, samples array<float>")
    rows = signal.samples(blocks)
    assert sorted(r.position for r in rows.where("track_id = 1").collect()) == [0, 1, 2]
    got = {r.track_id: r for r in signal.stereo_measures(rows, "track_id", "left", "right").collect()}
    assert got[1].dual_mono and abs(got[1].phase - 1) < 1e-9 and abs(got[1].dc_offset - 0.5 / 3) < 1e-6 and abs(got[2].peak_db + 10.4576) < 1e-3


def test_cutoff_against_its_definition():
    """The cutoff by plain loops over smoothed levels, on spectra with cliffs, notches and slopes."""
    import math

    import numpy as np

    def loops(power, n, rate):
        hz, bins = rate / 4096, len(power)
        level = [-120.0 if p / n <= 1e-12 else 10 * math.log10(p / n) for p in power]
        smooth = [sum(level[max(0, k - 5) : k + 6]) / len(level[max(0, k - 5) : k + 6]) for k in range(bins)]
        band = max(2, math.ceil(500 / hz))
        margin = band + 6
        for k in range(bins - margin - 1, max(margin, math.ceil(2000 / hz)) - 1, -1):
            below, above = sum(smooth[k - band : k]) / band, sum(smooth[k + 1 : k + band + 1]) / band
            if below - above >= 18 and not any(smooth[j] >= below - 9 for j in range(k + band + 1, bins, band)):
                return k * hz
        return bins * hz

    rng = np.random.default_rng(4)
    for rate in (44100, 48000):
        for cliff, fall, notch in ((1500, 60, None), (1500, 15, None), (1800, 40, (900, 1000)), (300, 50, None), (2040, 80, None), (1200, 30, (600, 660))):
            db = rng.normal(0, 2, 2048)
            db[cliff:] -= fall
            if notch:
                db[notch[0] : notch[1]] -= 70
            power = 10 ** (db / 10) * 7
            assert abs(signal.cutoff_of(power, 7, rate) - loops(power, 7, rate)) < 1e-6
    assert signal.cutoff_of(np.ones(2048), 0, 44100) == 0 and signal.cutoff_of(np.ones(60), 1, 44100) == 60 * 44100 / 4096


def test_spectra_and_grid_against_one_signal(spark):
    import numpy as np

    rate = 44100
    x = np.random.default_rng(6).normal(0, 0.2, 4096 * 3 + 100)
    stereo = np.stack([x + 0.1, x - 0.1], axis=1).ravel()  # interleaved; their mean is x
    cut = [(1, rate, 2, b, stereo[b * 8192 : (b + 1) * 8192].tolist()) for b in range(-(-len(stereo) // 8192))]
    rows = spark.createDataFrame(cut + [(2, rate, 1, 0, [0.5])], "track_id long, sample_rate int, channels int, block_id long, samples array<double>").repartition(5)
    got = {r.track_id: r for r in signal.spectra(rows).collect()}
    assert abs(got[1].cutoff_hz - signal.spectrum_cutoff(x, rate)) < 1e-6 and abs(got[1].flat_fixed - signal.flatness(x, rate, 16000, 20000)) < 1e-9
    assert (got[2].cutoff_hz, got[2].flat_fixed, got[2].flat_top) == (0.0, None, None)
    grid = {r.column: r.levels for r in signal.spectrogram(rows, 4096, most_columns=2).collect()}
    frames = [x[s : s + 4096] * np.hanning(4096) for s in range(0, len(x) - 4095, 2048)][::2][::2]
    assert sorted(grid) == list(range(len(frames)))
    full = (np.hanning(4096).sum() / 2) ** 2
    for column, frame in enumerate(frames):
        power = np.abs(np.fft.fft(frame)[:2048]) ** 2
        level = ((np.clip(10 * np.log10(power / full), -100, 0) + 100) / 100 * 255).astype(int)
        want = [level[b : b + 6].max() for b in range(0, 2048, 6)]
        assert max(abs(a - b) for a, b in zip(want, grid[column])) <= 1 and len(want) == len(grid[column])


def test_moved_and_requeued_tracks_are_joined_once(spark):
    tracks = spark.createDataFrame([(1, "a", "pending"), (2, "b", "filed"), (3, "c", None), (4, "d", "resourcing"), (None, "e", "pending")], "id long, path string, status string")
    actions = spark.createDataFrame([(5, 4, "reject", "d", False)], "id long, track_id long, type string, from_path string, undone boolean")
    ids = spark.createDataFrame([(1,), (1,), (3,), (4,), (None,), (9,)], "id long")
    after, journal = state.move_tracks(tracks, actions, ids, "reject", "resourcing", ["pending"])
    back, closed = state.requeue(tracks, actions, ids)
    assert {r.path: r.status for r in after.collect()} == {"a": "resourcing", "b": "filed", "c": None, "d": "resourcing", "e": "pending"}
    assert sorted(map(tuple, journal.collect())) == [(5, 4, "reject", "d", False), (6, 1, "reject", "a", False)]
    assert {r.path: r.status for r in back.collect()} == {"a": "pending", "b": "filed", "c": None, "d": "pending", "e": "pending"}
    assert [tuple(r) for r in closed.collect()] == [(5, 4, "reject", "d", True)]
    for out in (after, back):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
