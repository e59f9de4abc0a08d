"""Sources: listings, sampled audio, tables, XML and JSON catalogues; and state changes."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tablemill import schemas
from tablemill.operators import state
from tablemill.sources import catalogues, files

XML = """<?xml version="1.0"?><DJ_PLAYLISTS><COLLECTION>
<TRACK TrackID="1" Name="One &amp; Two" Artist="A" Location="file://localhost/C:/M%20x/one+1.mp3"/><TRACK TrackID="2" Location="file://localhost/b.wav"/></COLLECTION>
<PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="Sets"><NODE Type="1" Name="Late"><TRACK Key="2"/><TRACK Key="1"/></NODE></NODE><NODE Type="1" Name="All"><TRACK Key="1"/></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>"""


def wav(frames, channels=2, rate=8000):
    body = struct.pack(f"<{len(frames)}h", *frames)
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def test_listing_and_samples(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.WAV").write_bytes(wav([16384, -16384] * 5000))
    (tmp_path / "y.mp3").write_bytes(b"ID3")
    (tmp_path / "notes.txt").write_text("no audio")
    found = {r.filename: r.size_bytes for r in files.listing(spark, str(tmp_path)).collect()}
    assert found == {"x.WAV": 20044, "y.mp3": 3} and files.listing(spark, str(tmp_path), False).count() == 3
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    rails = {r.path.rpartition("/")[2]: r.rail for r in raw.select("path", files.content_rail(F.col("content")).alias("rail")).collect()}
    assert rails == {"x.WAV": "lossless", "y.mp3": "lossy", "notes.txt": "unknown"}
    blocks = files.wav_blocks(raw).orderBy("block_id").collect()
    assert [len(b.samples) for b in blocks] == [8192, 1808] and blocks[0].samples[:2] == [0.5, -0.5]


def test_semicolon_table(spark, tmp_path):
    (tmp_path / "scan.csv").write_text("rail;bitrate;cutoff;verdict;est;hf;top;file\nlossy;320;19000.5;Ok;320;-;-3.5;a;b.mp3\n-- end\nlossless;-;20000;Fake;-;;-;c.flac\n")
    got = sorted(files.measured_table(spark, str(tmp_path / "scan.csv")).collect(), key=lambda r: r.file)
    assert tuple(got[0]) == ("lossy", 320.0, 19000.5, "Ok", 320.0, None, -3.5, "a;b.mp3") and got[1].bitrate is None


def test_xml_catalogue(spark, tmp_path):
    path = tmp_path / "export.xml"
    path.write_text(XML)
    tracks = catalogues.collection(spark, str(path)).withColumn("local", catalogues.local_path(F.col("location")))
    assert sorted((r.track_id, r.name, r.local) for r in tracks.collect()) == [(1, "One & Two", "C:/M x/one+1.mp3"), (2, None, "b.wav")]
    tree = catalogues.playlists(spark, str(path))
    assert [(r.path, r.depth, r.is_folder, r.track_ids) for r in sorted(tree.collect(), key=lambda r: r.seq)] == [(["Sets"], 1, True, []), (["Sets", "Late"], 2, False, [2, 1]), (["All"], 1, False, [1])]
    assert catalogues.playlist_count(tree).first().playlists == 2


def test_playlist_trees_of_odd_exports(spark, tmp_path):
    deep = "".join(f"<NODE Type='0' Name='n{i}'>" for i in range(12)) + "<NODE Name='leaf &amp; &lt;x>' Type='1'><TRACK Key='9'></TRACK></NODE>" + "</NODE>" * 12
    (tmp_path / "a.xml").write_text(f"<DJ_PLAYLISTS><PLAYLISTS><NODE Type='0' Name='ROOT'><!-- <NODE Name='no'> -->{deep}<NODE\n Type='1' Name='empty'/><NODE Type='1'/></NODE></PLAYLISTS></DJ_PLAYLISTS>")
    (tmp_path / "b.xml").write_text("<DJ_PLAYLISTS><COLLECTION><TRACK TrackID='1' Location='x'/></COLLECTION></DJ_PLAYLISTS>")
    got = sorted(catalogues.playlists(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    names = [f"n{i}" for i in range(12)]
    assert [(r.path, r.depth, r.is_folder, r.track_ids) for r in got[:12]] == [(names[: i + 1], i + 1, True, []) for i in range(12)]
    assert [(r.path, r.depth, r.is_folder, r.track_ids) for r in got[12:]] == [([*names, "leaf & <x>"], 13, False, [9]), (["empty"], 1, False, []), ([""], 1, False, [])]
    (tmp_path / "c.xml").write_text("<PLAYLISTS><NODE Type='0' Name='ROOT'/></PLAYLISTS>")
    with pytest.raises(Exception, match="root is missing"):
        catalogues.playlists(spark, str(tmp_path))


def test_search_responses(spark):
    body = {"results": [
        {"id": 5, "title": "Mira Kell (2)* - Ferry", "year": "1999", "label": ["", "Low"], "format": ["CD", "Compilation"], "style": ["House"], "country": ""},
        {"id": 6, "title": " ", "format": ["Vinyl"]}, {"id": 7, "title": "Ferry", "year": "x", "format": ["Vinyl", "EP"]},
    ]}
    rows = spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None)], "k long, body string")
    got = sorted(catalogues.candidates(rows, "k", "body").collect(), key=lambda r: r["rank"])
    assert [(r.release_id, r.artist, r.title, r.label, r.year, r.country, r.formats) for r in got] == [("7", "", "Ferry", None, None, None, "Vinyl, EP"), ("5", "Mira Kell", "Ferry", "Low", 1999, None, "CD, Compilation")]


def tracks(spark):
    rows = [{"id": i, "path": f"p{i}", "status": s, "verdict": "ok", "source_id": i % 2, "report_json": "r"} for i, s in ((1, "pending"), (2, "filed"), (3, "resourcing"))]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schemas.TRACKS.fields) for r in rows], schemas.TRACKS)


def test_analysis_state(spark):
    start, one = tracks(spark), spark.createDataFrame([(1, "fake")], "id long, verdict string")
    done = {r.id: r for r in state.persist_reports(start, one, ["verdict"], {"verdict_ver": 1}).collect()}
    assert (done[1].verdict, done[1].verdict_ver, done[2].verdict_ver) == ("fake", 1, None)
    failed = {r.id: r for r in state.persist_failures(start, one, ["verdict"]).collect()}
    assert (failed[1].verdict, failed[1].report_json, failed[1].analysis_attempts, failed[2].analysis_attempts) == (None, "", 1, 0)
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    reset = {r.id: r for r in state.reset_analysis(start, ids).collect()}
    assert reset[1].verdict is None and reset[2].verdict == "ok"


def test_moves_and_cascades(spark):
    start, ids = tracks(spark), spark.createDataFrame([(1,), (3,)], "id long")
    journal = spark.createDataFrame([(40, 3, "reject", None, None, None, False, None, None, None)], schemas.ACTIONS)
    after, log = state.move_tracks(start, journal, ids, "reject", "resourcing", ["pending"])
    assert {r.id: r.status for r in after.collect()} == {1: "resourcing", 2: "filed", 3: "resourcing"} and {(r.id, r.track_id) for r in log.collect()} == {(40, 3), (41, 1)}
    back, closed = state.requeue(after, log, ids)
    assert {r.id: r.status for r in back.collect()} == {1: "pending", 2: "filed", 3: "pending"} and all(r.undone for r in closed.collect())
    sources = spark.createDataFrame([(0, "a", True, None, None), (1, "b", True, None, None)], schemas.SOURCES)
    kinds = spark.createDataFrame([(1, "g", 0), (2, "h", 0)], schemas.GENRES)
    left, kept, children, events = state.delete_sources(sources, start, {"genres": kinds}, log, sources.where("id = 1"))
    assert left.count() == 1 and [r.id for r in kept.collect()] == [2] and [r.track_id for r in children["genres"].collect()] == [2] and all(r.track_id is None for r in events.collect())


def test_cache_and_settings(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", "old", 7), ("b", "kept", 8), ("c", "", 8)], "k string, v string, version int")
    got = state.read_through(keys, cache, "k", "v", 8, lambda misses: misses.withColumn("v", F.lit("new")))
    assert sorted(map(tuple, got.collect())) == [("a", "new"), ("b", "kept"), ("c", "new")]
    table = spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string")
    assert sorted(map(tuple, state.set_values(table, spark.createDataFrame([("y", "3"), ("z", "4")], "key string, value string"), "key").collect())) == [("x", "1"), ("y", "3"), ("z", "4")]


def test_a_walk_lists_what_a_listing_does_without_a_task_for_a_few_files(spark, tmp_path):
    for folder in ("a", "b/c/d", "_made", "b/.hidden", "none"):
        (tmp_path / folder).mkdir(parents=True)
    for name, size in {"top.WAV": 3, "a/x.mp3": 5, "a/.x.mp3": 1, "a/_x.mp3": 1, "_made/y.mp3": 2, "b/.hidden/z.mp3": 2, "b/c/d/ü 1.flac": 9, "b/c/n.txt": 4}.items():
        (tmp_path / name).write_bytes(b"x" * size)
    for i in range(1, 300):
        (tmp_path / f"a/{i}.ogg").write_bytes(b"o" * i)
    for audio in (True, False):
        for root in (str(tmp_path), f"file://{tmp_path}"):
            found = files.walk(spark, root, audio)
            columns = ["filename", "size_bytes", "mtime"]
            assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, files.listing(spark, str(tmp_path), audio).select(columns).collect()))
            assert found.rdd.getNumPartitions() < 40
    (tmp_path / "b/empty.opus").touch()
    assert [r.size_bytes for r in files.walk(spark, str(tmp_path)).where("filename = 'empty.opus'").collect()] == [0]
