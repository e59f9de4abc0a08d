"""Streams over arriving files give what the batch form gives."""

import json
import random

from pyspark.sql import functions as F

from tablemill import schemas
from tablemill.session import stateful
from tablemill.operators import state
from tablemill.streaming import quiet, watch
from tablemill.storage import scratch
from tablemill.streaming.duplicates import ClassIndex, DuplicateIndex
from tablemill.streaming.store import BucketStore


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("path", "filename", "size_bytes", "mtime"), r))) + "\n" for r in rows))


def test_listings_are_applied_batch_by_batch(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, path string, size_bytes long, mtime long, status string, verdict string, report_json string")
    here, kept = tmp_path / "in", str(tmp_path / "state")
    batches = [[("a", "a", 1, 1), ("b", "b", 1, 1)], [("b", "b", 2, 1), ("c", "c", 1, 1)]]
    store = BucketStore(spark, kept, empty.schema, ["path"], 8, "id")
    store.write(empty)
    want = empty
    for n, rows in enumerate(batches):
        drop(here, f"{n}.json", rows)
        watch.apply_batches(watch.listing_stream(spark, str(here)), store, lambda before, batch: state.upsert_files(before, batch, store.largest()), str(tmp_path / "log")).awaitTermination()
        want = state.upsert_files(want, spark.createDataFrame(rows, schemas.LISTING))
    assert store.version() == 2
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, want.collect()))


def test_work_is_queued_once(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(source).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schemas.EVENTS).parquet(str(tmp_path / "events"))
    query = watch.distinct_work(stream, ["user_id"], "ts", "90 days").writeStream.format("memory").queryName("queued").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("queued").count() == spark.read.parquet(source).select("user_id").distinct().count()


def test_windows_of_events(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schemas.EVENTS).parquet(str(tmp_path / "events"))
    query = watch.counts_by_window(stream, "ts", "1 day", "1 hour", "event_type").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) as n from windows").first().n == source.count()


def test_file_events_notify_once_and_old_states_go(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, path string, size_bytes long, mtime long, status string, verdict string, report_json string")
    here, kept, told, seen = tmp_path / "in", str(tmp_path / "state"), [], []
    here.mkdir()
    listener = watch.ProgressEvery(2, seen.append)
    spark.streams.addListener(listener)
    kind = "path string, kind string, size_bytes long, mtime long, at long"
    batches = [[("a", "create", 1, 1, 1), ("b", "create", 1, 1, 2), ("b", "remove", 0, 0, 3)], [("x", "remove", 0, 0, 1)], [("a", "modify", 2, 1, 1), ("a", "remove", 0, 0, 0)], [("a", "remove", 0, 0, 9)]]
    store, states = BucketStore(spark, kept, empty.schema, ["path"], 8, "id"), []
    store.write(empty)
    for n, rows in enumerate(batches):
        (here / f"{n}.json").write_text("".join(json.dumps(dict(zip(("path", "kind", "size_bytes", "mtime", "at"), r))) + "\n" for r in rows))
        stream = spark.readStream.schema(kind).json(str(here))
        watch.apply_batches(stream, store, lambda before, batch: state.apply_events(before, batch, "at", store.largest()), str(tmp_path / "log"), lambda n, _: told.append(n)).awaitTermination()
        states.append(sorted((r.path, r.size_bytes, r.status) for r in store.read(n + 1).collect()))
    spark.streams.removeListener(listener)
    assert states == [[("a", 1, "pending")], [("a", 1, "pending")], [("a", 2, "pending")], []]
    assert told == [0, 2, 3] and [store.manifest(v) is not None for v in range(5)] == [False, False, False, True, True]
    assert seen and seen == sorted(seen)


def test_events_in_order_against_a_walk(spark):
    rng = random.Random(12)
    rows = [(i, f"p{i}", rng.choice(["pending", "filed", "resourcing"]), 1, 0, "report") for i in range(40)]
    events = [(f"p{rng.randrange(50)}", rng.choice(["create", "modify", "modify", "remove"]), rng.choice([1, 1, 1, 2]), 0, at) for at in range(160)]
    held = {r[1]: dict(zip(("id", "path", "status", "size", "mtime", "report"), r)) for r in rows}
    for path, kind, size, _, _ in events:
        old = held.get(path)
        if kind == "remove":
            if old and old["status"] == "pending":
                del held[path]
        elif old is None:
            held[path] = {"id": None, "path": path, "status": "pending", "size": size, "report": None}
        elif old["size"] != size:
            old |= {"status": "pending", "size": size, "report": None}
    tracks = spark.createDataFrame(rows, "id long, path string, status string, size_bytes long, mtime long, report_json string")
    got = state.apply_events(tracks, spark.createDataFrame(events, "path string, kind string, size_bytes long, mtime long, at long"), "at").collect()
    new = {r.path for r in got if r.id >= 40}
    assert len({r.id for r in got}) == len(got) and new == {p for p, r in held.items() if r["id"] is None}
    assert {(r.path, r.status, r.size_bytes, r.report_json) for r in got} == {(r["path"], r["status"], r["size"], r["report"]) for r in held.values()}


def test_store_replaces_touched_buckets_only(spark, tmp_path):
    rows = spark.range(300).selectExpr("id", "concat('k', id) as k", "id * 2 as v")
    store = BucketStore(spark, str(tmp_path), rows.schema, ["k"], 16, "id")
    assert store.version() == -1 and store.read().count() == 0
    store.write(rows)
    assert store.largest() == 299 and sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.collect()))
    first, names = store.files(), lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("v0/*/*.parquet")}
    before = names()

    def put(held, changes):
        return held.join(changes.select("k"), "k", "left_anti").unionByName(changes)

    change = spark.createDataFrame([(7, "k7", -1), (400, "k400", 0)], "id long, k string, v long")
    changed = store.apply(change, put, 1)
    assert 1 <= len(changed) <= 2 and store.largest() == 400 and names() == before
    assert {b for b, f in store.files().items() if f != first.get(b)} == changed
    assert {r.k: r.v for r in store.read().collect()} == {f"k{i}": i * 2 for i in range(300)} | {"k7": -1, "k400": 0}
    assert store.apply(change, put, 1) == changed  # a batch that comes again
    assert store.apply(change, put, 2) == set() and store.files() == store.files(1)  # nothing new: no new file
    assert store.apply(change.limit(0), put, 3) == set()
    assert len(store.apply(change, lambda held, changes: held.join(changes.select("k"), "k", "left_anti"), 4)) == len(changed)
    assert store.read().count() == 299
    store.forget()
    assert store.manifest(2) is None and store.read().count() == 299 and store.read(3).count() == 301
    (tmp_path / "v5").mkdir()  # what a broken write left is replaced
    assert store.apply(change, put, 5) == changed and store.read().count() == 301


def test_store_hands_over_met_rows_only_and_writes_nothing_for_no_change(spark, tmp_path):
    rng = random.Random(19)
    schema = "id long, k string, v double"
    pick = lambda i: (i, rng.choice([None, *(f"k{j}" for j in range(40))]), rng.choice([None, 1.5, -0.5]))
    rows = [pick(i) for i in range(120)]  # several rows a key, and null keys
    store = BucketStore(spark, f"{tmp_path}/a", spark.createDataFrame([], schema).schema, ["k"], 6, "id")
    store.write(spark.createDataFrame(rows, schema))
    for version in range(1, 5):
        # New rows, among them of new keys, for some keys; the third batch takes the largest ids away, the last one brings the same again.
        changes = [(1000 * version + i, rng.choice([None, "k1", "k2", f"n{version}"]), 2.0) for i in range(4)] if version < 3 else [r for r in rows if r[0] > 900] if version == 3 else [(0, "k5", 0.0)]
        met, seen = {c[1] for c in changes}, []

        def step(held, given):
            seen.extend(map(tuple, held.collect()))
            return held if version == 4 else given.limit(0) if version == 3 else given

        changed = store.apply(spark.createDataFrame(changes, schema), step, version)
        assert sorted(map(str, seen)) == sorted(str(r) for r in rows if r[1] in met)
        if version < 4:
            rows = [r for r in rows if r[1] not in met] + (changes if version < 3 else [])
        assert sorted(map(str, map(tuple, store.read().collect()))) == sorted(map(str, rows))
        assert (tmp_path / "a" / f"v{version}").exists() == bool(changed) == (version < 4)
        whole = BucketStore(spark, f"{tmp_path}/b{version}", store.schema, ["k"], 6, "id")
        whole.write(spark.createDataFrame(rows, schema))
        told = [{b: (e["n"], e["digest"], e["most"]) for b, e in s.manifest(s.version()).items()} for s in (store, whole)]
        assert told[0] == told[1] and store.largest() == max(r[0] for r in rows)


def test_events_of_many_contents_against_a_walk(spark):
    rng = random.Random(91)
    rows = [(i, f"p{i}", rng.choice(["pending", "filed", None]), rng.choice([1, None]), 0, "report") for i in range(60)] + [(60, None, "pending", 1, 0, "report")]
    events = [(rng.choice([f"p{rng.randrange(80)}"] * 19 + [None]), rng.choice(["create", "modify", "modify", "remove"]), rng.choice([1, 1, 2, None]), rng.choice([0, 0, 1]), at) for at in range(240)]
    held = {r[1]: {"old": True, "status": r[2], "content": (r[3], r[4]), "report": r[5]} for r in rows if r[1]}
    for path, kind, size, time, _ in events:
        old = held.get(path)
        if kind == "remove":
            if old and old["status"] == "pending":
                del held[path]
        elif old is None:
            held[path] = {"old": False, "status": "pending", "content": (size, time), "report": None}
        elif old["content"] != (size, time):
            old |= {"status": "pending", "content": (size, time), "report": None}
    tracks = spark.createDataFrame(rows, "id long, path string, status string, size_bytes long, mtime long, report_json string")
    with scratch(spark):
        got = state.apply_events(tracks, spark.createDataFrame(events, "path string, kind string, size_bytes long, mtime long, at long"), "at").collect()
    # A null path is no track's path: the stored row stays, and the events of null paths make a file of their own.
    want = [(p, r["status"], *r["content"], r["report"]) for p, r in held.items()] + [(None, "pending", 1, 0, "report")]
    assert sorted(str((r.path, r.status, r.size_bytes, r.mtime, r.report_json)) for r in got) == sorted(map(str, want))
    assert len({r.id for r in got}) == len(got) and {r.path for r in got if r.id > 60} == {p for p, r in held.items() if not r["old"]}


def test_quiet_keys(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    parts = [[("a", at(0), 1), ("a", at(0.4), 2), ("b", at(0), 3), ("a", at(2), 4)], [("b", at(0.3), 9), ("a", at(2.5), 5), ("b", at(3), 6), (None, at(3), 0)], [("end", at(50), 0)], [("end", at(55), 7)]]
    out = []
    with stateful(spark):
        for rows in parts:
            spark.createDataFrame(rows, "k string, at string, v long").selectExpr("k", "cast(at as timestamp) as at", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("k string, at timestamp, v long").parquet(str(tmp_path / "in"))
            found = quiet.quiet_after(stream, ["k"], "at", ["v"], 500, "5 seconds")
            found.writeStream.foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [("a", 2, 2), ("a", 5, 2), ("b", 6, 1), ("b", 9, 2), ("end", 0, 1)]


def test_duplicates_after_batches_equal_the_whole(spark, tmp_path):
    rng = random.Random(20)
    held: dict = {}
    index = DuplicateIndex(spark, str(tmp_path), "int", 1.0, lambda a, b: F.when(a == b, F.lit(0.9)).otherwise(0.1), 0.5, 8)
    fresh = lambda i: (i, None if rng.random() < 0.05 else rng.randrange(60) / 2, rng.randrange(3))
    batches = [[(*fresh(i), False) for i in range(40)], [(*fresh(i), False) for i in range(35, 60)], [(*fresh(i), i % 2 == 0) for i in range(0, 50, 3)] + [(99, 1.0, 1, True)]]
    for n, batch in enumerate(batches, 1):
        changes = spark.createDataFrame(batch, "id long, value double, content int, gone boolean")
        index.apply(changes, n)
        if n == 2:
            index.apply(changes, n)
        for i, value, content, gone in batch:
            held.pop(i, None)
            if not gone:
                held[i] = (value, content)
        near = lambda a, b: a[1] == b[1] and (a[0] is None or b[0] is None or abs(a[0] - b[0]) <= 1)
        pairs = {(i, j) for i in held for j in held if i != j and near(held[i], held[j])}
        assert {(r.x, r.y) for r in index.pairs.read().collect()} == pairs
        assert {r.id: (r.value, r.content) for r in index.rows.read().collect()} == held
        label = {i: i for i, _ in pairs}
        for _ in label:
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        assert {r.id: r.component for r in index.groups.read().collect()} == label


def test_groups_by_classes_equal_those_of_rows_and_copies_make_no_square(spark, tmp_path):
    rng = random.Random(21)
    held: dict = {}
    index = ClassIndex(spark, str(tmp_path), "int", 1.0, lambda a, b: F.when(a == b, F.lit(0.9)).otherwise(0.1), 0.5, 4)
    values = [None, float("nan"), float("inf"), 0.0, 0.5, 3.0, 3.5, 4.5, 9.0, 20.0, 40.0]
    fresh = lambda i: (i, values[rng.randrange(2 if i % 9 == 0 else len(values)) if i > 5 else 8], rng.choice([None, *range(7)]))
    batches = [
        [(*fresh(i), False) for i in range(60)] + [(i, 70.0, 3, False) for i in range(1000, 1400)],
        [(*fresh(i), False) for i in range(50, 75)] + [(i, 70.0, 3, True) for i in range(1000, 1100)],
        [(*fresh(i), i % 2 == 0) for i in range(0, 70, 2)] + [(2000, 1.0, 1, True)],
    ]
    near = lambda a, b: a[1] is not None and a[1] == b[1] and (a[0] is None or b[0] is None or abs(a[0] - b[0]) <= 1)
    for n, batch in enumerate(batches, 1):
        changes = spark.createDataFrame(batch, "id long, value double, content int, gone boolean")
        index.apply(changes, n)
        if n == 2:
            index.apply(changes, n)
        for i, value, content, gone in batch:
            held.pop(i, None)
            if not gone:
                held[i] = (value, content)
        label = {i: i for i in held if any(i != j and near(held[i], held[j]) for j in held)}
        changed = True
        while changed:
            changed = False
            for i in label:
                low = min(label[j] for j in label if j == i or near(held[i], held[j]))
                changed, label[i] = changed or low < label[i], low
        with scratch(spark):
            assert {r.id: r.component for r in index.groups().collect()} == label
    assert index.classes.pairs.read().count() < 3000 and sum(r.n for r in index.sizes.read().collect()) == len(held)


def test_stores_of_small_tables_have_few_buckets(spark, monkeypatch):
    """Each bucket is a file and a task of every write, so their number goes by the rows and not by the session's partitions."""
    from tablemill.plans import registry, streams
    from tablemill.streaming import store

    made, written = {}, []
    begin, stash = store.BucketStore.__init__, store.stash
    monkeypatch.setattr(store.BucketStore, "__init__", lambda self, *a, **k: begin(self, *a, **k) or made.update({self.folder.rsplit("/", 1)[-1]: self.buckets}))
    monkeypatch.setattr(store, "stash", lambda df, name: written.append(name) or stash(df, name))
    monkeypatch.setattr(streams, "BUCKET_ROWS", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        registry.QUERIES["stepped_duplicates"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(made) == {"rows", "pairs", "groups", "members", "sizes"} and max(made.values()) < 20
    assert written.count("changes") == 3  # those of the groups; the others are read from stored tables


def test_quiet_keys_in_whole_batches(spark, tmp_path, monkeypatch):
    """Runs of each key against a walk, with held rows, late ones, a batch done twice and an empty one; no Python is called for each key."""
    import random

    from tablemill.plans import registry
    from tablemill.streaming import quiet

    rng = random.Random(8)
    start = 1_700_000_000_000
    rows = [(f"u{rng.randrange(30)}", start + 1000 * i * 7 + rng.randrange(20_000), i) for i in range(600)] + [(None, start, 900), ("u1", None, 901)]
    parts = [rows[:250], rows[250:], [("u1", start, 950), ("u2", start + 10_000_000, 951)], []]  # the first of the third is late
    tables = [spark.createDataFrame(p, "user string, ms long, id long").select("user", F.timestamp_millis("ms").alias("ts"), "id") for p in parts]
    runs = quiet.QuietBatches(spark, str(tmp_path), tables[0], ["user"], "ts", ["id"], 60_000, 30_000)
    for n, t in enumerate(tables):
        runs.apply(t, n)
        if n == 1:
            runs.apply(t, n)
    want = []
    for user in sorted({u for u, _, _ in rows if u}):
        own = sorted((ms, i) for u, ms, i in rows if u == user and ms is not None)
        n = 0
        for (ms, i), after in zip(own, [*own[1:], None]):
            n += 1
            if after is None or after[0] - ms > 60_000:
                want.append((user, i, n))
                n = 0
    assert sorted(map(tuple, runs.gone().collect())) == sorted(want) and len(want) > 100
    monkeypatch.setattr(quiet, "quiet_after", None)
    for name in ("stream_debounced", "stream_retention"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
