"""Results kept by signature and generation, computed once by many callers."""

import threading
import time

from tablemill.operators.cache import ResultCache, signature
from tablemill.storage import create_new, list_files


def test_served_while_signature_and_generation_are_current(spark, tmp_path):
    base, cache, made = str(tmp_path / "base"), ResultCache(spark, str(tmp_path / "cache")), []

    def compute():
        made.append(1)
        return spark.read.parquet(base).selectExpr("count(*) as n")

    spark.range(3).write.parquet(base)
    ask = lambda: (lambda found: (found[0].first().n, found[1]))(cache.get("n", signature(spark, base), compute))
    assert [ask(), ask()] == [(3, True), (3, False)]
    spark.range(2).write.mode("append").parquet(base)
    assert [ask(), ask()] == [(5, True), (5, False)]
    cache.invalidate("n")
    assert [ask(), ask()] == [(5, True), (5, False)]
    assert len(made) == 3 and signature(spark, str(tmp_path / "none")) == "[[]]"
    assert len([p for p in (tmp_path / "cache").iterdir() if p.is_dir()]) == 1  # old results are gone


def test_callers_at_once_compute_once(spark, tmp_path):
    cache, made, got = ResultCache(spark, str(tmp_path), pause=0.02), [], []

    def compute():
        made.append(1)
        time.sleep(0.5)
        return spark.range(7)

    callers = [threading.Thread(target=lambda: got.append(cache.get("r", "s", compute))) for _ in range(5)]
    for c in callers:
        c.start()
    for c in callers:
        c.join()
    assert len(made) == 1 and sorted(computed for _, computed in got) == [False] * 4 + [True] and all(df.count() == 7 for df, _ in got)


def test_a_result_of_an_older_generation_is_not_stored(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path))

    def compute():
        cache.invalidate("r")  # someone changes the table meanwhile
        return spark.range(1)

    assert cache.get("r", "s", compute)[1] and cache.held("r", "s") is None
    assert cache.get("r", "s", lambda: spark.range(2))[1] and cache.held("r", "s").count() == 2


def test_failures_and_lost_callers_leave_no_mark(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path), patience=0.1, pause=0.02)
    try:
        cache.get("r", "s", lambda: 1 / 0)
    except ZeroDivisionError:
        pass
    assert create_new(spark, f"{tmp_path}/r.running", str(time.time() - 1))
    assert not create_new(spark, f"{tmp_path}/r.running", "x")
    assert cache.get("r", "s", lambda: spark.range(2))[1]
    assert not any(p.endswith(".running") for p, _, _ in list_files(spark, str(tmp_path)))
