"""Reading the input tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_open = threading.local()
_lock, _cleaning = threading.Lock(), {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the input folder; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set, a local master gets a temporary
    folder; a cluster, whose machines share no such folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tablemill-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage is cut and lost
    executors cost nothing, since every later read finds the files. Returns the same rows.
    Inside `scratch` the table is deleted when the block ends. What the write shuffled is deleted with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tablemill/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    if getattr(_open, "made", None):
        _open.made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """A block whose actions delete their shuffle files when they are done, instead of when the driver's memory is next collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    session = spark._jsparkSession.hashCode()
    with _lock:  # blocks of several threads may overlap: the last one to end puts back what the first found
        if session not in _cleaning:
            _cleaning[session] = (0, spark.conf.get(name))
            spark.conf.set(name, "true")
        _cleaning[session] = (_cleaning[session][0] + 1, _cleaning[session][1])
    try:
        yield
    finally:
        with _lock:
            n, before = _cleaning.pop(session)
            if n > 1:
                _cleaning[session] = (n - 1, before)
            else:
                spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose stashes are deleted when it ends, but for those made with the function that
    it gives: what the block returns may read only these. Blocks nest: a kept table belongs to
    the block around."""
    if not hasattr(_open, "made"):
        _open.made = []
    _open.made.append([])
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stash(df, name)
        kept.append(_open.made[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _open.made.pop():
            delete_path(spark, path)
        if _open.made:
            _open.made[-1].extend(kept)
        else:  # lets the context cleaner drop the shuffle files and broadcasts of what is done
            spark.sparkContext._jvm.java.lang.System.gc()


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of the shared one for what a stream keeps, deleted when the block ends."""
    path = f"{shared_dir(spark)}/tablemill/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file of any file system that Spark reaches: first beside it, then in its place."""
    jvm = spark.sparkContext._jvm
    place, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(place, False)
    system.rename(part, place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None where there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none yet; whether this call made it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = system.create(place, False)
    except Py4JJavaError:
        if system.exists(place):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files below a path, in order; none where nothing is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found, out = system.listFiles(place, True), []
    while found.hasNext():
        one = found.next()
        out.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return sorted(out)


def clear_stashes(spark: SparkSession) -> None:
    """Delete every stash of the shared folder; only when no result that reads one is needed."""
    delete_path(spark, f"{shared_dir(spark)}/tablemill")
