"""A stored table in buckets by the hash of its key, with a manifest per version: a write replaces
the files of the buckets that it changes and no others."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablemill.storage import delete_path, read_text, scratch, stash, write_text

MOST_KEYS = 100_000  # keys of changes that are broadcast


class BucketStore:
    """Rows of `schema` under `folder`, any file system that Spark reaches.

    Version n's manifest says for every bucket which folder holds its rows, how many these are and a digest
    of them. A write of version n makes new files for the buckets whose rows it changes and reads only the old ones of
    those that its changes touch; where a bucket's rows stay the same, its old file is kept and nothing is written. The manifest is written last, so a write that
    breaks off is done again, and one that is asked for again is seen to be done. The number of buckets (by
    default as many as shuffles have partitions) is fixed when the table is made: take it so that a bucket is a task's work. `counter` names a column of ids whose largest value the manifest keeps,
    so that new rows get ids without a look at all buckets."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: list[str], buckets: int | None = None, counter: str | None = None):
        self.spark, self.folder, self.schema, self.key, self.counter = spark, folder.rstrip("/"), schema, key, counter
        made = read_text(spark, f"{self.folder}/manifest/buckets")
        self.buckets = int(made or buckets or spark.conf.get("spark.sql.shuffle.partitions"))
        if made is None:
            write_text(spark, f"{self.folder}/manifest/buckets", str(self.buckets))

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int) -> dict[int, dict] | None:
        """The buckets of a version; None where it is not written."""
        found = read_text(self.spark, f"{self.folder}/manifest/{version}.json")
        return None if found is None else {int(k): v for k, v in json.loads(found).items()}

    def version(self) -> int:
        """The latest version, -1 before the first."""
        found = read_text(self.spark, f"{self.folder}/manifest/latest")
        return -1 if found is None else int(found)

    def rows(self, manifest: dict[int, dict], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{e['folder']}/_bucket={b}" for b, e in sorted(manifest.items()) if e["n"] and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest one by default); none before the first."""
        found = self.manifest(self.version() if version is None else version)
        return self.rows(found or {})

    def files(self, version: int | None = None) -> dict[int, str]:
        """Bucket to the folder that holds it."""
        found = self.manifest(self.version() if version is None else version) or {}
        return {b: f"{e['folder']}/_bucket={b}" for b, e in found.items() if e["n"]}

    def largest(self) -> int:
        """The largest id of the latest version, 0 without rows."""
        return max((e["most"] or 0 for e in (self.manifest(self.version()) or {}).values()), default=0)

    def write(self, rows: DataFrame, version: int = 0) -> set[int]:
        """A version that holds `rows` and nothing else."""
        self._store(self._placed(rows), version)
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema.fields)
        stored = self.spark.read.schema(f"{fields}, _bucket int").parquet(f"{self.folder}/v{version}")
        found = self._sums(stored).collect()  # at most `buckets` rows
        return self._finish({b: {"folder": f"v{version}", "n": n, "digest": digest, "most": most} for b, n, digest, most in found}, version)

    def apply(self, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], version: int, stored: bool = False) -> set[int]:
        """Version `version` from the one before: `step` gets the stored rows that have a key of `changes`,
        and these changes, and gives all rows that these keys have from now on. Returns the buckets whose rows are
        others than before; a version that is there already is left and gives what it gave. `changes` that are read
        from `stored` tables are not written once more.

        Stored rows of other keys pass `step` by: they are read once to be told apart, and once more where their bucket
        is written. Digests are sums, so what comes and goes tells those of the new version without a look at the rest."""
        if self.manifest(version) is not None:
            return self._changed(version)
        before = self.manifest(version - 1)
        if before is None:
            raise ValueError(f"version {version - 1} is not there")
        with scratch(self.spark):
            given = changes if stored else stash(changes, "changes")
            keys = stash(given.select(*(F.col(c).alias(f"_key_{c}") for c in self.key), self.bucket().alias("_bucket")).distinct(), "keys")
            counts = dict(map(tuple, keys.groupBy("_bucket").count().collect()))  # at most `buckets` rows
            keys = keys.drop("_bucket")
            keys = F.broadcast(keys) if sum(counts.values()) <= MOST_KEYS else keys.hint("merge")
            held_rows = self.rows(before, sorted(counts))
            old = self._placed(self._met(held_rows, keys, "left_semi"))
            old = stash(old, "old-rows") if any(b in before for b in counts) else self.spark.createDataFrame([], old.schema)
            new = stash(self._placed(step(old.drop("_bucket"), given)), "new-rows")
            sides = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
            found = {(r["_bucket"], r["_new"]): r for r in self._sums(sides, "_new").collect()}  # at most two for each bucket
            now, moved, unsure = dict(before), [], []
            for b in sorted({b for b, _ in found}):
                gone, come, held = found.get((b, False)), found.get((b, True)), before.get(b)
                if gone and come and (gone["n"], gone["digest"]) == (come["n"], come["digest"]):
                    continue
                moved.append(b)
                now[b] = self._moved(held, gone, come, f"v{version}")
                if not now[b]["n"]:
                    del now[b]
                elif gone and gone["most"] is not None and gone["most"] == now[b]["most"] and (come is None or come["most"] != now[b]["most"]):
                    unsure.append(b)  # the largest id has left, another row may still have it
            if moved:
                others = held_rows if moved == sorted(counts) else self.rows(before, moved)  # listed once where all are written
                come = new.where(F.col("_bucket").isin(moved))
                stays = self._placed(self._met(others, keys, "left_anti"))
                self._store(stays.unionByName(come) if any(b in before for b in moved) else come, version)
            if unsure:
                most = self.rows({b: now[b] for b in unsure}).groupBy(self.bucket().alias("_bucket")).agg(F.max(F.col(self.counter).cast("long")))
                for b, largest in most.collect():
                    now[b]["most"] = largest
        return self._finish(now, version)

    def _met(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in self.key))
        return rows.join(keys, same, how)

    @staticmethod
    def _moved(held: dict | None, gone: Row | None, come: Row | None, folder: str) -> dict:
        """A bucket's entry after some rows went and others came."""
        parts = [(1, held), (-1, gone), (1, come)]
        sums = [(sign, e["n"], json.loads(e["digest"])) for sign, e in parts if e]
        total, mixed = sum(sign * int(d["col1"]) for sign, _, d in sums), functools.reduce(lambda a, b: a ^ b, (int(d["col2"]) for _, _, d in sums))
        most = [e["most"] for e in (held, come) if e and e["most"] is not None]
        digest = json.dumps({"col1": str(total), "col2": str(mixed)}, separators=(",", ":"))
        return {"folder": folder, "n": sum(sign * n for sign, n, _ in sums), "digest": digest, "most": max(most, default=None)}

    def _changed(self, version: int) -> set[int]:
        now, before = self.manifest(version) or {}, self.manifest(version - 1) or {}
        same = {b for b in now if b in before and (now[b]["n"], now[b]["digest"]) == (before[b]["n"], before[b]["digest"])}
        return {b for b in {*now, *before} - same if now.get(b, {"n": 0})["n"] or before.get(b, {"n": 0})["n"]}

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("_bucket", self.bucket())

    def _store(self, placed: DataFrame, version: int) -> None:
        # One task a bucket writes one file; what a broken write left is replaced.
        placed.repartition(self.buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/v{version}")

    def _sums(self, placed: DataFrame, *more: str) -> DataFrame:
        columns = [f.name for f in self.schema.fields]
        digest = F.struct(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).cast("string"))
        most = F.max(F.col(self.counter).cast("long") if self.counter else F.lit(None))
        return placed.groupBy("_bucket", *more).agg(F.count("*").alias("n"), F.to_json(digest).alias("digest"), most.alias("most"))

    def _finish(self, now: dict[int, dict], version: int) -> set[int]:
        write_text(self.spark, f"{self.folder}/manifest/{version}.json", json.dumps(now))
        write_text(self.spark, f"{self.folder}/manifest/latest", str(version))
        return self._changed(version)

    def forget(self, keep: int = 2) -> None:
        """Delete what only versions before the last `keep` hold."""
        last = self.version()
        held = {e["folder"] for v in range(max(0, last - keep + 1), last + 1) for e in (self.manifest(v) or {}).values()}
        for v in range(last - keep + 1):
            if self.manifest(v) is not None:
                delete_path(self.spark, f"{self.folder}/manifest/{v}.json")
        for v in range(last + 1):
            if f"v{v}" not in held:
                delete_path(self.spark, f"{self.folder}/v{v}")
