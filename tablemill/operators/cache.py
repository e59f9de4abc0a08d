"""Results kept by what they were made from: a stored result is served while its signature and
generation are current, and computed once by whoever asks first otherwise."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablemill.storage import create_new, delete_path, list_files, read_text, write_text


def signature(spark: SparkSession, *paths: str) -> str:
    """What tells the stored tables at `paths` apart from changed ones: their files' names, sizes
    and times. Only folders are listed; no row is read."""
    return json.dumps([list_files(spark, path) for path in paths])


class ResultCache:
    """Results under `folder`, each with a manifest of its signature, generation and place.

    `get` serves a result whose signature is the given one. Otherwise one caller computes it, whoever marks it as running
    first; the others wait for that and take what it stored. `invalidate` starts a new generation: a result that
    is being computed then is stored no more for later callers. A mark older than `patience` seconds is of a
    caller that is gone, and is taken over."""

    def __init__(self, spark: SparkSession, folder: str, patience: float = 3600.0, pause: float = 0.2):
        self.spark, self.folder, self.patience, self.pause = spark, folder.rstrip("/"), patience, pause

    def _entry(self, name: str) -> dict | None:
        found = read_text(self.spark, f"{self.folder}/{name}.json")
        return None if found is None else json.loads(found)

    def _generation(self, name: str) -> int:
        return int(read_text(self.spark, f"{self.folder}/{name}.generation") or 0)

    def invalidate(self, name: str) -> None:
        write_text(self.spark, f"{self.folder}/{name}.generation", str(self._generation(name) + 1))

    def held(self, name: str, signed: str) -> DataFrame | None:
        """The stored result, if it is current."""
        entry = self._entry(name)
        if entry is None or entry["signature"] != signed or entry["generation"] != self._generation(name):
            return None
        return self.spark.read.parquet(entry["path"])

    def get(self, name: str, signed: str, compute: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """(the result, whether this call computed it)."""
        mark = f"{self.folder}/{name}.running"
        while True:
            found = self.held(name, signed)
            if found is not None:
                return found, False
            if create_new(self.spark, mark, str(time.time())):
                break
            began = read_text(self.spark, mark)
            if began and time.time() - float(began) > self.patience:
                delete_path(self.spark, mark)
            time.sleep(self.pause)
        try:
            found = self.held(name, signed)  # stored between the look and the mark
            if found is not None:
                return found, False
            generation, old = self._generation(name), self._entry(name)
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            compute().write.parquet(path)
            if generation == self._generation(name):
                write_text(self.spark, f"{self.folder}/{name}.json", json.dumps({"signature": signed, "generation": generation, "path": path}))
                if old is not None:
                    delete_path(self.spark, old["path"])
            return self.spark.read.parquet(path), True
        finally:
            delete_path(self.spark, mark)
