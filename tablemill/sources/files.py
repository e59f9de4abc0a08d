"""Listings of folders and sampled audio as DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions import text
from tablemill.sources import wav
from tablemill.storage import stash

# Extensions of audio files, and the first bytes of containers by rail.
AUDIO = ("mp3", "flac", "wav", "aif", "aiff", "m4a", "aac", "ogg", "opus")
LOSSLESS = ("flac", "wav", "aif", "aiff")
MAGIC = {"664C6143": "lossless", "52494646": "lossless", "464F524D": "lossless", "4F676753": "lossy", "494433": "lossy", "FFFB": "lossy", "FFF3": "lossy"}
BLOCK = 4096
#: Folders that a task lists, until there are as many tasks as shuffles have partitions.
FOLDERS_A_TASK = 8


def listing(spark: SparkSession, root: str, audio_only: bool = True) -> DataFrame:
    """(path, filename, size_bytes, mtime) of all files below `root`, any case of extension. The
    files' contents are not read. A root that does not exist is Spark's error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = found.select("path", text.basename(F.col("path")).alias("filename"), F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("mtime"))
    return rows.where(is_audio(F.col("path"))) if audio_only else rows


def walk(spark: SparkSession, root: str, audio_only: bool = True) -> DataFrame:
    """As `listing`, of a folder of very many files that Arrow reaches: tasks list the folders, level by level, so the
    driver holds no file and only learns how many folders a level has. A folder is one task's work, so files should be dealt over
    folders. Names that Spark passes over (with _ or . in front) are passed over; files without a byte, which Spark leaves out, are listed. The levels are stashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = wav.opened({"path": root})
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                infos = [i for i in system.get_file_info(fs.FileSelector(top if folder is None else folder)) if i.base_name[0] != "." and (i.base_name[0] != "_" or "=" in i.base_name)]
                for part in (infos[i : i + BLOCK] for i in range(0, len(infos), BLOCK)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.path for i in part], pa.string()), pa.array([i.size or 0 for i in part], pa.int64()), pa.array([(i.mtime_ns or 0) // 10**9 for i in part], pa.int64()), pa.array([i.type == fs.FileType.Directory for i in part], pa.bool_())],
                        names=["path", "size_bytes", "mtime", "folder"],
                    )

    folders, left, levels = spark.createDataFrame([(None,)], "path string"), 1, []
    while left:
        tasks = min(-(-left // FOLDERS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
        level = stash(folders.repartition(tasks, "path").mapInArrow(run, "path string, size_bytes long, mtime long, folder boolean"), "level")
        folders = level.where("folder").select("path")
        left = folders.count()
        levels.append(level.where("not folder"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    rows = found.select("path", text.basename(F.col("path")).alias("filename"), "size_bytes", "mtime")
    return rows.where(is_audio(F.col("path"))) if audio_only else rows


def is_audio(path: Column) -> Column:
    return F.lower(F.regexp_extract(text.basename(path), r"^.+\.([^.]+)$", 1)).isin(*AUDIO)


def declared_rail(path: Column) -> Column:
    """The rail that an audio file's extension declares."""
    return F.when(F.lower(F.substring_index(path, ".", -1)).isin(*LOSSLESS), "lossless").otherwise("lossy")


def content_rail(content: Column) -> Column:
    """The rail that a file's first bytes tell; unknown where they tell none."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("unknown")
    for magic, rail in MAGIC.items():
        out = F.when(F.startswith(head, F.lit(magic)), rail).otherwise(out)
    return out


def wav_blocks(files: DataFrame) -> DataFrame:
    """(path, channels, sample_rate, block_id, samples) of 16-bit PCM WAV (path, content):
    interleaved samples in -1..1, BLOCK frames a row. Files of other kinds, and what follows a
    break in a file, give no rows."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                if content is None or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
                    continue
                at, channels, rate, bits = 12, 0, 0, 0
                while at + 8 <= len(content):
                    name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
                    body = content[at + 8 : at + 8 + size]
                    if name == b"fmt " and len(body) >= 16:
                        _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
                    elif name == b"data" and bits == 16 and channels:
                        whole = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").astype(np.float32) / 32768
                        step = BLOCK * channels
                        parts = [whole[i : i + step].tolist() for i in range(0, len(whole), step)]
                        yield pd.DataFrame({"path": path, "channels": channels, "sample_rate": rate, "block_id": range(len(parts)), "samples": parts})
                    at += 8 + size + (size & 1)

    return files.select("path", "content").mapInPandas(run, "path string, channels int, sample_rate int, block_id long, samples array<float>")


def measured_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a semicolon table whose last field, the file name, may hold semicolons itself; `-`
    and nothing are null, and lines that are no rows are left out."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(";")) & ~F.startswith("value", F.lit("rail;")) & ~F.startswith("value", F.lit("--")))
    return lines.select(measured_fields(F.col("value")).alias("m")).select("m.*")


def measured_fields(line: Column) -> Column:
    """The fields of one line of such a table."""
    names = ["rail", "bitrate", "cutoff", "verdict", "est", "hf", "hf_top"]
    parts = F.split(line, ";", len(names) + 1)
    fields = {n: F.when(~F.get(parts, F.lit(i)).isin("-", ""), F.get(parts, F.lit(i))) for i, n in enumerate(names)}
    return F.struct(*((v.try_cast("double") if n not in ("rail", "verdict") else v).alias(n) for n, v in fields.items()), F.get(parts, F.lit(len(names))).alias("file"))
