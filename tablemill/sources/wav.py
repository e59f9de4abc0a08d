"""PCM WAV files as a data source: written one file a row, read by ranges of bytes."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# The processes that plan and run a source have no search path for this package, so it travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCKS = "path string, channels int, sample_rate int, block_id long, samples array<float>"
FILES = "name string, channels int, sample_rate int, bits int, data binary, declared long"
#: Bytes of a file's head in which the format and the start of the samples are looked for.
HEAD = 1 << 16
#: Ranges grow until there are at most about so many of them, or they have so many bytes.
TASKS, TASK_BYTES = 1024, 32 << 20


@dataclass
class Ranges(InputPartition):
    """Ranges of files: (path, size of the file, first byte, byte after the last)."""

    found: list[tuple[str, int, int, int]]


def data_chunk(head: bytes, size: int) -> tuple[int, int, int, int, int] | None:
    """(channels, sample rate, bits, first byte, bytes) of the samples of a file of `size` bytes, whose end
    cuts a chunk that claims more; None for anything but PCM in a RIFF file."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, kind = 12, None
    while at + 8 <= len(head):
        name, length = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if name == b"fmt " and length >= 16 and at + 24 <= len(head):
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            tag = struct.unpack_from("<H", head, at + 32)[0] if tag == 0xFFFE and length >= 26 and at + 34 <= len(head) else tag
            kind = (channels, rate, bits) if channels and (tag == 1 and bits in (8, 16, 24, 32) or tag == 3 and bits == 32) else None
            kind = kind and (*kind[:2], -32 if tag == 3 else bits)
        elif name == b"data" and kind:
            return (*kind, at + 8, max(0, min(length, size - at - 8)))
        at += 8 + length + (length & 1)
    return None


def decoded(raw: bytes, bits: int) -> np.ndarray:
    """Samples in -1..1 of little-endian PCM; -32 bits are floats."""
    if bits == -32:
        return np.frombuffer(raw, "<f4")
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (wide.reshape(-1).view("<i4") / 2147483648.0).astype(np.float32)
    return (np.frombuffer(raw, f"<i{bits // 8}") / float(1 << (bits - 1))).astype(np.float32)


class WavSource(DataSource):
    """`format("wav")` with the folder in option `path` (any file system that Arrow reaches).

    Reads (path, channels, sample_rate, block_id, samples): `blockFrames` frames a row, interleaved, in -1..1. Files are
    listed by the driver and their bytes dealt in ranges of `rangeBytes`, or larger ones where these would be very many;
    a task reads the head and the blocks that begin in its range, so a long recording is read by many and no file is held whole. A file that is no PCM WAV has no
    rows; of one that is cut, the whole frames before the cut are read.

    Writes FILES rows: `data` behind a header of `channels`, `sample_rate` and `bits`; `declared` is the number of bytes that
    the header claims, by default those there are. A name may have folders in front."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WavWriter(dict(self.options))


def opened(options: dict) -> tuple[fs.FileSystem, str]:
    where = options["path"]
    return fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.frames = int(options.get("blockframes", 1 << 16))
        self.range = int(options.get("rangebytes", 32 << 20))

    def partitions(self) -> list[Ranges]:
        system, root = opened(self.options)
        files = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(".wav")]
        most = max(self.range, min(TASK_BYTES, -(-sum(i.size for i in files) // TASKS)))
        parts, filled = [Ranges([])], 0
        for info in sorted(files, key=lambda i: i.path):
            start = 0
            while start < info.size:
                end = min(info.size, start + most - filled)
                parts[-1].found.append((info.path, info.size, start, end))
                filled += end - start
                start = end
                if filled >= most:
                    parts.append(Ranges([]))
                    filled = 0
        return parts

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.options)
        for path, size, start, end in partition.found:
            with system.open_input_file(path) as f:
                found = data_chunk(f.read_at(min(HEAD, size), 0), size)
                if found is None:
                    continue
                channels, rate, bits, first, length = found
                frame = channels * abs(bits) // 8
                step = frame * self.frames
                length -= length % frame
                # Blocks that begin from `start` to `end`.
                block = max(0, -(-(start - first) // step))
                while first + block * step < end and block * step < length:
                    raw = f.read_at(min(step, length - block * step), first + block * step)
                    samples = pa.array([decoded(raw[: len(raw) // frame * frame], bits)], pa.list_(pa.float32()))
                    columns = [pa.array([path]), pa.array([channels], pa.int32()), pa.array([rate], pa.int32()), pa.array([block], pa.int64()), samples]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "channels", "sample_rate", "block_id", "samples"])
                    block += 1


class WavWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator) -> WriterCommitMessage:
        system, root = opened(self.options)
        made = {""}
        system.create_dir(root, recursive=True)
        for row in iterator:
            data = bytes(row.data or b"")
            size = len(data) if row.declared is None else row.declared
            frame = row.channels * row.bits // 8
            head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, row.channels, row.sample_rate, row.sample_rate * frame, frame, row.bits, b"data", size)
            folder = row.name.rpartition("/")[0]
            if folder not in made:
                system.create_dir(f"{root}/{folder}", recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{root}/{row.name}") as f:  # a task that runs again writes the same file
                f.write(head + data)
        return WriterCommitMessage()
