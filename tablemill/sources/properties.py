"""Properties and tags that a container tells in its first bytes: ID3v2 before MPEG frames, FLAC, RIFF."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROPERTIES = "container string, channels int, sample_rate int, duration double, bitrate int, artist string, title string, has_cover boolean, tagged boolean"
#: What a file has of which nothing can be read.
NEUTRAL = {"container": None, "channels": 0, "sample_rate": 0, "duration": 0.0, "bitrate": None, "artist": None, "title": None, "has_cover": False, "tagged": False}
# Fixed values of the formats: kilobits a second and samples a second of MPEG layer III, by version
# (1 and later) and index; ID3 text encodings; ID3 and RIFF names of artist and title.
LAYER_III = {True: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), False: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
ARTIST, TITLE, COVER = {b"TPE1", b"TP1", b"IART"}, {b"TIT2", b"TT2", b"INAM"}, {b"APIC", b"PIC"}


def syncsafe(raw: bytes) -> int:
    """An integer of seven bits a byte."""
    out = 0
    for b in raw:
        out = out << 7 | b & 0x7F
    return out


def id3_text(body: bytes) -> str | None:
    """The first value of a text frame."""
    if not body or body[0] >= len(ENCODINGS):
        return None
    found = body[1:].decode(ENCODINGS[body[0]], "replace").lstrip("﻿").split("\x00")[0].strip()
    return found or None


def id3(head: bytes, out: dict) -> int:
    """Takes in the frames of an ID3v2 tag at the start; its length in bytes."""
    if head[:3] != b"ID3" or len(head) < 10:
        return 0
    version, flags, size = head[3], head[5], syncsafe(head[6:10])
    at, end = 10, min(len(head), 10 + size)
    if flags & 0x40 and version >= 3 and at + 4 <= end:  # an extended header
        at += syncsafe(head[at : at + 4]) if version == 4 else 4 + int.from_bytes(head[at : at + 4], "big")
    wide = 6 if version == 2 else 10
    while at + wide <= end and head[at]:
        name = head[at : at + (3 if version == 2 else 4)]
        length = int.from_bytes(head[at + 3 : at + 6], "big") if version == 2 else syncsafe(head[at + 4 : at + 8]) if version == 4 else int.from_bytes(head[at + 4 : at + 8], "big")
        body = head[at + wide : min(end, at + wide + length)]
        if name in ARTIST:
            out["artist"] = id3_text(body) or out["artist"]
        elif name in TITLE:
            out["title"] = id3_text(body) or out["title"]
        out["has_cover"] |= name in COVER and length > 0
        at += wide + length
    return 10 + size + (10 if flags & 0x10 else 0)


def mpeg(head: bytes, at: int, size: int, out: dict) -> bool:
    """Takes in the first frame of layer III at or after `at`; the duration takes its rate for all."""
    while 0 <= at and at + 4 <= len(head):
        word = int.from_bytes(head[at : at + 4], "big")
        version, layer, rate, speed = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
        if word >> 21 == 0x7FF and version != 1 and layer == 1 and 0 < rate < 15 and speed < 3:
            kilobits = LAYER_III[version == 3][rate]
            out |= {"container": "mpeg", "channels": 1 if word >> 6 & 3 == 3 else 2, "sample_rate": RATES[version][speed], "bitrate": kilobits, "duration": (size - at) / (125.0 * kilobits)}
            return True
        at = head.find(b"\xff", at + 1)
    return False


def comments(body: bytes, out: dict) -> None:
    """Takes in a block of comments `NAME=value`."""
    at = 4 + int.from_bytes(body[:4], "little")
    count = int.from_bytes(body[at : at + 4], "little")
    at += 4
    for _ in range(min(count, len(body))):
        length = int.from_bytes(body[at : at + 4], "little")
        name, _, value = body[at + 4 : at + 4 + length].decode("utf-8", "replace").partition("=")
        if name.lower() in ("artist", "title") and value.strip() and not out[name.lower()]:
            out[name.lower()] = value.strip()
        at += 4 + length
        if at >= len(body):
            return


def flac(head: bytes, at: int, size: int, out: dict) -> bool:
    at, seen = at + 4, False
    while at + 4 <= len(head):
        kind, length = head[at] & 0x7F, int.from_bytes(head[at + 1 : at + 4], "big")
        body = head[at + 4 : at + 4 + length]
        if kind == 0 and len(body) >= 18:
            packed = int.from_bytes(body[10:18], "big")
            rate, samples = packed >> 44, packed & (1 << 36) - 1
            if rate:
                seconds = samples / rate
                out |= {"container": "flac", "channels": (packed >> 41 & 7) + 1, "sample_rate": rate, "duration": seconds, "bitrate": int(size * 8 / seconds / 1000) if seconds else None}
                seen = True
        elif kind == 4:
            comments(body, out)
        elif kind == 6:
            out["has_cover"] = True
        if head[at] & 0x80:
            break
        at += 4 + length
    return seen


def riff(head: bytes, size: int, out: dict) -> bool:
    at, speed, seen = 12, 0, False
    while at + 8 <= len(head):
        name, length = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        body = head[at + 8 : at + 8 + length]
        if name == b"fmt " and len(body) >= 16:
            _, channels, rate, speed = struct.unpack_from("<HHII", body)
            out |= {"container": "wav", "channels": channels, "sample_rate": rate, "bitrate": speed * 8 // 1000}
        elif name == b"data" and speed:
            out["duration"], seen = min(length, max(0, size - at - 8)) / speed, True
        elif name == b"LIST" and body[:4] == b"INFO":
            i = 4
            while i + 8 <= len(body):
                n = int.from_bytes(body[i + 4 : i + 8], "little")
                value = body[i + 8 : i + 8 + n].split(b"\x00")[0].decode("utf-8", "replace").strip() or None
                key = "artist" if body[i : i + 4] in ARTIST else "title" if body[i : i + 4] in TITLE else None
                if key and value:
                    out[key] = value
                i += 8 + n + (n & 1)
        elif name.lower() == b"id3 ":
            id3(body, out)
        at += 8 + length + (length & 1)
    return seen


def read_head(head: bytes, size: int) -> dict:
    """PROPERTIES of a file of `size` bytes by its first ones; neutral values where these are no known container."""
    out = dict(NEUTRAL)
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        good = riff(head, size, out)
    else:
        at = id3(head, out)
        good = flac(head, at, size, out) if head[at : at + 4] == b"fLaC" else mpeg(head, at, size, out)
    if not good:
        return dict(NEUTRAL)
    return out | {"tagged": bool(out["artist"] and out["title"])}


def with_properties(files: DataFrame, head: str = "head", size: str = "size_bytes") -> DataFrame:
    """`files` with PROPERTIES in place of `head`: the first bytes of a file of `size` bytes (null sizes: the head is
    all). Chunks that the head cuts off count as far as they reach; null, empty and broken heads have neutral values. Columns of the names of PROPERTIES may not stand in `files`."""
    others = [c for c in files.columns if c != head]
    names = [p.split()[0] for p in PROPERTIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        types = [kinds[p.split()[1]] for p in PROPERTIES.split(", ")]
        for batch in batches:
            given = zip(batch.column(head).to_pylist(), batch.column(size).to_pylist())
            found = [read_head(h or b"", len(h or b"") if n is None else n) for h, n in given]
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([f[n] for f in found], t) for n, t in zip(names, types))], names=[*others, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != head)
    return files.withColumn(head, F.col(head).cast("binary")).mapInArrow(run, f"{fields}, {PROPERTIES}")
