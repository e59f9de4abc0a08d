"""AVI motion-JPEG columns: storing bytes as lossless intra frames, reading them back by the
RIFF index, and cutting videos into timed clips at adaptive histogram differences.

Stored frames are JPEG's lossless process (SOF3: one component, 8-bit samples, left predictor),
so every stored sample is read back as it was; ordinary baseline frames are read too, by their
brightness. Frames of a batch are coded in step with each
other, one array operation for all of them, and frames that share their tables are decoded so.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.baseline import BaselineError, is_baseline, luma
from tablemill.llm.common import column_bytes, slices

WIDTH, HEIGHT = 16, 12
UNIT = WIDTH * HEIGHT
MICROSECONDS = 40_000
#: Huffman code of the difference categories 0..8: how many codes of each length, and their values.
CODE_COUNTS = (0, 0, 6, 3, *[0] * 12)
CODE_VALUES = (2, 3, 4, 5, 6, 7, 0, 1, 8)
#: Shots: bins of the histogram, frames looked back on, deviations above their mean, least difference.
BINS, LOOK_BACK, DEVIATIONS, LEAST = 16, 24, 2.5, 0.3


class MediaError(ValueError):
    """The bytes are no AVI motion-JPEG that this module reads."""


def codes_of(counts: tuple[int, ...], values: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Category to (code, length), canonical as JPEG lays them out."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for value in values[at : at + n]:
            out[value] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def jpeg_header(width: int, height: int) -> bytes:
    sof = struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)
    dht = struct.pack(">HB16B", 19 + len(CODE_VALUES), 0, *CODE_COUNTS) + bytes(CODE_VALUES)
    sos = struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    return b"\xff\xd8\xff\xc3" + sof + b"\xff\xc4" + dht + b"\xff\xda" + sos


HEADER = np.frombuffer(jpeg_header(WIDTH, HEIGHT), np.uint8)


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of every difference from -255 to 255."""
    codes = codes_of(CODE_COUNTS, CODE_VALUES)
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = codes[category]
        bits[d + 255] = (code << category) | (d if d > 0 else d + (1 << category) - 1)
        size[d + 255] = n + category
    return bits, size


CODE_BITS, CODE_SIZE = _code_tables()


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entropy-coded bytes of all frames end to end, bytes of each) for (n, UNIT) samples."""
    grid = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int64)
    d = np.empty_like(grid)
    d[:, :, 1:] = grid[:, :, 1:] - grid[:, :, :-1]
    d[:, 1:, 0] = grid[:, 1:, 0] - grid[:, :-1, 0]
    d[:, 0, 0] = grid[:, 0, 0] - 128
    d = d.reshape(-1, UNIT) + 255
    size = CODE_SIZE[d]
    end = np.cumsum(size, axis=1)
    n_bytes = (end[:, -1] + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    at = base[:, None] * 8 + end - size
    value = CODE_BITS[d] << (24 - (at & 7) - size)
    first = (at >> 3).ravel()
    total = int(n_bytes.sum()) + 3
    out = np.zeros(total)
    for shift, place in ((16, 0), (8, 1), (0, 2)):
        out += np.bincount(first + place, weights=((value >> shift) & 255).ravel(), minlength=total)[:total]
    out = out[:-3].astype(np.uint8)
    out[base + n_bytes - 1] |= ((1 << (n_bytes * 8 - end[:, -1])) - 1).astype(np.uint8)  # filled up with ones
    full = np.flatnonzero(out == 0xFF)
    frame = np.searchsorted(base, full, side="right") - 1
    return np.insert(out, full + 1, 0), n_bytes + np.bincount(frame, minlength=len(base))


def write_avis(payloads: np.ndarray, frames: np.ndarray) -> list[bytes]:
    """One AVI per text: payloads are all samples end to end, frames how many frames each has."""
    coded, size = encode_frames(payloads.reshape(-1, UNIT))
    jpeg = len(HEADER) + size + 2
    chunk = 8 + jpeg + (jpeg & 1)
    video = np.repeat(np.arange(len(frames)), frames)
    chunk_end = np.cumsum(chunk)
    last = np.cumsum(frames)
    video_end = chunk_end[last - 1]
    movi = video_end - np.concatenate([[0], video_end[:-1]])
    heads = [avi_head(int(n), int(m), int(jpeg[a:b].max())) for n, m, a, b in zip(frames, movi, last - frames, last)]
    head = len(heads[0])
    whole = head + movi + 8 + 16 * frames
    base = np.cumsum(whole) - whole
    out = np.zeros(int(whole.sum()), np.uint8)
    out[base[:, None] + np.arange(head)] = np.frombuffer(b"".join(heads), np.uint8).reshape(-1, head)
    inside = chunk_end - chunk - np.repeat(video_end - movi, frames)
    start = base[video] + head + inside
    out[start[:, None] + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
    out[start[:, None] + np.arange(4, 8)] = jpeg.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[start[:, None] + 8 + np.arange(len(HEADER))] = HEADER
    body = start + 8 + len(HEADER)
    out[np.arange(len(coded)) + np.repeat(body - (np.cumsum(size) - size), size)] = coded
    out[body + size], out[body + size + 1] = 0xFF, 0xD9
    table = base + head + movi
    out[table[:, None] + np.arange(4)] = np.frombuffer(b"idx1", np.uint8)
    out[table[:, None] + np.arange(4, 8)] = (16 * frames).astype("<u4").view(np.uint8).reshape(-1, 4)
    entry = np.zeros((len(size), 4), "<u4")
    entry[:, 0] = int.from_bytes(b"00dc", "little")
    entry[:, 1], entry[:, 2], entry[:, 3] = 0x10, inside + 4, jpeg
    nth = np.arange(len(size)) - np.repeat(last - frames, frames)
    out[(table[video] + 8 + 16 * nth)[:, None] + np.arange(16)] = entry.view(np.uint8).reshape(-1, 16)
    data = out.tobytes()
    return [data[a : a + n] for a, n in zip(base.tolist(), whole.tolist())]


def avi_head(frames: int, movi: int, largest: int) -> bytes:
    """RIFF and header lists up to the first frame's chunk."""
    avih = struct.pack("<14I", MICROSECONDS, largest * 25, 0, 0x10, frames, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, MICROSECONDS, 1_000_000, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body

    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    size = 4 + len(hdrl) + 12 + movi + 8 + 16 * frames
    return b"RIFF" + struct.pack("<I", size) + b"AVI " + hdrl + b"LIST" + struct.pack("<I", 4 + movi) + b"movi"


class Video(NamedTuple):
    microseconds: int
    starts: np.ndarray  # of the frames' bytes
    sizes: np.ndarray


def parse_avi(data: bytes) -> Video:
    """Frame times and places by the RIFF index; a file without idx1 has its movi list walked."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("no RIFF AVI header")
    micro, movi, index = 0, None, None

    def walk(at: int, end: int) -> None:
        nonlocal micro, movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + size > len(data):
                raise MediaError("a chunk runs over the end")
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = (at + 8, at + 8 + size)
            elif name == b"LIST":
                walk(at + 12, at + 8 + size)
            elif name == b"avih":
                micro = int.from_bytes(data[at + 8 : at + 12], "little")
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4).astype(np.int64)
            at += 8 + size + (size & 1)

    walk(12, len(data))
    if movi is None:
        raise MediaError("no movi list")
    if index is not None:
        rows = index[(index[:, 0] >> 16) & 0xFFFF == int.from_bytes(b"dc", "little")]
        starts, sizes = movi[0] + rows[:, 2] + 8, rows[:, 3]
    else:
        found, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at + 2 : at + 4] == b"dc":
                found.append((at + 8, size))
            at += 8 + size + (size & 1)
        starts, sizes = np.array(found, np.int64).reshape(-1, 2).T
    if len(starts) and (int((starts + sizes).max()) > len(data) or int(sizes.min()) < 4):
        raise MediaError("the index points outside the file")
    return Video(micro, starts, sizes)


class FrameHead(NamedTuple):
    length: int
    width: int
    height: int
    difference: np.ndarray  # by the next 16 bits
    consumed: np.ndarray


def parse_jpeg_head(data: bytes) -> FrameHead:
    """Markers up to the scan of a lossless, one-component, 8-bit frame with the left predictor."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("no JPEG frame")
    at, size, codes = 2, None, None
    while at + 4 <= len(data):
        marker, n = data[at : at + 2], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        if marker == b"\xff\xc3":
            if body[0] != 8 or body[5] != 1:
                raise MediaError("only one 8-bit component is read")
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
        elif marker == b"\xff\xc4":
            codes = codes_of(tuple(body[1:17]), tuple(body[17:]))
        elif marker == b"\xff\xda":
            if size is None or codes is None or body[3] != 1 or body[5] != 0:
                raise MediaError("a scan that is not read here")
            difference, consumed = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            for category, (code, length) in codes.items():
                if length + category > 16:
                    continue
                for extra in range(1 << category):
                    value = extra if not category or extra >> (category - 1) else extra - (1 << category) + 1
                    first = ((code << category) | extra) << (16 - length - category)
                    last = first + (1 << (16 - length - category))
                    difference[first:last], consumed[first:last] = value, length + category
            return FrameHead(at + 2 + n, *size, difference, consumed)
        elif marker[0] != 0xFF:
            raise MediaError("no marker")
        at += 2 + n
    raise MediaError("no scan")


_heads: dict[bytes, FrameHead] = {}


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The samples of every frame: lossless ones with the same header are decoded in step,
    baseline ones give their brightness plane."""
    out: list[np.ndarray | None] = [None] * len(starts)
    left = np.arange(len(starts))
    while len(left):
        one = data[starts[left[0]] : starts[left[0]] + sizes[left[0]]].tobytes()
        if is_baseline(one):
            try:
                out[left[0]], left = luma(one).ravel(), left[1:]
            except (BaselineError, IndexError, KeyError) as error:
                raise MediaError("a broken baseline frame") from error
            continue
        head = next((h for k, h in _heads.items() if one.startswith(k)), None)
        if head is None:
            head = parse_jpeg_head(one)
            if len(_heads) < 64:
                _heads[one[: head.length]] = head
        n = head.length
        fits = sizes[left] >= n + 2
        same = fits.copy()
        same[fits] = (data[starts[left[fits]][:, None] + np.arange(n)] == np.frombuffer(one[:n], np.uint8)).all(axis=1)
        group, left = left[same], left[~same]
        samples = _decode_group(data, starts[group] + n, sizes[group] - n - 2, head)
        for i, s in zip(group.tolist(), samples):
            out[i] = s
    return out


def _decode_group(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, head: FrameHead) -> np.ndarray:
    ends = np.cumsum(sizes)
    flat = data[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]
    first = ends - sizes
    stuffed = np.zeros(len(flat), bool)
    stuffed[1:] = (flat[1:] == 0) & (flat[:-1] == 0xFF)
    stuffed[first] = False
    kept = np.concatenate([[0], np.cumsum(~stuffed)])
    flat = np.concatenate([flat[~stuffed], np.zeros(3, np.uint8)]).astype(np.int64)
    window = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    at, stop = kept[first] * 8, kept[ends] * 8
    count = head.width * head.height
    difference = np.empty((count, len(starts)), np.int64)
    limit = len(window) - 1
    for k in range(count):
        bits = (window[np.minimum(at >> 3, limit)] >> (8 - (at & 7))) & 0xFFFF
        difference[k] = head.difference[bits]
        at = at + head.consumed[bits]
    if (at > stop).any() or (at + 8 <= stop).any():
        raise MediaError("a frame's scan does not fit its samples")
    grid = difference.T.reshape(-1, head.height, head.width)
    grid[:, 0, 0] += 128
    grid[:, :, 0] = np.cumsum(grid[:, :, 0], axis=1)
    return (np.cumsum(grid, axis=2) & 0xFF).astype(np.uint8).reshape(len(starts), count)


def shot_starts(histograms: np.ndarray) -> np.ndarray:
    """Frames at which a shot begins: the first, and those whose histogram differs from the one
    before by more than the recent differences' mean and deviations, and by LEAST."""
    n = len(histograms)
    if n < 2:
        return np.arange(n)
    share = histograms / np.maximum(1, histograms.sum(axis=1, keepdims=True))
    d = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    i = np.arange(len(d))
    low = np.maximum(0, i - LOOK_BACK)
    seen = np.maximum(1, i - low)
    mean = (sums[i] - sums[low]) / seen
    spread = np.sqrt(np.maximum(0, (squares[i] - squares[low]) / seen - mean**2))
    cut = (d > LEAST) & ((i - low < 4) | (d > mean + DEVIATIONS * spread))
    return np.concatenate([[0], np.flatnonzero(cut) + 1])


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of every row: the text's UTF-8 bytes, filled up with spaces to a
    positive multiple of UNIT, as an AVI. A null text is empty and makes one blank frame;
    repeated rows are stored each; other columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = column_bytes(part.column("text"))
                sizes = np.diff(offsets)
                frames = np.maximum(1, -(-sizes // UNIT))
                payload = np.full(int(frames.sum()) * UNIT, 32, np.uint8)
                base = (np.cumsum(frames) - frames) * UNIT
                payload[np.arange(len(data)) + np.repeat(base - offsets[:-1], sizes)] = data
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes), pa.array(write_avis(payload, frames), pa.binary())], names=[key, "n_bytes", "media"])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"`{key}` {given.schema['key'].dataType.simpleString()}, n_bytes long, media binary")


def _videos(media: list[bytes | None]) -> Iterator[tuple[int, Video | None, list[np.ndarray]]]:
    """(row, video, frames) of each value; values that can't be read have no video. All frames
    of a batch are decoded together, and one by one only where one of them is broken."""
    videos: list[Video | None] = []
    for m in media:
        try:
            videos.append(parse_avi(m) if m is not None else None)
        except (MediaError, struct.error, IndexError):
            videos.append(None)
    base = np.cumsum([0] + [len(m) if m is not None else 0 for m in media])
    data = np.frombuffer(b"".join(m for m in media if m is not None), np.uint8)
    good = [i for i, v in enumerate(videos) if v is not None and len(v.starts)]
    try:
        starts = np.concatenate([videos[i].starts + base[i] for i in good]) if good else np.zeros(0, np.int64)
        sizes = np.concatenate([videos[i].sizes for i in good]) if good else np.zeros(0, np.int64)
        frames, at = decode_frames(data, starts, sizes), 0
        for i, video in enumerate(videos):
            n = len(video.starts) if video is not None else 0
            yield i, video, frames[at : at + n]
            at += n
    except (MediaError, IndexError):
        if len(media) == 1:
            yield 0, None, []
        else:
            for i, m in enumerate(media):
                yield from ((i, v, f) for _, v, f in _videos([m]))


def _histograms(frames: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(frames).astype(np.int64) >> 4
    frame = np.repeat(np.arange(len(frames)), [len(f) for f in frames])
    return np.bincount(frame * BINS + flat, minlength=len(frames) * BINS).reshape(-1, BINS)


def read(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """The columns of `media` with payload (all samples in frame order) and feature (frames,
    clips, mean sample, histogram) read back from the stored bytes; both null where the bytes
    are null or no readable AVI."""
    if {"payload", "feature"} & set(media.columns):
        raise ValueError("the table has a column named payload or feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch, column):
                payload, feature = [], []
                for _, video, frames in _videos(part.column(column).to_pylist()):
                    if video is None:
                        payload.append(None)
                        feature.append(None)
                        continue
                    whole = np.concatenate(frames) if frames else np.zeros(0, np.uint8)
                    histograms = _histograms(frames) if frames else np.zeros((0, BINS), np.int64)
                    shots = len(shot_starts(histograms))
                    bins = ".".join(map(str, histograms.sum(axis=0).tolist()))
                    payload.append(whole.tobytes())
                    feature.append(f"{len(frames)} frames, {shots} clips, mean {int(whole.sum()) // max(1, len(whole))}, histogram {bins}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string())], names=[*part.schema.names, "payload", "feature"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, f"{fields}, payload binary, feature string")


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, clip, first_frame, n_frames, start_ms, end_ms, mean): the timed clips of every
    readable video; null or unreadable bytes have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["clip", "first_frame", "n_frames", "start_ms", "end_ms", "mean"]
        for batch in batches:
            for part in _by_size(batch, "media"):
                rows, index = [], []
                for i, video, frames in _videos(part.column("media").to_pylist()):
                    if video is None or not frames:
                        continue
                    starts = shot_starts(_histograms(frames)).tolist()
                    ms = video.microseconds / 1000
                    for clip, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)])):
                        index.append(i)
                        rows.append((clip, a, b - a, int(a * ms), int(b * ms), float(np.concatenate(frames[a:b]).mean())))
                columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5 + [pa.array([], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(index, pa.int64())), *columns], names=[key, *names])

    given = media.select(F.col(key).alias("key"), F.col(column).alias("media"))
    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"`{key}` {kind}, clip long, first_frame long, n_frames long, start_ms long, end_ms long, mean double")


def _by_size(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    for i, value in enumerate(batch.column(column)):
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
