"""Signal measures per track from sampled blocks: sums in SQL, spectra in NumPy per frame."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators.joins import dealt_join
from tablemill.storage import stash

FRAME, HOP = 4096, 2048


def samples(blocks: DataFrame) -> DataFrame:
    """(track_id, sample_rate, position, left, right) from interleaved blocks; mono doubles."""
    n = F.size("samples") / F.col("channels")
    base = blocks.withColumn("_n", n.cast("long"))
    rows = base.select("track_id", "sample_rate", "channels", "block_id", "_n", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i", "_k"), "samples")
    left = F.get("samples", (F.col("_k") * F.col("channels")).cast("int"))
    right = F.get("samples", (F.col("_k") * F.col("channels") + F.when(F.col("channels") > 1, 1).otherwise(0)).cast("int"))
    # Blocks of a track are equally long but for the last.
    width = blocks.groupBy("track_id").agg(F.max(F.size("samples") / F.col("channels")).cast("long").alias("_w"))
    return rows.join(width, "track_id").select("track_id", "sample_rate", (F.col("block_id") * F.col("_w") + F.col("_k")).alias("position"), left.cast("double").alias("left"), right.cast("double").alias("right"))


def stereo_measures(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, dc_offset, phase, dual_mono, peak_db): mean, uncentred correlation, equal channels,
    peak over four-fold interpolation, which no sample exceeds."""
    x, y = F.col(left), F.col(right)
    sums = rows.groupBy(key).agg(
        F.avg((x + y) / 2).alias("dc_offset"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"),
        F.sum((x - y) * (x - y)).alias("_dd"), F.max(F.greatest(F.abs(x), F.abs(y))).alias("_peak"),
    )
    power = F.sqrt(F.col("_xx") * F.col("_yy"))
    return sums.select(
        key, "dc_offset", F.when(power < 1e-12, 0.0).otherwise(F.col("_xy") / power).alias("phase"),
        F.when(F.col("_xx") + F.col("_yy") > 0, F.col("_dd") / (F.col("_xx") + F.col("_yy")) < 1e-6).otherwise(F.lit(True)).alias("dual_mono"),
        F.when(F.col("_peak") > 1e-6, 20 * F.log10("_peak")).otherwise(-120.0).alias("peak_db"),
    )


def truncated(rows: DataFrame, key: str, position: str, value: str, tail: int) -> DataFrame:
    """(key, truncated): the last `tail` samples are at least half as loud as the whole."""
    ends = rows.groupBy(key).agg(F.max(position).alias("_end"), F.avg(F.col(value) * F.col(value)).alias("_all"))
    late = rows.join(ends, key).groupBy(key, "_all").agg(F.avg(F.when(F.col(position) > F.col("_end") - tail, F.col(value) * F.col(value))).alias("_late"))
    return late.select(key, ((F.sqrt("_all") > 1e-4) & (F.sqrt("_late") >= 0.5 * F.sqrt("_all"))).alias("truncated"))


def power_of(frames: np.ndarray) -> np.ndarray:
    """Squared magnitudes below half the rate of windowed frames (n, FRAME)."""
    return np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)[:, : FRAME // 2]) ** 2


def frames_of(x: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] if len(x) >= FRAME else np.zeros((0, FRAME))


def cutoff_of(power: np.ndarray, frames: int, rate: int) -> float:
    """Highest frequency above 2 kHz with a fall of 18 dB from the 500 Hz below it to the 500 Hz
    above, and no later bin, looked for in steps of that band, within 9 dB of the level below.

    power: sums over `frames` frames. 0 without a frame; half the rate where nothing falls or the
    spectrum is too short for two bands and their margins."""
    if frames == 0:
        return 0.0
    hz, bins, reach = rate / FRAME, len(power), 5
    mean = power / frames
    level = np.where(mean <= 1e-12, -120.0, 10 * np.log10(np.maximum(mean, 1e-12)))
    width = np.convolve(np.ones(bins), np.ones(2 * reach + 1), "same")
    smooth = np.convolve(level, np.ones(2 * reach + 1), "same") / width
    band = max(2, math.ceil(500 / hz))
    margin = band + reach + 1
    lowest = max(margin, math.ceil(2000 / hz))
    if bins <= lowest + margin:
        return bins * hz
    sums = np.concatenate([[0.0], np.cumsum(smooth)])
    at = np.arange(lowest, bins - margin)
    above = (sums[at + band + 1] - sums[at + 1]) / band
    below = (sums[at] - sums[at - band]) / band
    for k in at[below - above >= 18][::-1].tolist():
        if not (smooth[k + band + 1 :: band] >= below[k - lowest] - 9).any():
            return k * hz
    return bins * hz


def spectrum_cutoff(x: np.ndarray, rate: int) -> float:
    """cutoff_of the frames of one signal."""
    frames = frames_of(x)
    return cutoff_of(power_of(frames).sum(axis=0), len(frames), rate)


def flatness_of(power: np.ndarray, rate: int, low: float, high: float) -> np.ndarray:
    """10 log10(geometric / arithmetic mean) of the band's power, a value a frame; none where the
    band has eight bins or fewer."""
    hz = rate / FRAME
    part = power[:, math.ceil(low / hz) : min(power.shape[1], math.floor(high / hz))] + 1e-20
    if part.shape[1] <= 8:
        return np.zeros(0)
    return 10 * (np.log10(part).mean(axis=1) - np.log10(part.mean(axis=1)))


def upper_middle(values: np.ndarray) -> float | None:
    return float(np.sort(values)[len(values) // 2]) if len(values) else None


def flatness(x: np.ndarray, rate: int, low: float, high: float) -> float | None:
    """Upper median over the frames of one signal of the band's flatness."""
    return upper_middle(flatness_of(power_of(frames_of(x)), rate, low, high))


def mono(samples: np.ndarray | None, channels: int) -> np.ndarray:
    """The mean of the first two of interleaved channels."""
    flat = np.zeros(0) if samples is None else np.asarray(samples, float)
    return flat[: len(flat) // channels * channels].reshape(-1, channels)[:, :2].mean(axis=1)


def outer(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, tail) of a block: its first and last HOP samples; a tail of one sample marks a length that is no multiple of HOP."""
    return x[:HOP], x[len(x) // HOP * HOP :][:1] if len(x) % HOP else x[-HOP:]


def across(tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The one frame, or none, that starts in a block with this tail and ends in the next one with this head."""
    if len(tail) == 1 and len(head):
        raise ValueError(f"a block that others follow has a number of frames that is no multiple of {HOP}")
    return np.concatenate([tail, head])[None, :] if len(tail) == len(head) == HOP else np.zeros((0, FRAME))


def walked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(track, rate, block, samples, first, frames, head, tail) of blocks as they come. `frames` are those inside the block,
    behind the one across the border to the block before if that came just before it; `first` is the place of the first one in
    HOPs from the block's begin. `head` and `tail` are the block's outer samples where no neighbour came beside them, else None."""
    held: tuple | None = None  # the block before, and its tail
    for pdf in batches:
        for track, rate, channels, block, samples in pdf[["track_id", "sample_rate", "channels", "block_id", "samples"]].itertuples(index=False, name=None):
            x = mono(samples, channels)
            head, tail = outer(x)
            frames, border = frames_of(x), np.zeros((0, FRAME))
            met = held is not None and (track, block) == (held[0][0], held[0][2] + 1)
            if met:
                border = across(held[1], head)
            if held is not None:
                yield (*held[0], None if met else held[1])
            held = (track, rate, block, len(x), -len(border), np.concatenate([border, frames]), None if met or block == 0 else head), tail
    if held is not None:
        yield (*held[0], held[1])


def spectra(blocks: DataFrame) -> DataFrame:
    """(track_id, cutoff_hz, flat_fixed, flat_top) of blocks (track_id, sample_rate, channels, block_id, samples):
    blocks are numbered without gaps, hold a multiple of HOP frames each but for a track's last, and interleave
    channels. Blocks of a track that come one behind the other give one sum of their frames' spectra, and only the outer
    samples of such a stretch travel to meet their neighbours; sums meet in two steps, 256 blocks first. Tracks without a
    frame have a cutoff of 0."""
    names = ["track_id", "sample_rate", "part", "first", "last", "n", "power", "fixed", "top", "head", "tail"]

    def measured(frames: np.ndarray, rate: int) -> tuple:
        power, top = power_of(frames), rate / 2
        return len(power), power.sum(axis=0), flatness_of(power, rate, 16000, 20000), flatness_of(power, rate, 0.8 * top, 0.98 * top)

    def summed(parts: list) -> tuple:
        if not parts:
            return 0, np.zeros(0), np.zeros(0), np.zeros(0)
        n, power, fixed, top = zip(*parts)
        return sum(n), np.sum(np.stack(power), axis=0), np.concatenate(fixed), np.concatenate(top)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        stretch: list | None = None  # track, rate, part, first, last, sums, head, tail
        for track, rate, block, _, _, frames, head, tail in walked(batches):
            if stretch is None or (track, block, block // 256) != (stretch[0], stretch[4] + 1, stretch[2]) or head is not None:
                if stretch is not None:
                    out.append((*stretch[:5], *summed(stretch[5]), *stretch[6:]))
                stretch = [track, rate, block // 256, block, block, [], head, tail]
            stretch[4], stretch[7] = block, tail
            if len(frames):
                stretch[5].append(measured(frames, rate))
            if len(out) >= 64:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if stretch is not None:
            out.append((*stretch[:5], *summed(stretch[5]), *stretch[6:]))
        yield pd.DataFrame(out, columns=names, dtype=object)

    def added(rows: list[tuple]) -> tuple:
        """One stretch of several in order, with the frames across the borders between."""
        parts = [tuple(r[5:9]) for r in rows if r[5]]
        for before, after in zip(rows, rows[1:]):
            if before[4] + 1 == after[3] and before[10] is not None and after[9] is not None:
                border = across(before[10], after[9])
                parts.extend([measured(border, after[1])] if len(border) else [])
        return (*rows[0][:4], rows[-1][4], *summed(parts), rows[0][9], rows[-1][10])

    def folded(keys: int, columns: list[str], made: Callable[[tuple], tuple]):
        """Of rows sorted by track and place, one for each run of the same `keys`."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (row for pdf in batches for row in pdf[names].itertuples(index=False, name=None))
            found = (made(added(list(part))) for _, part in groupby(rows, lambda r: (r[0], r[2])[:keys]))
            while some_rows := list(islice(found, 64)):
                yield pd.DataFrame(some_rows, columns=columns, dtype=object)

        return run

    def judged(row: tuple) -> tuple:
        track, rate, _, _, _, n, power, fixed, top, _, _ = row
        return track, cutoff_of(power, n, int(rate)), upper_middle(fixed), upper_middle(top)

    schema = "track_id long, sample_rate int, part long, first long, last long, n long, power array<double>, fixed array<double>, top array<double>, head array<double>, tail array<double>"
    parts = blocks.mapInPandas(some, schema).repartition("track_id", "part").sortWithinPartitions("track_id", "first").mapInPandas(folded(2, names, lambda row: row), schema)
    columns = ["track_id", "cutoff_hz", "flat_fixed", "flat_top"]
    return parts.repartition("track_id").sortWithinPartitions("track_id", "first").mapInPandas(folded(1, columns, judged), "track_id long, cutoff_hz double, flat_fixed double, flat_top double")


def spectrogram(blocks: DataFrame, block_frames_each: int, most_columns: int = 1200, most_bins: int = 384) -> DataFrame:
    """(track_id, column, levels) of blocks as in `spectra`, of `block_frames_each` frames each but for a track's last: every
    second frame of a track, or every so many of these that `most_columns` remain, as bytes: levels of -100 dB to full
    scale are 0 to 255, the loudest of neighbouring bins stands for them so that `most_bins` remain.

    Levels are made where the samples lie and written once, with the number of samples and those outer ones that wait for a
    neighbour: no block travels. Tracks' lengths tell afterwards how many columns remain."""
    pool = -(-(FRAME // 2) // most_bins)
    full = (np.hanning(FRAME).mean() * FRAME / 2) ** 2
    per_block = block_frames_each // HOP
    names = ["track_id", "frame", "levels", "n", "head", "tail"]

    def shown(frames: np.ndarray) -> list[bytes]:
        power = power_of(frames)
        db = np.where(power <= 1e-12, -100.0, 10 * np.log10(np.maximum(power, 1e-300) / full))
        level = ((np.clip(db, -100, 0) + 100) / 100 * 255).astype(np.uint8)
        return [x.tobytes() for x in np.maximum.reduceat(level, np.arange(0, level.shape[1], pool), axis=1)]

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        for track, _, block, n, first, frames, head, tail in walked(batches):
            number = block * per_block + first + np.arange(len(frames))
            even = number % 2 == 0
            if even.any():
                out.extend((track, k, x, None, None, None) for k, x in zip(number[even].tolist(), shown(frames[even])))
            before, behind = block * per_block - 1, (block + 1) * per_block - 1
            if tail is not None and behind % 2 and len(tail) > 1:
                tail = None  # that frame is not shown; a tail of one sample goes on, as none may follow it
            if head is not None and before % 2:
                head = head[:1]
            out.append((track, None, None, n, None, None))
            out.extend([(track, before, None, None, head, None)] if head is not None else [])
            out.extend([(track, behind, None, None, None, tail)] if tail is not None else [])
            if len(out) >= 256:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        yield pd.DataFrame(out, columns=names, dtype=object)

    def bordering(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            met = [(t, k, across(a, b)) for t, k, a, b in pdf[["track_id", "frame", "tail", "head"]].itertuples(index=False, name=None)]
            yield pd.DataFrame([(t, k, shown(f)[0]) for t, k, f in met if len(f)], columns=["track_id", "frame", "levels"])

    made = stash(blocks.mapInPandas(levels, "track_id long, frame long, levels binary, n long, head array<double>, tail array<double>"), "levels")
    heads = made.where("head is not null").select("track_id", "frame", "head").hint("merge")
    borders = made.where("tail is not null").select("track_id", "frame", "tail").join(heads, ["track_id", "frame"])
    found = made.where("levels is not null").select("track_id", "frame", "levels").unionByName(borders.mapInPandas(bordering, "track_id long, frame long, levels binary"))
    sizes = made.where("n is not null").groupBy("track_id").agg(F.sum("n").alias("n"))
    columns = F.floor(F.floor((F.col("n") - FRAME) / HOP) / 2) + 1
    strides = sizes.select("track_id", F.greatest(F.ceil(columns / most_columns), F.lit(1)).cast("long").alias("stride"))
    kept = dealt_join(found, strides, ["track_id"], ["frame"]).where(F.col("frame") % (2 * F.col("stride")) == 0)
    return kept.select("track_id", (F.col("frame") / (2 * F.col("stride"))).cast("long").alias("column"), "levels")
