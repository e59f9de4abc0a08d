"""The quality verdict and its tables, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENT_VERSION = 1
# Least plausible cutoff (Hz) of a declared bitrate, highest tier first.
CUTOFF_TIERS = [(320, 19000.0), (256, 18000.0), (192, 16500.0), (160, 15500.0), (128, 14500.0), (0, 12000.0)]
# Cutoffs of genuine and of certainly transcoded lossless audio; flatness floors.
GENUINE_HZ, FAKE_HZ, FLAT_FIXED, FLAT_TOP = 20000.0, 19500.0, -5.8, -23.8
# Declared rail by extension.
LOSSLESS, LOSSY = ("flac", "wav", "aif", "aiff", "alac"), ("mp3", "aac", "m4a", "ogg", "opus")


def least_cutoff(bitrate: Column) -> Column:
    out = F.lit(CUTOFF_TIERS[-1][1])
    for rate, hz in reversed(CUTOFF_TIERS[:-1]):
        out = F.when(bitrate >= rate, hz).otherwise(out)
    return out


def equivalent_bitrate(cutoff: Column) -> Column:
    """The highest tier whose cutoff is reached; 128 below all."""
    out = F.lit(128)
    for rate, hz in reversed(CUTOFF_TIERS[:-1]):
        out = F.when(cutoff >= hz, rate).otherwise(out)
    return out


def rail(extension: Column) -> Column:
    e = F.lower(extension)
    return F.when(e.isin(*LOSSLESS), "lossless").when(e.isin(*LOSSY), "lossy").otherwise("unknown")


def verdict(cutoff: Column, declared: Column, content: Column, bitrate: Column, flat_fixed: Column, flat_top: Column) -> Column:
    """ok, fake or grey; measures that are null never accuse."""
    flat = F.coalesce(flat_fixed < FLAT_FIXED, F.lit(False)) | F.coalesce(flat_top < FLAT_TOP, F.lit(False))
    lossless = (
        F.when(content == "lossy", "fake").when(cutoff <= 0, "grey")
        .when(cutoff >= GENUINE_HZ, F.when(flat, "grey").otherwise("ok"))
        .when(cutoff <= FAKE_HZ, "fake").otherwise("grey")
    )
    lossy = F.when(cutoff <= 0, "grey").when(bitrate.isNotNull() & (cutoff < least_cutoff(bitrate)), "fake").otherwise("ok")
    return F.when(declared == "lossless", lossless).when(declared == "lossy", lossy).otherwise("grey")


def display_rank(verdict_: Column, lossless: Column) -> Column:
    return F.when(verdict_ == "fake", 0).when(verdict_ == "grey", 1).when(verdict_ == "ok", F.when(lossless, 4).otherwise(3)).otherwise(2)


def default_target(rail_: Column) -> Column:
    return F.when(rail_ == "lossless", "aiff_16_44").otherwise("mp3_320")


def upscale_refused(source_rail: Column, target: Column) -> Column:
    """Whether the target would put a lossy source into a lossless container."""
    return (source_rail == "lossy") & target.isin("aiff_16_44", "wav_16_44")
