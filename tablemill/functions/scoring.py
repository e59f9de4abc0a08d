"""Scores of release candidates against a wanted track, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.text import tokens

# Format descriptors and their weight.
FORMAT_WEIGHTS = {
    "compilation": -3, "mixed": -3, "dj mix": -3,
    "single": 2, "ep": 2, "maxi-single": 2,
    "vinyl": 1, '12"': 1, '7"': 1, '10"': 1,
}
# Words that mark an alternate take.
VERSION_KEYWORDS = [
    "remix", "rmx", "dub", "redub", "edit", "reedit", "rework", "vip", "bootleg", "instrumental", "acapella",
    "acappella", "version", "reprise", "remaster", "remastered", "beats", "tool",
]


def format_relevance(formats: Column) -> Column:
    """Sum of the weights of the comma-separated descriptors."""
    weights = F.create_map(*(F.lit(x) for pair in FORMAT_WEIGHTS.items() for x in pair))
    parts = F.transform(F.split(F.coalesce(formats, F.lit("")), ","), lambda p: F.coalesce(F.try_element_at(weights, F.lower(F.trim(p))), F.lit(0)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def track_score(track: Column, title: Column, version: Column) -> Column:
    """One for each wanted title word in the track's title (repeats count), three for each
    version word, two less for each distinct version keyword that nobody asked for."""
    have, wanted, mix = tokens(track), tokens(title), F.coalesce(tokens(version), F.array().cast("array<string>"))
    keywords = F.array(*map(F.lit, VERSION_KEYWORDS))
    unasked = F.array_except(F.array_intersect(have, keywords), F.concat(wanted, mix))
    hits = F.size(F.filter(wanted, lambda t: F.array_contains(have, t)))
    mixes = F.size(F.filter(mix, lambda t: F.array_contains(have, t)))
    return hits + 3 * mixes - 2 * F.size(unasked)
