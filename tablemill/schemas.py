"""Schemas of the catalogue tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from `name type, name type`; no session is needed."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TRACKS = _struct(
    "id long, path string, filename string, folder string, status string, target_format string, verdict string, "
    "verdict_ver long, real_quality string, bitrate long, size_bytes long, mtime long, source_id long, "
    "analysis_attempts long, duration double, cutoff_hz double, clip_pct double, true_peak_dbtp double, "
    "dc_offset double, phase_correlation double, truncated boolean, has_cover boolean, tags_cdj_ok boolean, "
    "dual_mono boolean, container_ok boolean, fingerprint string, fingerprint_ver long, report_json string, "
    "report_cache_ver long, analyzed_at timestamp, created_at timestamp, confidence string"
)
METADATA = _struct(
    "track_id long, artist string, title string, version string, label string, year long, bpm long, "
    "cover_path string, discogs_release_id long, source string"
)
GENRES = _struct("track_id long, genre string, ord long")
SOURCES = _struct("id long, path string, watched boolean, created_at timestamp, color_key string")
ACTIONS = _struct(
    "id long, track_id long, type string, from_path string, to_path string, ts timestamp, undone boolean, "
    "batch_id string, meta string, session_id string"
)
EDGES = _struct("a_id long, b_id long, similarity double")
LISTING = _struct("path string, filename string, size_bytes long, mtime long")
EVENTS = _struct("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
SIGNAL = _struct("track_id long, channels int, sample_rate int, block_id long, samples array<float>")
