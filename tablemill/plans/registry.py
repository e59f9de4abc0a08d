"""All queries on the catalogue side, with their SQL."""

from __future__ import annotations

from tablemill.plans import audio, browse, duplicates, exports, identify, journal, library, measures, sounds, state, streams, upkeep
from tablemill.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audio", "browse", "duplicates", "exports", "identify", "journal", "library", "measures", "sounds", "state", "streams", "upkeep"]
