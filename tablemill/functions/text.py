"""Names, paths and formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTS, PLAIN = "àâäáãçéèêëîïíìôöóòõùûüúñ", "aaaaaceeeeiiiiooooouuuun"
# Tokens that mark a field as sloppy download metadata.
JUNK = ["kbps", "khz", "flac", "http", "www", "320", "256", "192", "128", "rip", "track ", "[", "]", "{", "}", "_"]
# Extensions that are one format, and the names of the special buckets.
EXTENSIONS = {".aif": ".aiff", ".jpeg": ".jpg", ".tif": ".tiff", ".mpeg": ".mpg"}
REKORDBOX_DIR, REKORDBOX_BUCKET, NO_EXTENSION = "PIONEER", "PIONEER/", "(sans extension)"
# Characters that file names may not hold.
FORBIDDEN = '/\\:*?"<>|'
# Genre families and their keywords, first match wins.
FAMILIES = [
    ("house", ["house", "garage"]),
    ("techno", ["techno", "electro", "industrial", "ebm", "trance", "acid", "minimal", "goa"]),
    ("discofunksoul", ["disco", "funk", "soul", "boogie"]),
    ("hiphop", ["hip hop", "hip-hop", "rap", "r&b", "rnb", "trap"]),
]


def norm(text: Column) -> Column:
    """Lower case with runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTS, PLAIN)


def name_key(artist: Column, title: Column) -> Column:
    """A key that spelling variants of a name share: folded, only letters and digits, one space."""
    plain = F.regexp_replace(fold(F.concat_ws(" ", artist, title)), r"[^\p{L}\p{N}]+", " ")
    return F.trim(plain)


def has_junk(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for token in JUNK:
        found = found | F.contains(low, F.lit(token))
    return F.coalesce(found, F.lit(False))


def is_clean(artist: Column, title: Column) -> Column:
    full = (F.trim(F.coalesce(artist, F.lit(""))) != "") & (F.trim(F.coalesce(title, F.lit(""))) != "")
    return full & ~has_junk(artist) & ~has_junk(title)


LAST_GROUP = r"(?s)^(.*)\(([^(]*)\)$"


def trailing_version(text: Column) -> Column:
    """(title, version): the last parenthesis as the version, if its closing sign ends the text
    and no other stands inside; else the text as it is."""
    some = text.rlike(LAST_GROUP)
    return F.struct(
        F.when(some, F.trim(F.regexp_extract(text, LAST_GROUP, 1))).otherwise(text).alias("title"),
        F.when(some, F.trim(F.regexp_extract(text, LAST_GROUP, 2))).alias("version"),
    )


def _after_separator(stem: Column) -> Column:
    at = F.instr(stem, " - ")
    return F.when(at > 0, F.substring(stem, at + 3, F.length(stem))).otherwise(stem)


def parse_name(stem: Column) -> Column:
    """(artist, title, version) of a clean `artist - title (version)` name, split at the first
    separator; null otherwise."""
    artist = F.trim(F.substring(stem, F.lit(1), F.instr(stem, " - ") - 1))
    parts = trailing_version(F.trim(_after_separator(stem)))
    good = (F.instr(stem, " - ") > 0) & is_clean(artist, parts["title"])
    return F.when(good, F.struct(artist.alias("artist"), parts["title"].alias("title"), parts["version"].alias("version")))


def version_hint(stem: Column) -> Column:
    """The version of a name whose other parts need not be clean."""
    return trailing_version(F.trim(_after_separator(stem)))["version"]


def reconcile(tag_artist: Column, tag_title: Column, stem: Column, cleaned: Column) -> Column:
    """(artist, title, version, confidence) from tags and file name; `cleaned` is the stem made
    readable. Clean tags give artist and title, the name gives the version; green unless both
    are clean and disagree, or neither is clean."""
    named, tags = parse_name(stem), is_clean(tag_artist, tag_title)
    agree = (norm(tag_artist) == norm(named["artist"])) & (norm(tag_title) == norm(named["title"]))
    both = tags & named.isNotNull()
    return F.struct(
        F.when(tags, F.trim(tag_artist)).otherwise(F.coalesce(named["artist"], F.lit(""))).alias("artist"),
        F.when(tags, F.trim(tag_title)).otherwise(F.coalesce(named["title"], cleaned)).alias("title"),
        F.when(named.isNotNull(), named["version"]).when(tags, version_hint(stem)).alias("version"),
        F.when((both & agree) | (tags & named.isNull()) | (~tags & named.isNotNull()), "green").otherwise("yellow").alias("confidence"),
    )


def sanitize(name: Column) -> Column:
    """A name safe for files: forbidden characters are spaces, runs of spaces one."""
    return F.trim(F.regexp_replace(F.translate(name, FORBIDDEN, " " * len(FORBIDDEN)), r"\s+", " "))


def render(template: str, artist: Column, title: Column, version: Column) -> Column:
    suffix = F.when(F.coalesce(F.trim(version), F.lit("")) != "", F.concat(F.lit(" ("), F.trim(version), F.lit(")"))).otherwise("")
    out = F.lit(template)
    for name, value in (("{artist}", artist), ("{title}", title), ("{version}", suffix)):
        out = F.replace(out, F.lit(name), F.coalesce(value, F.lit("")))
    return sanitize(out)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its extension; a dotfile is all stem."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Canonical lower-case extension with its dot; null for none and for dotfiles."""
    found = F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))
    same = found
    for name, kept in EXTENSIONS.items():
        same = F.when(found == name, kept).otherwise(same)
    return F.when(found != "", same)


def usage_bucket(path: Column) -> Column:
    """The export folder for anything whose first component it is (any case), else the
    canonical extension; paths are relative to the volume."""
    first = F.upper(F.substring_index(F.translate(path, "\\", "/"), "/", 1))
    return F.when(first == REKORDBOX_DIR, REKORDBOX_BUCKET).otherwise(F.coalesce(extension(path), F.lit(NO_EXTENSION)))


def genre_family(genre: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(genre, F.lit(""))))
    out = F.lit("autre")
    for family, words in reversed(FAMILIES):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, family).otherwise(out)
    return out


def display_name(artist: Column, title: Column, path: Column) -> Column:
    both = (F.coalesce(artist, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != "")
    base = basename(path)
    return F.when(both, F.concat(artist, F.lit(" — "), title)).when(base != "", base).otherwise(path)


def clock(seconds: Column) -> Column:
    """m:ss, seconds rounded after the minutes are taken, so 60 can appear."""
    minutes = F.floor(seconds / 60)
    return F.format_string("%d:%02d", minutes, F.round(seconds - minutes * 60).cast("long"))


def tokens(text: Column) -> Column:
    """Folded alphanumeric words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def integer_list(text: Column) -> Column:
    """Comma text to integers; what is no integer is dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def stored_or_named(artist: Column, title: Column, path: Column) -> Column:
    """(artist, title): as stored if either is not empty, else as the file name tells, else empty."""
    some = (F.coalesce(artist, F.lit("")) != "") | (F.coalesce(title, F.lit("")) != "")
    named = parse_name(stem(path))

    def of(stored: Column, field: str) -> Column:
        return F.when(some, F.coalesce(stored, F.lit(""))).otherwise(F.coalesce(named[field], F.lit("")))

    return F.struct(of(artist, "artist").alias("artist"), of(title, "title").alias("title"))
