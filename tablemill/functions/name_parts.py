"""Parts of dirty file names as Column expressions: spelling, kinds, tags, fields, queries.

Nulls stay null; an empty name has no fields."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.dirty_names import (
    ADDRESS, AHEAD, BARE_QUALITY, GENERIC, JOINED, LABEL, LEAD_DROPPED, LOOSE_NOISE, NOISE_PARENS, PHRASE_ENDS, PLACE, QUALITY_WORDS, SIDE,
    STEM_NOISE, TAIL_DROPPED, VERSION_WORDS, _any,
)

EDGES = " -,;"
SEPARATORS = [" -+ ", r" -+|-+ |\.-+|--+", "-"]
TAG = r"\s*-+\s*(?:[0-9A-Fa-f]{8}|[0-9]{1,3}|[A-Z]{3,8})\z"
SMALL_TAG = r"\s*-+\s*(?:[0-9A-Fa-f]{8}|[0-9]{1,3}|[A-Z]{3,8}|[a-z]{2,5})\z"


def squeeze(text: Column) -> Column:
    """Runs of any spaces are one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(name: Column) -> Column:
    """Long dashes are hyphens, exotic spaces and underscores are spaces."""
    return squeeze(F.translate(name, "\u2013\u2014\u00a0\u2007\u202f_", "--    "))


def bare(text: Column) -> Column:
    """Lower-case letters and digits alone: a key for loose comparison."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def kind(text: Column) -> Column:
    """noise (quality note, address, catalogue number), version or plain. A catalogue number has
    a digit, at most 24 bytes of UTF-8 and no version word."""
    low, short = F.lower(text), squeeze(text)
    quality = low.rlike(rf"\A\s*(?:{_any(BARE_QUALITY)})\s*\z|(?:{_any(QUALITY_WORDS)})")
    version = low.rlike(rf"(?Us)\A(?:.*[\W_])?(?:{_any(VERSION_WORDS)})(?:[\W_].*)?\z")
    numbered = short.rlike("[0-9]") & (F.octet_length(short) <= 24)
    return F.when(quality | low.rlike(ADDRESS.pattern), "noise").when(version, "version").when(numbered, "noise").when(text.isNotNull(), "plain")


def untagged(text: Column, small: Column) -> Column:
    """Without up to three tags of release groups at the end, those in small letters only where
    `small`; four letters or digits remain."""

    def step(now: Column, _: Column) -> Column:
        rest = F.when(small, F.regexp_replace(now, SMALL_TAG, "")).otherwise(F.regexp_replace(now, TAG, ""))
        return F.when(F.length(bare(rest)) >= 4, rest).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), text, step)


def fields(text: Column) -> Column:
    """The fields at the strongest separators that part a text at all."""

    def parts(by: str) -> Column:
        return F.filter(F.transform(F.split(text, by), lambda p: F.btrim(p, F.lit(EDGES))), lambda p: p != "")

    found = [parts(by) for by in SEPARATORS]
    out = F.when(F.size(found[0]) > 1, found[0])
    for one in found[1:]:
        out = out.when(F.size(one) > 1, one)
    return out.otherwise(parts(r"\z"))


def trailing_phrase(title: Column) -> Column:
    """(title, phrase): the last two words are a version if the last says so and a word is left."""
    words = F.split(squeeze(title), " ")
    n = F.size(words)
    said = (n > 2) & bare(F.element_at(words, -1)).isin(PHRASE_ENDS)
    rest, phrase = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice(words, F.greatest(n - 1, F.lit(1)), F.lit(2))
    return F.struct(F.when(said, F.array_join(rest, " ")).otherwise(title).alias("title"), F.when(said, F.array_join(phrase, " ")).alias("phrase"))


def queries(*asked: Column) -> Column:
    """The texts that have three letters or digits or more, each once without regard to case,
    in the order given; nulls are left out."""
    every = F.filter(F.transform(F.array(*asked), squeeze), lambda q: F.length(bare(q)) >= 3)
    # The distinct lower-cased texts keep their first places.
    return F.aggregate(every, F.expr("cast(array() as array<string>)"), lambda said, q: F.when(F.exists(said, lambda s: F.lower(s) == F.lower(q)), said).otherwise(F.array_append(said, q)))


def clean_stem(stem: Column) -> Column:
    """A name for people to edit: square brackets, leading noisy parentheses, track number and
    quality words go. Parentheses are judged from the first on, up to one that is not noisy."""
    text = F.regexp_replace(F.translate(stem, "_", " "), r"\[[^\]]*\]", " ")
    text = F.regexp_replace(text, rf"\G([^(]*)\([^)]*(?i:{_any(NOISE_PARENS)})[^)]*\)", "$1 ")
    text = F.regexp_replace(text, r"\A\s*[0-9]{1,3}[ .\-)_]+(?=[^ .\-)_])", "")
    return F.array_join(F.filter(F.split(squeeze(text), " "), lambda w: ~F.lower(w).isin(STEM_NOISE)), " ")


MARK = "\ue000"
PAIR = r"[(\[{]([^()\[\]{}]*)[)\]}]"
STOP = rf"\s()\[\]{{}}{MARK}"
#: Letters with accents and the letters below them, by Unicode's decomposition.
PARTED = {c: d[0] for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:]))}


def noiseless(text: Column) -> Column:
    """Without addresses and words that name a quality."""
    text = F.regexp_replace(text, rf"(?i)[\-.,]*(?:www\.|https?://)[^{STOP}]*", "")
    return F.regexp_replace(text, rf"(?U)(?<![^{STOP}])[[\W_]&&[^{STOP}]]*(?i:{_any(LOOSE_NOISE)})[[\W_]&&[^{STOP}]]*(?![^{STOP}])", "")


def groups(name: Column) -> Column:
    """(text, groups): the insides of bracket pairs, in the order of their closing, any closing
    bracket for any opening one, and the text with a mark for each. A group inside another one
    stands alone, its mark before the other's."""

    def step(state: Column, _: Column) -> Column:
        text = state["text"]
        whole, inner = F.regexp_extract(text, PAIR, 0), F.regexp_extract(text, PAIR, 1)
        at = F.instr(text, whole)
        inside = F.replace(inner, F.lit(MARK), F.lit(""))
        marks = F.repeat(F.lit(MARK), F.length(inner) - F.length(inside) + 1)
        shorter = F.concat(F.substring(text, F.lit(1), at - 1), marks, F.substring(text, at + F.length(whole), F.length(text)))
        return F.when(whole == "", state).otherwise(F.struct(shorter.alias("text"), F.array_append(state["groups"], inside).alias("groups")))

    n = F.length(F.regexp_replace(name, r"[^)\]}]", ""))
    rounds = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(rounds, F.struct(name.alias("text"), F.expr("cast(array() as array<string>)").alias("groups")), step)


def stripped(rows: DataFrame, name: str, out: str) -> DataFrame:
    """`rows` with the column `out`: the text of the column `name` without groups, noise, tags, and
    side or track number ahead; and the last group with text before it that is a version, or
    plain with no word behind it. What is used again has a column, as lambdas share nothing."""
    kept, name = rows.columns, F.col(name)
    rows = rows.withColumn("_groups", groups(normalised(name)))
    rows = rows.withColumns({"_clean": noiseless(F.regexp_replace("_groups.text", r"[()\[\]{}]", "")), "_raw": F.split("_groups.text", MARK)})
    rows = rows.withColumn("_segments", F.split("_clean", MARK))
    found, text, segments = F.col("_groups"), F.col("_clean"), F.col("_segments")

    def version(said: Column, i: Column) -> Column:
        before = F.trim(F.array_join(F.slice(segments, F.lit(1), i + 1), " ")) != ""
        behind = F.array_join(F.slice("_raw", i + 2, F.size(segments)), " ")
        last = ~F.regexp_replace(behind, r"\.?-+", "").rlike(r"[^\s()\[\]{}]")
        says = kind(said)
        return F.when(before & ((says == "version") | (says == "plain") & last), squeeze(said))

    versions = F.filter(F.transform(found["groups"], version), lambda v: v.isNotNull())
    plain = untagged(squeeze(F.replace(text, F.lit(MARK), F.lit(" "))), F.contains(name, F.lit("_")))
    done = F.struct(squeeze(F.regexp_replace(plain, rf"\A{AHEAD.pattern}", "")).alias("text"), F.try_element_at(versions, F.lit(-1)).alias("version"))
    return rows.select(*kept, done.alias(out))


def label(text: Column) -> Column:
    return F.lower(text).rlike(LABEL.pattern)


def told(found: Column) -> Column:
    """What roles() asks of fields: each one's place, key, and whether it is a label or a scrap."""
    return F.transform(found, lambda f, i: F.struct(i.alias("i"), bare(f).alias("key"), label(f).alias("label"), (F.length(bare(f)) <= 2).alias("scrap")))


def final_version(found: Column) -> Column:
    """Whether the last field says a version."""
    return kind(F.try_element_at(found, F.lit(-1))) == "version"


def roles(found: Column, info: Column, said: Column) -> Column:
    """(artist, title, version) of the fields, with their told() and final_version(), at least cost, ties by fewer fields dropped ahead,
    then behind. Dropping costs nothing for a label, ahead also for what the last field says
    again, behind for a scrap or what was said; a version is the last of three fields or more
    and has four words at most."""
    n, last = F.size(found), F.element_at(found, -1)
    final = F.element_at(info, -1)["key"]
    brief = F.size(F.split(squeeze(last), " ")) <= 4

    def count(rule) -> Column:
        return F.size(F.filter(info, rule))

    def repeated(x: Column) -> Column:
        return F.exists(info, lambda y: (y["i"] >= 1) & (y["i"] < x["i"]) & (y["key"] == x["key"]))

    def choice(lead: Column, end: Column) -> Column:
        ahead = F.least(count(lambda x: (x["i"] < lead) & ~x["label"] & (x["key"] != final)), F.lit(3))
        behind = count(lambda x: (x["i"] >= end) & ~x["scrap"] & ~x["label"] & ~repeated(x))
        idle = count(lambda x: (x["i"] >= lead) & (x["i"] < end) & (x["label"] | x["scrap"] & (x["i"] > 0)))
        named = (n - end == 1) & (n >= 3) & said & brief
        cost = F.element_at(F.array(*map(F.lit, LEAD_DROPPED)), ahead + 1) + (end - lead - 2) * JOINED + F.when(named, 0).otherwise(behind * TAIL_DROPPED)
        cost += idle + F.when((end == n) & (n >= 3) & said, 2).otherwise(0)
        return F.struct(cost.alias("cost"), lead.alias("lead"), (-end).alias("end"), named.alias("named"))

    every = F.transform(F.sequence(F.lit(0), n - 2), lambda lead: F.transform(F.sequence(lead + 2, n), lambda end: choice(lead, end)))
    best = F.array_min(F.flatten(every))
    title = F.array_join(F.slice(found, best["lead"] + 2, -best["end"] - best["lead"] - 1), " - ")
    one = F.struct(F.lit("").alias("artist"), F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("title"), F.lit(None).cast("string").alias("version"))
    return F.when(n < 2, one).otherwise(F.struct(F.element_at(found, best["lead"] + 1).alias("artist"), title.alias("title"), F.when(best["named"], last).alias("version")))


def named_fields(text: Column) -> Column:
    """The fields that are no side, track number or year."""
    return F.filter(fields(text), lambda f: ~f.rlike(rf"(?i)\A(?:{PLACE.pattern})\z"))


def folded(text: Column) -> Column:
    """Lower-case letters and digits without accents, other characters as spaces."""
    plain = F.translate(F.lower(text), "".join(PARTED), "".join(PARTED.values()))
    return squeeze(F.regexp_replace(F.regexp_replace(plain, r"\p{M}", ""), r"[^\p{L}\p{N}]", " "))


def plausible(name: Column) -> Column:
    return (F.octet_length(name) >= 2) & (F.length(name) <= 60) & name.rlike(r"\p{L}") & ~bare(name).isin(GENERIC)


def with_terms(rows: DataFrame, stem: Column, folder: Column) -> DataFrame:
    """`rows` with a column `terms`: artist, title and version of dirty names, and the queries to
    ask for them from the most to the least exact. An artist missing from the name may come from
    the folder, as the album of a further query does. Null names are empty; names that say
    nothing have empty terms. Each step is a column of its own, so that it is computed once.

    A name takes about a millisecond and few bytes, so the rows are dealt out first: files of names make few tasks."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row")  # whose names may be any
    out = rows.select(own, F.coalesce(stem, F.lit("")).alias("_stem"), F.coalesce(folder, F.lit("")).alias("_folder"))
    out = stripped(stripped(out, "_stem", "_read"), "_folder", "_place").withColumn("_place", F.col("_place.text"))
    out = out.withColumns({"_fields": named_fields(F.col("_read.text")), "_place": F.filter(named_fields(F.col("_place")), lambda f: ~label(f))})
    out = out.withColumns({"_told": told(F.col("_fields")), "_final": final_version(F.col("_fields"))})
    out = out.withColumn("_roles", roles(F.col("_fields"), F.col("_told"), F.col("_final")))
    out = out.withColumn("_said", trailing_phrase(F.trim(F.regexp_replace(F.col("_roles.title"), rf"\A{SIDE.pattern}", ""))))
    title, nothing = F.col("_said.title"), bare(F.col("_said.title")).isin(GENERIC)
    many = F.size("_place") > 1
    mined, album = (F.when(many & plausible(F.try_element_at("_place", F.lit(i))), F.try_element_at("_place", F.lit(i))) for i in (1, 2))
    artist = F.when(F.col("_roles.artist") == "", F.coalesce(mined, F.lit(""))).otherwise(F.col("_roles.artist"))
    out = out.withColumns({
        "_title": F.when(nothing, "").otherwise(title), "_artist": F.when(nothing, "").otherwise(artist), "_album": album,
        "_version": F.when(~nothing, F.coalesce("_read.version", "_roles.version", "_said.phrase")),
    })
    artist, title, whole = F.col("_artist"), F.col("_title"), F.replace(F.col("_read.text"), F.lit("-"), F.lit(" "))
    some = title != ""
    asked = queries(
        F.when(some, F.concat_ws(" ", artist, title, "_version")), F.when(some, F.concat_ws(" ", artist, title)), F.when(some, title), whole,
        F.when(some & (folded(title) != F.lower(title)), F.concat_ws(" ", folded(artist), folded(title))),
        F.when(some & F.col("_album").isNotNull(), F.concat_ws(" ", F.when(artist != "", artist).otherwise(title), "_album")),
    )
    terms = F.struct(artist.alias("artist"), title.alias("title"), F.col("_version").alias("version"), asked.alias("queries"))
    return out.select("_row.*", terms.alias("terms"))
