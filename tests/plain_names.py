"""Search terms of dirty file names, name by name: what the Column forms are held against.

A name is read once into tokens: words, separators of three strengths, and bracketed groups. The
fields between the strongest separators are given roles in every order that makes sense; each role
has a cost by the field's kind, and the cheapest assignment wins."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from tablemill.functions.dirty_names import (
    ADDRESS, AHEAD, GENERIC, JOINED, LABEL, LEAD_DROPPED, LOOSE_NOISE, PHRASE_ENDS, PLACE, QUALITY, SIDE, SMALL_TAG, TAG, TAIL_DROPPED, TOKEN, VERSION,
)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def bare(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def kind(text: str) -> str:
    """What a group or field says. A catalogue number is noise: it has a digit, at most 24 bytes
    of UTF-8 and no version word."""
    low = text.lower()
    if QUALITY.match(low) or ADDRESS.search(low):
        return "noise"
    if VERSION.fullmatch(low):
        return "version"
    short = text.strip()
    return "noise" if short and len(short.encode()) <= 24 and re.search("[0-9]", short) else "plain"


def tokens(name: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a name: word, space, cut1 to cut3 by strength, and group for the inside of
    a pair of brackets, any closing an earlier opening one; groups inside groups stand alone."""
    plain = name.translate({0x2013: "-", 0x2014: "-", 0xA0: " ", 0x2007: " ", 0x202F: " "}).replace("_", " ")
    levels: list[list[tuple[str, str]]] = [[]]
    for found in TOKEN.finditer(squeeze(plain)):
        what, text = found.lastgroup, found.group()
        if what == "open":
            levels.append([])
        elif what == "close" and len(levels) > 1:
            inner = levels.pop()
            levels[-1] += [t for t in inner if t[0] == "group"] + [("group", "".join(t for k, t in inner if k != "group"))]
        elif what == "cut":
            before = bool(levels[-1]) and levels[-1][-1][0] == "space"
            levels[-1].append((f"cut{1 + before + text.endswith(' ')}", text))
        elif what != "close":
            levels[-1].append((what, text))
    for level in levels:
        yield from level


def without_tags(text: str, small: bool) -> str:
    """A text without up to three tags of release groups; four letters or digits remain."""
    rule = SMALL_TAG if small else TAG
    for _ in range(3):
        found = rule.search(text)
        if not found or len(bare(text[: found.start()])) < 4:
            break
        text = text[: found.start()]
    return text


def read(name: str) -> tuple[str, str | None]:
    """(the name without groups, noise, tags and places ahead; the version of its groups)."""
    out: list[str] = []
    version = None
    found = list(tokens(name))
    for i, (what, text) in enumerate(found):
        if what == "word":
            address = re.search(r"www\.|https?://", text, re.I)
            kept = text[: address.start()].rstrip("-.,") if address else text
            out.append("" if re.sub(r"^[\W_]+|[\W_]+$", "", kept.lower()) in LOOSE_NOISE else kept)
        elif what == "group":
            says = kind(text)
            last = not any(k == "word" for k, _ in found[i + 1 :])
            if "".join(out).strip() and (says == "version" or says == "plain" and last):
                version = squeeze(text)
            out.append(" ")
        else:
            out.append(f" {text.strip()} " if what == "cut3" else text)
    text = without_tags(squeeze("".join(out)), "_" in name)
    ahead = AHEAD.match(text)
    return squeeze(text[ahead.end() :] if ahead else text), version


def fields_of(text: str) -> list[str]:
    """The fields at the strongest separators that part a text at all."""
    for by in (r" -+ ", r" -+|-+ |\.-+|--+", "-"):
        parts = [p for p in (part.strip(" -,;") for part in re.split(by, text)) if p]
        if len(parts) > 1:
            return parts
    return [text.strip(" -,;")] if text.strip(" -,;") else []


def roles(fields: list[str]) -> tuple[str, str, str | None]:
    """(artist, title, version) of the fields at least cost. Dropping ahead costs nothing for a
    label or for what the last field says again, dropping behind nothing for a label or a scrap;
    a version is the last of three fields or more and has four words at most."""
    if len(fields) < 2:
        return "", fields[0] if fields else "", None
    n, keys = len(fields), [bare(f) for f in fields]
    best: tuple[int, int, int, int] | None = None
    for lead in range(n - 1):
        ahead = sum(1 for i in range(lead) if not LABEL.search(fields[i].lower()) and keys[i] != keys[-1])
        for end in range(lead + 2, n + 1):
            tail = range(end, n)
            named = n - end == 1 and n >= 3 and kind(fields[-1]) == "version" and len(fields[-1].split()) <= 4
            free = [i for i in tail if len(keys[i]) <= 2 or LABEL.search(fields[i].lower()) or keys[i] in keys[1:i]]
            cost = LEAD_DROPPED[min(ahead, 3)] + JOINED * (end - lead - 2) + (0 if named else TAIL_DROPPED * (len(tail) - len(free)))
            # A field that is free to go should go.
            cost += sum(1 for i in range(lead, end) if LABEL.search(fields[i].lower()) or len(keys[i]) <= 2 and i > 0)
            cost += 2 * (end == n and n >= 3 and kind(fields[-1]) == "version")
            if best is None or (cost, lead, -end) < best[:3]:
                best = (cost, lead, -end, named)
    _, lead, end, named = best
    return fields[lead], " - ".join(fields[lead + 1 : -end]), fields[-1] if named else None


def terms(stem: str) -> tuple[str, str, str | None]:
    """(artist, title, version); all empty for names that say nothing."""
    text, group = read(stem)
    fields = [f for f in fields_of(text) if not PLACE.fullmatch(f)]
    artist, title, field = roles(fields)
    if side := SIDE.match(title):
        title = title[side.end() :].strip()
    words, phrase = title.split(), None
    if len(words) > 2 and bare(words[-1]) in PHRASE_ENDS:
        title, phrase = " ".join(words[:-2]), " ".join(words[-2:])
    return ("", "", None) if bare(title) in GENERIC else (artist, title, group or field or phrase)


def folder_parts(folder: str) -> list[str]:
    """Artist, album and more of a folder's name; nothing where it has one field only."""
    parts = [f for f in fields_of(read(folder)[0]) if not PLACE.fullmatch(f) and not LABEL.search(f.lower())]
    return parts if len(parts) > 1 else []


def plausible(name: str) -> bool:
    return len(name.encode()) >= 2 and len(name) <= 60 and any(c.isalpha() for c in name) and bare(name) not in GENERIC


def fold(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return squeeze("".join(c if c.isalnum() else " " for c in plain))


def ladder(artist: str, title: str, version: str | None, folder: str, stem: str) -> list[str]:
    """Queries from the most to the least exact, each with three letters or digits or more and
    distinct without regard to case."""
    whole = read(stem)[0].replace("-", " ")
    folded = fold(title)
    album = next(filter(plausible, folder_parts(folder)[1:2]), None)
    known = {
        "exact": f"{artist} {title} {version or ''}", "work": f"{artist} {title}", "title": title, "whole": whole,
        "folded": f"{fold(artist)} {folded}" if folded != title.lower() else "", "album": f"{artist or title} {album}" if album else "",
    }
    asked = map(squeeze, known.values() if title else [whole])
    said: set[str] = set()
    return [q for q in asked if len(bare(q)) >= 3 and not (q.lower() in said or said.add(q.lower()))]


def search_terms(name: str, folder: str) -> tuple[str, str, str | None, list[str]]:
    """Artist, title, version and queries; an artist missing from the name may come from the folder."""
    artist, title, version = terms(name)
    if title and not artist:
        artist = next(filter(plausible, folder_parts(folder)[:1]), "")
    return artist, title, version, ladder(artist, title, version, folder, name)
