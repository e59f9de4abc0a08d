"""Exact removal of repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes of `length` bytes are sorted into buckets of equal strings. The first buckets are those
of equal q-grams. A round then sorts the suffixes of every open bucket by bucket identifiers of
later offsets: the identifier of 128 bytes names the pair of q-gram identifiers at a suffix and
64 bytes on, that of 200 bytes the pair of 128-byte identifiers at the suffix and 72 bytes on, so
every identifier is made once and used again at other offsets. A name is the same number in every
text, hence no round trip renames suffixes. Buckets that are alone, or alike as a whole, are
settled and leave; only the others enter the next round.

A row is not one suffix but a run of neighbours. A string's minimiser (the least hashed q-gram
inside it) gives its first bucket, and neighbouring suffixes with the same minimiser travel as
one row, in the next round as rows of BLOCK suffixes at a fixed distance from the minimiser, in
the last one singly. Of equal rows one goes on as the reference of the settled ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import RollingHash, column_bytes, content_id, free_name, join_groups, mix, slices
from tablemill.storage import scratch, stash

LENGTH, QGRAM, BLOCK = 200, 64, 16
#: Bytes that one step of a task holds as arrays; longer texts are cut into windows of so many.
STEP = 1 << 18
_PLACE = np.uint64((1 << 30) - 1)
_LATER = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "t binary, c long, u long, lo int, hi int, m int, ref boolean"
_NAMES = ["t", "c", "u", "lo", "hi", "m", "ref"]


class Identifiers:
    """Bucket identifiers of all suffixes of a byte array, by depth: that of a q-gram is its
    hash; that of a greater depth names two identifiers of a lesser one, at the suffix and at a
    later offset. Arrays of a depth are made once and serve every greater depth."""

    def __init__(self, data: np.ndarray, q: int, seed: int):
        hashed = RollingHash(data, seed)
        n = max(0, len(data) - q + 1)
        self.q, self.at = q, {q: mix((hashed.sums[q : q + n] - hashed.sums[:n]) * hashed.back[:n])}

    def half(self, depth: int) -> int:
        half = self.q
        while half * 2 < depth:
            half *= 2
        return half

    def all(self, depth: int) -> np.ndarray:
        if depth not in self.at:
            below = self.all(self.half(depth))
            gap = depth - self.half(depth)
            self.at[depth] = mix(below[: len(below) - gap] + below[gap:] * _LATER)
        return self.at[depth]

    def __call__(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The identifiers of `depth` bytes at the places `at` (of all() at those places)."""
        if depth in self.at:
            return self.at[depth][at]
        half = self.half(depth)
        return mix(self(at, half) + self(at + (depth - half), half) * _LATER)


def _shaped(ids: Identifiers, lo: np.ndarray, hi: np.ndarray, shape: np.ndarray, length: int) -> np.ndarray:
    """The identifier of all bytes of a run: of its first and last suffix, and of its shape."""
    return mix(ids(lo, length) + ids(hi, length) * _LATER + shape * np.uint64(0xD1B54A32D192ED03))


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, m, c, u): maximal runs lo..hi of suffixes with one minimiser at m, its
    q-gram's identifier and that of the whole run."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    width = length - q + 1
    grams = Identifiers(data, q, 31)
    first_gram = grams.all(q)
    least = first_gram & ~_PLACE
    least |= np.arange(len(least), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    room = np.zeros(len(data) + 1, np.int32)
    starts, ends = offsets[:-1], offsets[1:]
    fits = ends - starts >= length
    np.add.at(room, starts[fits], 1)
    np.add.at(room, ends[fits] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(room)[: len(least)] > 0)
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = (least[start] & _PLACE).astype(np.int64)
    del least, room
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    opening = np.zeros(len(data) + 1, bool)
    opening[starts] = True  # a text begins: its suffixes are no neighbours of those before
    new |= opening[start]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, m = start[first], start[last], place[first]
    shape = ((m - lo) << 20 | (hi - lo)).astype(np.uint64)
    u = _shaped(Identifiers(data, q, 32), lo, hi, shape, length)
    return np.searchsorted(offsets, lo, side="right") - 1, lo, hi, m, first_gram[m], u


def split_runs(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: np.ndarray, length: int, q: int, block: int) -> tuple[np.ndarray, ...]:
    """(parent, lo, hi, m, c, u): the runs cut into blocks at fixed distances before m. c
    identifies the bytes that all suffixes of a whole block share, u those of the block at hand."""
    low_k, high_k = (m - hi) // block, (m - lo) // block
    n = high_k - low_k + 1
    parent = np.repeat(np.arange(len(lo)), n)
    k = low_k[parent] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    top = m[parent] - k * block
    new_hi, new_lo = np.minimum(hi[parent], top), np.maximum(lo[parent], top - block + 1)
    buckets, wholes = Identifiers(data, q, 33), Identifiers(data, q, 34)
    buckets.all(buckets.half(length)), wholes.all(length)
    c = mix(buckets(top, length - block + 1) + k.astype(np.uint64) * _LATER)
    shape = (k << 20 | (new_hi - new_lo) << 10 | (top - new_hi)).astype(np.uint64)
    return parent, new_lo, new_hi, m[parent], c, _shaped(wholes, new_lo, new_hi, shape, length)


def _batch(t: pa.Array, c, u, lo, hi, m, ref) -> pa.RecordBatch:
    columns = [pa.array(c.view(np.int64)), pa.array(u.view(np.int64)), *(pa.array(x, pa.int32()) for x in (lo, hi, m)), pa.array(ref, pa.bool_())]
    return pa.RecordBatch.from_arrays([t.cast(pa.binary()), *columns], names=_NAMES)


def _packed(texts: DataFrame) -> DataFrame:
    """(t, packed): texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                view = memoryview(data)
                packed = [squeeze.compress(view[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(packed, pa.binary())], names=["t", "packed"])

    return texts.mapInArrow(run, "t binary, packed binary")


def _first_rows(texts: DataFrame, length: int, q: int) -> DataFrame:
    """The runs of every text, in their first buckets. A text over STEP bytes is cut into windows
    whose suffixes are disjoint; a run may be cut there, which a later round makes good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                data, offsets = column_bytes(part.column("text"))
                for a in range(0, len(data), 2 * STEP):
                    b = min(len(data), a + 2 * STEP)
                    first, last = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b, side="left")
                    inside = np.clip(offsets[first : last + 1], a, b + length - 1) - a
                    at, lo, hi, m, c, u = stretches(data[a : b + length - 1], inside, length, q)
                    at += first
                    base = offsets[at] - a
                    yield _batch(part.column("t").take(pa.array(at)), c, u, lo - base, hi - base, m - base, np.zeros(len(lo), bool))

    return texts.mapInArrow(run, _ROWS)


def _refined(open_rows: DataFrame, packed: DataFrame, length: int, q: int, block: int) -> DataFrame:
    """The open rows cut into blocks, in buckets by the identifiers at later offsets."""
    per_text = open_rows.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "m", "ref"))).alias("runs"))
    joined = packed.join(per_text.hint("shuffle_hash"), "t").select("t", "packed", "runs")

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int, list[np.ndarray]]]:
        """(row, bytes, their place in the text, runs): windows of the texts that hold runs."""
        unpack = zstandard.ZstdDecompressor()
        for i in range(batch.num_rows):
            data = np.frombuffer(unpack.decompress(batch.column("packed")[i].as_py()), np.uint8)
            runs = batch.column("runs")[i].values
            fields = [runs.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "hi", "m", "ref")]
            cuts = np.flatnonzero(np.diff(fields[0] // STEP)) + 1
            for own in zip(*(np.split(f, cuts) for f in fields)):
                a, b = int(own[0].min()), int(own[1].max()) + length
                yield i, data[a:b], a, list(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, np.ndarray, int, list[np.ndarray]]] = []
            size = 0
            for piece in pieces(batch):
                held.append(piece)
                size += len(piece[1])
                if size >= STEP:
                    yield emit(batch, held)
                    held, size = [], 0
            if held:
                yield emit(batch, held)

    def emit(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        sizes = np.array([len(d) for _, d, _, _ in held])
        shift = np.cumsum(sizes) - sizes - np.array([a for _, _, a, _ in held])
        each = [len(own[0]) for *_, own in held]
        row, shift = np.repeat([i for i, *_ in held], each), np.repeat(shift, each)
        lo, hi, m, ref = (np.concatenate(f) for f in zip(*(own for *_, own in held)))
        parent, lo, hi, m, c, u = split_runs(np.concatenate([d for _, d, _, _ in held]), lo + shift, hi + shift, m + shift, length, q, block)
        shift = shift[parent]
        return _batch(batch.column("t").take(pa.array(row[parent])), c, u, lo - shift, hi - shift, m - shift, ref[parent].astype(bool))

    return joined.mapInArrow(run, _ROWS)


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(near, settled, open): rows in shared buckets; those that equal another one as a whole;
    and what needs refinement: one row of each kind in buckets of several kinds, a reference if
    its suffixes are known to repeat."""
    total = rows.count()
    shared = stash(rows.groupBy("c").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-shared")
    near = stash(join_groups(rows, shared, ["c"], total), f"{name}-near")
    place = F.struct("t", "lo", "hi", "m", "ref")
    kinds = near.groupBy("c", "u").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    kinds = stash(kinds.select("c", "u", "n", "one.*"), f"{name}-kinds")
    settled = join_groups(near.where("not ref"), kinds.where("n > 1").select("c", "u", "n"), ["c", "u"], total).select("t", "lo", "hi")
    several = kinds.groupBy("c").agg(F.count("*").alias("n"), F.min(F.col("ref") | (F.col("n") > 1)).alias("known"))
    several = stash(several.where("n > 1 and not known").select("c", "n"), f"{name}-several")
    rest = kinds.select("c", "t", "lo", "hi", "m", (F.col("ref") | (F.col("n") > 1)).alias("ref"))
    return near, settled, join_groups(rest, several, ["c"], total).select("t", "lo", "hi", "m", "ref")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(content_id(F.col(f"`{text}`")).alias("t"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def joined_ranges(found: DataFrame, least: int = 1) -> DataFrame:
    """(t, spans) of (t, runs): the (start, end) ranges of each text with overlapping and touching
    ones joined, in order, of `least` bytes or more; texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            row = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy())
            start, end = (f.to_numpy().astype(np.int64) for f in runs.flatten().flatten())
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            far = np.maximum.accumulate(end + (row << 32)) - (row << 32)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] > far[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row))[: len(first)] - 1
            row, start, end = row[first], start[first], far[last]
            long = end - start >= least
            row, start, end = row[long], start[long], end[long]
            some = np.unique(row)
            struct = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row, some), len(row)), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column("t").take(pa.array(some)), spans], names=["t", "spans"])

    return found.mapInArrow(run, "t binary, spans array<struct<start: long, end: long>>")


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, q: int = QGRAM, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((t, spans), (t, packed)) for the texts of `docs` with any byte covered by a string of
    `length` bytes that also starts anywhere else, in the same or another text.

    t is the text's 128-bit content id, spans are (start, end) byte ranges in order, packed are
    the compressed texts that hold any shared bucket, each once. A null text is empty; texts
    shorter than `length` are never covered; each repeated row is another text, so a row that
    stands twice is covered whole. Equality is that of two 64-bit identifiers made with
    different seeds. Rows of a bucket are counted before the shuffle, and the few heavy buckets
    are joined by broadcast, so a string in a third of all texts makes no large task; a task
    holds arrays of STEP bytes and one text."""
    texts = _texts(docs, text)
    rows = stash(_first_rows(texts, length, q), "suffix-runs")
    near, settled, mixed = _settle(rows, "suffix-0")
    found, mixed = [settled], stash(mixed, "suffix-open-0")
    wanted = near.select("t").distinct()
    packed = stash(_packed(texts).dropDuplicates(["t"]).join(wanted.hint("shuffle_hash"), "t", "left_semi"), "suffix-texts")
    for level, size in enumerate((block, 1), 1):
        rows = stash(_refined(mixed, packed, length, q, size), f"suffix-rows-{level}")
        _, settled, mixed = _settle(rows, f"suffix-{level}")
        found.append(settled)
        if size > 1:
            mixed = stash(mixed, f"suffix-open-{level}")
    covered = found[0].union(found[1]).union(found[2]).groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))

    return joined_ranges(covered.select("t", F.transform("runs", lambda r: F.struct(r["lo"], r["hi"] + length)).alias("runs"))), packed


def _counted(docs: DataFrame, columns: dict[str, Column], text: str, keep) -> tuple[DataFrame, int, DataFrame]:
    """(narrow, rows, copies): the stored columns with the content id t, and (t, n, n_bytes) of
    the contents that stand twice or more."""
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = keep(docs.select(content_id(F.col(f"`{text}`")).alias("t"), F.octet_length(full).cast("long").alias("n_bytes"), *(c.alias(n) for n, c in columns.items())), "suffix-docs")
    return narrow, narrow.count(), narrow.groupBy("t").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes")).where("n > 1")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs`, after `repeats`.

    Repeated rows, null keys and several texts under one key are each judged by their content.
    Other columns are not carried, so their names cannot clash."""
    with scratch(docs.sparkSession) as keep:
        whole = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
        narrow, rows, copies = _counted(docs, {"given": F.col(f"`{key}`"), "whole": whole}, text, keep)
        # A text that stands twice is covered whole, so only texts that stand once need their spans.
        gone = copies.where(F.col("n_bytes") >= length)
        spans, packed = repeats(docs, text, length, **options)
        joined = packed.join(spans.hint("shuffle_hash"), "t").select("t", "packed", "spans")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor()
            for batch in batches:
                kept, removed, counts = [], [], []
                for i in range(batch.num_rows):
                    data = unpack.decompress(batch.column("packed")[i].as_py())
                    edges = batch.column("spans")[i].values
                    starts, ends = edges.field("start").to_pylist(), edges.field("end").to_pylist()
                    kept.append(b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)])))
                    removed.append(sum(ends) - sum(starts))
                    counts.append(len(starts))
                yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], names=["t", "removed", "spans", "kept"])

        cut = joined.mapInArrow(run, "t binary, removed long, spans long, kept binary").select("t", "removed", "spans", F.sha2("kept", 256).alias("sha"))
        of_copies = gone.select("t", F.col("n_bytes").alias("removed"), F.lit(1).cast("long").alias("spans"), F.sha2(F.lit(""), 256).alias("sha"), "n")
        single = cut.join(gone.select("t"), "t", "left_anti").withColumn("n", F.lit(1).cast("long"))
        found = keep(of_copies.unionByName(single), "suffix-cut")
    zero = F.lit(0).cast("long")
    return join_groups(narrow, found, ["t"], rows, "left").select(
        F.col("given").alias(key), "n_bytes", F.coalesce("removed", zero).alias("n_removed"),
        F.coalesce("spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """The rows and columns of `docs` without the repeated bytes in the text. A character stays
    whole if any of its bytes stays, so the text remains valid; null texts stay null. `docs` is
    read several times, so it should be a stored table."""
    with scratch(docs.sparkSession) as keep:
        _, rows, copies = _counted(docs, {}, text, stash)
        gone = copies.where(F.col("n_bytes") >= length)
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        single = repeats(docs, text, length, **options)[0].join(gone.select("t"), "t", "left_anti").withColumn("n", F.lit(1).cast("long"))
        found = keep(gone.select("t", whole.alias("spans"), "n").unionByName(single), "suffix-spans")
    at, ranges = free_name(docs, "t"), free_name(docs, "spans")
    found = found.select(F.col("t").alias(at), F.col("spans").alias(ranges), "n")

    @F.pandas_udf("string")
    def strip(texts, spans):
        out = []
        for value, own in zip(texts, spans):
            if own is None or value is None:
                out.append(value)
                continue
            data = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
            stay = np.ones(len(data), bool)
            for r in own:
                stay[r["start"] : r["end"]] = False
            first = np.flatnonzero((data & 0xC0) != 0x80)
            whole = np.logical_or.reduceat(stay, first)
            out.append(data[np.repeat(whole, np.diff(np.append(first, len(data))))].tobytes().decode())
        return texts.__class__(out, dtype=object)

    joined = join_groups(docs.withColumn(at, content_id(F.col(f"`{text}`"))), found.hint("shuffle_hash"), [at], rows, "left")
    return joined.select(*(strip(F.col(f"`{c}`"), F.col(f"`{ranges}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
