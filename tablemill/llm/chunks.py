"""Substring deduplication by content-defined chunks of a gear rolling hash.

A gear hash shifts left by one and adds a random number per byte, so it depends on the last 32
bytes only. A chunk ends where the hash's top bits are zero; an insertion moves the ends near it
and no others. Equal chunks are found by digest, and of each the first one stays. The others are
seeds: runs of them grow byte by byte as long as the text around the first place is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import RollingHash, column_bytes, content_id, join_groups, slices
from tablemill.llm.suffix import _packed, joined_ranges
from tablemill.storage import scratch, stash

LEAST, BITS, MOST = 24, 5, 512
#: Repeats of fewer bytes, after their extension, stay: a stock phrase is no repeated passage.
RUN = 64
#: Bytes beside a run that are compared in the first round, and at most in a later one.
REACH, FAR = 256, 1 << 16
GEAR = np.random.default_rng(51).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
#: The hash has 32 bits, so it depends on so many bytes.
WINDOW = 32


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2 ** 32, by doubling the window it covers."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts laid end to end. The top bits that decide come from the last
    WINDOW bytes, of which a text's start may lack some: its own bytes alone are hashed there."""
    h = gear_hash(data)
    sizes = np.diff(offsets)
    # Near a start the window still holds the text before, whose part there is h[start - 1]
    # shifted by the distance.
    near = np.minimum(sizes, WINDOW - 1)
    row = np.repeat(np.arange(len(sizes)), near)
    step = np.arange(near.sum()) - np.repeat(np.cumsum(near) - near, near)
    start = offsets[row]
    h[start + step] -= np.where(start > 0, h[start - 1], np.uint32(0)) << (step + 1).astype(np.uint32)
    low = np.flatnonzero(h >> np.uint32(WINDOW - BITS) == 0) + 1
    out: list[int] = []
    cuts = np.searchsorted(low, offsets, side="right").tolist()
    places, edges = low.tolist(), offsets.tolist()
    for row in range(len(edges) - 1):
        last, end = edges[row], edges[row + 1]
        for place in places[cuts[row] : cuts[row + 1]]:
            if place - last < LEAST:
                continue
            while place - last > MOST:
                last += MOST
                out.append(last)
            if place - last >= LEAST:
                out.append(place)
                last = place
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
    return np.array(out, np.int64)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, text): the key, and a 128-bit id of key and text together."""
    own = F.col(f"`{key}`")
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(own.alias("k"), content_id(F.concat(own.isNull().cast("string"), F.coalesce(own.cast("string"), F.lit(""))), full).alias("t"), full.alias("text"))


def chunk(texts: DataFrame) -> DataFrame:
    """(k, t, start, size, d1, d2): the chunks of every (k, t, text) with a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                ends = chunk_ends(data, offsets)
                row = np.searchsorted(offsets, ends, side="left") - 1
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                digests = [RollingHash(data, seed)(starts, ends).view(np.int64) for seed in (52, 53)]
                index = pa.array(row)
                numbers = [pa.array(x, pa.int32()) for x in (starts - offsets[row], ends - starts)]
                yield pa.RecordBatch.from_arrays([part.column("k").take(index), part.column("t").take(index), *numbers, *map(pa.array, digests)], names=["k", "t", "start", "size", "d1", "d2"])

    return texts.mapInArrow(run, f"k {texts.schema['k'].dataType.simpleString()}, t binary, start int, size int, d1 long, d2 long")


def _runs(later: DataFrame) -> DataFrame:
    """(t, lo, hi, lt, ls, rt, re): the maximal runs lo..hi of neighbouring repeated chunks; the
    first place of the chunk at the run's start begins at ls of the text lt, that of the chunk
    at its end ends at re of rt."""
    own = F.struct("start", "size", F.col("first.t").alias("t0"), F.col("first.start").alias("start0"))
    per_text = later.groupBy("t").agg(F.sort_array(F.collect_set(own)).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("chunks")
            row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
            start, size, t0, start0 = found.flatten().flatten()
            lo, size, first = (x.to_numpy().astype(np.int64) for x in (start, size, start0))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (lo[1:] != lo[:-1] + size[:-1])
            opening = np.flatnonzero(new)
            closing = np.append(opening[1:], len(row))[: len(opening)] - 1
            ints = [pa.array(x, pa.int32()) for x in (lo[opening], (lo + size)[closing], first[opening], (first + size)[closing])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("t").take(pa.array(row[opening])), *ints[:2], t0.take(pa.array(opening)), ints[2], t0.take(pa.array(closing)), ints[3]],
                names=["t", "lo", "hi", "lt", "ls", "rt", "re"],
            )

    return per_text.mapInArrow(run, "t binary, lo int, hi int, lt binary, ls int, rt binary, re int")


def _bytes_at(asked: DataFrame, packed: DataFrame, reach: int) -> DataFrame:
    """`asked` (t0, right, p0, n) with `near`: up to `reach` bytes right or left of p0 in t0."""
    places = asked.groupBy("t0").agg(F.collect_list(F.struct("right", "p0", "n")).alias("places"))
    joined = packed.withColumnRenamed("t", "t0").join(places.hint("shuffle_hash"), "t0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                data = unpack.decompress(batch.column("packed")[i].as_py())
                right, at, n = batch.column("places")[i].values.flatten()
                near = [data[p : p + reach] if r else data[max(0, p - reach) : p] for r, p in zip(right.to_pylist(), at.to_pylist())]
                t0 = pa.repeat(batch.column("t0")[i], len(near))
                yield pa.RecordBatch.from_arrays([t0, right, at, n, pa.array(near, pa.binary())], names=["t0", "right", "p0", "n", "near"])

    return joined.select("t0", "packed", "places").mapInArrow(run, "t0 binary, right boolean, p0 int, n long, near binary")


def _compared(edges: DataFrame, packed: DataFrame, reach: int) -> DataFrame:
    """Edges, whose `near` is compared with their own text from where they stand: `gain` grows by
    what is equal, and an edge stays `open` if all `reach` bytes are."""
    each = edges.groupBy("t").agg(F.collect_list(F.struct("right", "at", "t0", "at0", "gain", "near")).alias("edges"))
    joined = packed.join(each.hint("shuffle_hash"), "t").select("t", "packed", "edges")

    def equal(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return int(other[0]) if len(other) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(unpack.decompress(batch.column("packed")[i].as_py()), np.uint8)
                right, at, t0, at0, gain, near = batch.column("edges")[i].values.flatten()
                more = []
                for r, p, g, other in zip(right.to_pylist(), at.to_pylist(), gain.to_pylist(), near):
                    there = np.frombuffer(other.as_buffer(), np.uint8)
                    p = p + g if r else p - g
                    more.append(equal(data[p : p + reach], there) if r else equal(data[max(0, p - reach) : p][::-1], there[::-1]))
                more = np.array(more, np.int64)
                grown = gain.to_numpy() + more
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column("t")[i], len(more)), right, at, t0, at0, pa.array(grown, pa.int32()), pa.array(more == reach)],
                    names=["t", "right", "at", "t0", "at0", "gain", "open"],
                )

    return joined.mapInArrow(run, "t binary, right boolean, at int, t0 binary, at0 int, gain int, open boolean")


def extended(runs: DataFrame, packed: DataFrame) -> DataFrame:
    """(t, start, end): what is equal beside the runs' ends, byte by byte, in the run's text and at
    the first place of its outer chunk. Edges travel with REACH bytes of the first place; the few
    that are equal so far go on from there with more, at most FAR, until none is open."""
    edges = runs.where("lo > 0 and ls > 0").select("t", F.lit(False).alias("right"), F.col("lo").alias("at"), F.col("lt").alias("t0"), F.col("ls").alias("at0"))
    edges = edges.unionByName(runs.select("t", F.lit(True).alias("right"), F.col("hi").alias("at"), F.col("rt").alias("t0"), F.col("re").alias("at0")))
    edges, reach, done = edges.withColumn("gain", F.lit(0)), REACH, []
    while True:
        edges = stash(edges.withColumn("p0", F.expr("if(right, at0 + gain, at0 - gain)")), "chunk-edges")
        total = edges.count()
        if not total and done:
            break
        asked = edges.groupBy("t0", "right", "p0").agg(F.count("*").alias("n"))
        near = stash(_bytes_at(asked, packed, reach).where("octet_length(near) > 0"), "chunk-near")
        grown = stash(_compared(join_groups(edges, near, ["t0", "right", "p0"], total), packed, reach), "chunk-grown")
        done.append(grown.where("not open and gain > 0"))
        # What was equal to its last byte may have met an end: it is done with what it has.
        edges = grown.where("open").select("t", "right", "at", "t0", "at0", "gain")
        done.append(edges)
        reach = min(reach * 16, FAR)
    ends = [d.selectExpr("t", "if(right, at, at - gain) as start", "if(right, at + gain, at) as end") for d in done]
    out = ends[0]
    for other in ends[1:]:
        out = out.union(other)
    return out


def repeated_runs(texts: DataFrame, least_run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """((t, spans), (t, packed)): the (start, end) byte ranges of each (k, t, text) that repeat
    earlier text, and the compressed texts that hold any repeated chunk, each once.

    The first of equal chunks, by key (null first), content and place, stays. Runs of later ones
    are extended to both sides as far as the first place's text is equal; `least_run` is asked of
    what comes out. Equal chunks count before the shuffle, and the few heavy ones are joined by
    broadcast, so a chunk in a third of all texts makes no large task."""
    chunks = stash(chunk(texts), "chunks")
    total = chunks.count()
    # A first, narrow count of one half of the digest leaves the few chunks worth the rest.
    twice = stash(chunks.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1"), "chunks-twice")
    near = stash(join_groups(chunks, twice, ["d1"], total), "chunks-near")
    place = F.struct("k", "t", "start")
    firsts = stash(near.groupBy("d1", "d2", "size").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "chunks-first")
    later = join_groups(near, firsts, ["d1", "d2", "size"], total).where(place != F.col("first"))
    runs = stash(_runs(later), "chunk-runs")
    packed = stash(_packed(texts).dropDuplicates(["t"]).join(near.select("t").distinct().hint("shuffle_hash"), "t", "left_semi"), "chunk-texts")
    spans = runs.selectExpr("t", "lo as start", "hi as end").union(extended(runs, packed))
    spans = spans.groupBy("t").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    return joined_ranges(spans, least_run), packed


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least_run: int = RUN) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs`.

    Removed are repeats of `least_run` bytes or more, grown from chunks that stand earlier in the
    table (by key, then place) or in the same text. A null text is empty; texts shorter than a
    run are kept. Rows that repeat a key and text are one text and get equal rows; null keys are
    a key that comes first; other columns are not carried."""
    texts = _texts(docs, key, text)
    with scratch(docs.sparkSession) as keep:
        light = texts.select(F.col("k").alias("given"), "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
        light = keep(light, "chunk-docs")
        spans, packed = repeated_runs(texts, least_run)
        cut = packed.join(stash(spans, "chunk-spans").hint("shuffle_hash"), "t").select("t", "packed", "spans")

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

        done = cut.mapInArrow(run, "t binary, removed long, spans long, kept binary").select("t", "removed", "spans", F.sha2("kept", 256).alias("sha"))
        sizes = light.groupBy("t").agg(F.count("*").alias("n"))
        done = keep(done.join(sizes, "t"), "chunk-cut")
        zero = F.lit(0).cast("long")
        return join_groups(light, done, ["t"], light.count(), "left").select(
            F.col("given").alias(key), "n_bytes", F.coalesce("removed", zero).alias("n_removed"),
            F.coalesce("spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
        )
