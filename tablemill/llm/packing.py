"""Packing documents into sequences of bounded length by order-preserving dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.bpe import codec, read_spec
from tablemill.llm.common import column_bytes, slices

#: What a cut costs, in tokens of padding: between documents, after a sentence, elsewhere.
CUT_COSTS = (0, 2, 8)
#: Stretches without a sentence end may be cut at every so many tokens.
STRETCH = 64


def padding(length: int, window: int) -> int:
    """Tokens that fill a sequence up: none at a power of two, else up to the window."""
    return 0 if length & (length - 1) == 0 else window - length


def boundaries(ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a block of documents may be cut, and the cost of each cut. ends: the documents'
    token ends; stops: token positions after which a sentence ends."""
    kind = np.zeros(int(ends[-1]) + 1, np.int8)
    kind[stops] = 1
    kind[ends] = kind[0] = 2
    cuts = np.flatnonzero(kind)
    gaps = np.diff(cuts)
    more = np.where(gaps > STRETCH, (gaps - 1) // STRETCH, 0)
    if more.any():
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        kind[np.repeat(cuts[:-1], more) + nth * STRETCH] = 3
        cuts = np.flatnonzero(kind)
    return cuts, np.array([0, CUT_COSTS[1], CUT_COSTS[0], CUT_COSTS[2]])[kind[cuts]]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> np.ndarray:
    """The cut positions (first 0, last the end) with the least padding plus cut costs.

    best[j] = cost[j] + min over i of best[i] + padding(at[j] - at[i]). Padding to the window
    is window - at[j] + at[i], so the minimum of best[i] + at[i] over the window is the front
    of a monotone queue; lengths that are powers of two have their one boundary looked up."""
    n = len(at)
    size, ends, begins = 1, [], []
    while size < window:  # a full window has no padding by either rule
        found = np.searchsorted(at, at - size)
        hit = np.flatnonzero((at >= size) & (at[found] == at - size))
        ends.append(hit)
        begins.append(found[hit])
        size *= 2
    order = np.argsort(np.concatenate(ends), kind="stable")
    ends, begins = np.concatenate(ends)[order], np.concatenate(begins)[order].tolist()
    upto = np.searchsorted(ends, np.arange(n), side="right").tolist()
    places, costs, first = at.tolist(), cost.tolist(), np.searchsorted(at, at - window).tolist()
    best, previous = [0] * n, [0] * n
    # The queue: indices from `head` on, and best + place of each, both rising.
    queue, values, head, seen = [0], [0], 0, upto[0]
    for j in range(1, n):
        oldest = first[j]
        while queue[head] < oldest:
            head += 1
        least, i, place = values[head] + window - places[j], queue[head], places[j]
        last = upto[j]
        while seen < last:
            k = begins[seen]
            if best[k] < least:
                least, i = best[k], k
            seen += 1
        best[j] = least = least + costs[j]
        previous[j] = i
        least += place
        while len(values) > head and values[-1] >= least:
            values.pop()
            queue.pop()
        values.append(least)
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(previous[out[-1]])
    return at[out[::-1]]


def pack_block(ends: np.ndarray, stops: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The pieces of one block of documents laid end to end: document index, start in it,
    length, sequence index, offset there, and the sequence's length."""
    cuts = best_cuts(*boundaries(ends, stops), window)
    edges = np.union1d(cuts, ends)
    first, last = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, first, side="right")
    sequence = np.searchsorted(cuts, first, side="right") - 1
    return {
        "doc": doc, "start": first - np.concatenate([[0], ends])[doc], "length": last - first,
        "sequence": sequence, "offset": first - cuts[sequence], "filled": np.diff(cuts)[sequence], "from": first,
    }


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, block_tokens: int = 1 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence: key, start, length, doc_tokens,
    sequence_id, offset, sequence_length, and piece (the ids as little-endian unsigned 32-bit).

    Each document is its token ids and `end_id`; a null text is empty and so is `end_id` alone.
    Documents keep the order in which they are stored; nothing is shuffled. A block is as many
    whole documents of a scan partition as hold `block_tokens`, and sequences stay inside a
    block, so memory is bounded by a block or the longest document. Sequence ids are distinct
    and rise in stored order within a partition; they are not contiguous. Repeated rows are
    packed each; empty tables give no rows; other columns are not carried."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    fields = ["start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length"]

    def emit(keys: pa.Array, ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, first: int) -> pa.RecordBatch:
        p = pack_block(ends, stops, window)
        offsets = np.append(p["from"], ends[-1]) * 4
        pieces = pa.Array.from_buffers(pa.binary(), len(p["from"]), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
        sizes = np.diff(ends, prepend=0)
        columns = [p["start"], p["length"], sizes[p["doc"]], first + p["sequence"], p["offset"], p["filled"]]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(p["doc"])), *(pa.array(c, pa.int64()) for c in columns), pieces], names=[key, *fields, "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(spec.value)
        sequence = TaskContext.get().partitionId() << 40
        # Documents not yet packed: parts of (keys, ids, token ends, places of sentence ends).
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            before = np.cumsum([0, *(len(h[1]) for h in held)])
            shifted = ([h[n] + b for h, b in zip(held, before)] for n in (2, 3))
            return pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), *map(np.concatenate, shifted)

        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets, ends_sentence = bpe.encode_bytes(*column_bytes(part.column("text")))
                ends = offsets[1:] + np.arange(1, part.num_rows + 1)
                ids = np.insert(flat, offsets[1:], end_id).astype("<u4")
                at = np.flatnonzero(ends_sentence)
                stops = at + 1 + np.searchsorted(offsets, at, side="right") - 1
                held.append((part.column("key"), ids, ends, stops))
                size += len(ids)
                if size < block_tokens:
                    continue
                keys, ids, ends, stops = joined()
                row = base = 0
                while (cut := int(np.searchsorted(ends, base + block_tokens))) < len(ends):
                    end = int(ends[cut])
                    a, b = np.searchsorted(stops, (base, end), side="right")
                    out = emit(keys.slice(row, cut + 1 - row), ids[base:end], ends[row : cut + 1] - base, stops[a:b] - base, sequence)
                    sequence = out.column("sequence_id")[-1].as_py() + 1
                    yield out
                    row, base = cut + 1, end
                held = [(keys.slice(row), ids[base:], ends[row:] - base, stops[np.searchsorted(stops, base, side="right") :] - base)] if row < len(ends) else []
                size = len(ids) - base
        if held:
            yield emit(*joined(), sequence)

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{f} long' for f in fields)}, piece binary")
