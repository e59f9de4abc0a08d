"""Alignment of two tokenizers' tokens over the same bytes, scored by corpus-wide counts.

A task tokenizes texts with both, lays the tokens' ends on one line of bytes, and reads off it the
groups (bytes where both end) and the links (overlapping tokens). Links are kept by blocks of documents
and stripes of B ids: each block's distinct pairs, how often they occur, and for every link its document.
Counting partitions the pairs by B id and adds them into dense matrices of a few B ids by all
A ids; row maxima give each B id's best count. Scoring brings the counts of a stripe together with the
links of that stripe. A stripe with many links is dealt over several tasks, each with all of
the stripe's counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm.bpe import byte_letters, read_spec
from tablemill.llm.common import slices
from tablemill.storage import scratch, stash

# Fixed value: the words of the byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stripes of B ids (by remainder), and B ids of a stripe that share one dense matrix.
STRIPES, MATRIX = 16, 64
#: Links of a block of documents, at most so many documents; links of a scoring task.
BLOCK, BLOCK_DOCS, TASK = 1 << 20, 1 << 16, 1 << 23
#: A run of white space from which the word pattern is left to the library, and the first letter
#: whose class the two libraries' Unicode versions may not agree on.
LONG_SPACE, YOUNG = re.compile(r"\s{1000}"), "԰"
_encoders: dict[str, "Encoders"] = {}


class Encoders:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, spec: str, model: bytes):
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        letter = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in json.loads(spec)["added_tokens"]}
        vocab = json.loads(spec)["model"]["vocab"]
        ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.size_a = max(vocab.values()) + 1
        self.bytes_a = np.zeros(self.size_a, np.int64)
        for token, i in ranks.items():
            self.bytes_a[i] = len(token)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spelled_b = [self.spelling(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = np.array([len(x) for x in self.spelled_b], np.int64)
        most = max(self.size_a, len(self.spelled_b))
        digits = [str(i).encode() for i in range(most)]
        self.width = np.array([len(d) for d in digits])
        self.digits = np.zeros((most, int(self.width.max())), np.uint8)
        for i, d in enumerate(digits):
            self.digits[i, : len(d)] = list(d)

    @staticmethod
    def spelling(piece: str) -> bytes:
        found = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    def a(self, text: str) -> np.ndarray:
        if max(text) < YOUNG and not LONG_SPACE.search(text):
            return np.array(self.fast.encode_ordinary(text), np.int64)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def b(self, text: str) -> np.ndarray | None:
        """The ids, or None where they spell other bytes than space + text."""
        ids = self.pieces.encode(text)
        return np.array(ids, np.int64) if b"".join(map(self.spelled_b.__getitem__, ids)) == b" " + text.encode() else None

    def groups(self, ids: np.ndarray, last: np.ndarray, side: np.ndarray, row: np.ndarray, rows: int) -> list[str]:
        """Digests of the written groups: tokens in order, whether each is the last of its side of a
        group, its side, and its row (in order)."""
        wide = self.width[ids]
        ends = np.cumsum(wide + 1)
        at = ends - wide - 1
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        for i in range(self.digits.shape[1]):
            there = wide > i
            out[at[there] + i] = self.digits[ids[there], i]
        out[ends - 1] = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(","))
        raw, cut = out.tobytes(), np.concatenate([[0], ends])[np.searchsorted(row, np.arange(rows + 1))].tolist()
        return [hashlib.sha256(raw[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cut, cut[1:])]


def encoders(spec: str, model: bytes) -> Encoders:
    """The worker's tokenizers for these files, kept between tasks."""
    key = hashlib.sha256(spec.encode() + model).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoders(spec, model)
    return _encoders[key]


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def linked(texts: list[str | None], enc: Encoders) -> tuple[list[list], np.ndarray, np.ndarray, np.ndarray]:
    """For each text (n_a, n_b, n_groups, n_links, digest) as columns, and for each link its row, A id and B id."""
    ids_a, ids_b, row_a, row_b = [], [], [], []
    for i, text in enumerate(texts):
        if text and (b := enc.b(text)) is not None:
            a = enc.a(" " + text)
            ids_a.append(a)
            ids_b.append(b)
            row_a.append(np.full(len(a), i))
            row_b.append(np.full(len(b), i))
    none = [np.zeros(0, np.int64)]
    a, b, ra, rb = (np.concatenate(x or none) for x in (ids_a, ids_b, row_a, row_b))
    rows = len(texts)
    end_a, end_b = np.cumsum(enc.bytes_a[a]), np.cumsum(enc.bytes_b[b])
    total = int(end_a[-1]) if len(end_a) else 0
    mark_a, mark_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    mark_a[end_a], mark_b[end_b] = True, True
    union = np.flatnonzero(mark_a | mark_b)
    in_a, in_b = mark_a[union], mark_b[union]
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    row = ra[at_a]
    # Tokens by group: those of A, then those of B.
    last_a, last_b = mark_b[end_a], mark_a[end_b]
    group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
    order = np.argsort(group, kind="stable")
    side = group[order] % 2
    digest = enc.groups(np.concatenate([a, b])[order], np.concatenate([last_a, last_b])[order], side, np.concatenate([ra, rb])[order], rows)
    counts = [np.bincount(x, minlength=rows) for x in (ra, rb, ra[last_a], row)]
    return [*counts, digest], row, a[at_a], b[at_b]


DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
LINKS = [("base", pa.int64()), ("stripe", pa.int32()), ("links", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())]


def blocks(uid: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
    """The rows of LINKS for the links of a block of documents; the A id is in a pair's lower 16 bits."""
    full = (b % STRIPES) << 48 | (b // STRIPES) << 16 | a
    order = np.argsort(full, kind="stable")
    full, docs = full[order], (uid - uid[0])[order].astype(np.uint16)
    first = np.flatnonzero(np.diff(full, prepend=-1))
    counts = np.diff(np.append(first, len(full)))
    pairs = full[first]
    cut = np.searchsorted(pairs, np.arange(STRIPES + 1) << 48)
    ends = np.append(first, len(full))
    for stripe, (x, y) in enumerate(zip(cut, cut[1:])):
        if y > x:
            own = (pairs[x:y] & 0xFFFFFFFF).astype(np.uint32)
            yield int(uid[0]), stripe, int(ends[y] - ends[x]), pack(own), pack(counts[x:y].astype(np.uint32)), pack(docs[ends[x] : ends[y]])


def tokenized(docs: DataFrame, spec: str, model: bytes, key: str, text: str) -> DataFrame:
    """One row for every document (uid, key and what DOC says), and the rows of LINKS."""
    held = docs.sparkSession.sparkContext.broadcast((spec, model))
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(*held.value)
        uid = TaskContext.get().partitionId() << 40
        waiting: list[tuple[np.ndarray, ...]] = []
        kind = None

        def batch_of(n: int, found: dict) -> pa.RecordBatch:
            fields = [("uid", pa.int64()), ("key", kind), *DOC, *LINKS]
            return pa.RecordBatch.from_arrays([pa.array(found[c], t) if c in found else pa.nulls(n, t) for c, t in fields], names=[c for c, _ in fields])

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                rows = list(blocks(*(np.concatenate(x) for x in zip(*waiting))))
                waiting.clear()
                yield batch_of(len(rows), dict(zip([c for c, _ in LINKS], zip(*rows))))

        for batch in batches:
            for part in slices(batch, "text"):
                kind = part.column("key").type
                texts = part.column("text").to_pylist()
                counted, row, a, b = linked(texts, enc)
                yield batch_of(len(texts), {"uid": np.arange(uid, uid + len(texts)), "key": part.column("key"), **dict(zip([c for c, _ in DOC], counted))})
                for start in range(0, len(row), BLOCK):
                    own = slice(start, start + BLOCK)
                    waiting.append((uid + row[own], a[own], b[own]))
                    if sum(len(x[0]) for x in waiting) >= BLOCK:
                        yield from flush()
                uid += len(texts)
                if waiting and uid - waiting[0][0][0] > BLOCK_DOCS // 2:
                    yield from flush()
        yield from flush()

    name = given.schema["key"].dataType.simpleString()
    schema = f"uid long, key {name}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, base long, stripe int, links long, pairs binary, counts binary, docs binary"
    return given.mapInArrow(run, schema)


def pair_counts(links: DataFrame, size_a: int, parts: int) -> DataFrame:
    """(stripe, part, pairs, counts, best): the corpus-wide count of every pair of a dense matrix's B
    ids, and whether it is its B id's highest."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stripe, raw, times in zip(*(batch.column(c).to_pylist() for c in ("stripe", "pairs", "counts"))):
                pairs, counts = unpack(raw, np.uint32), unpack(times, np.uint32)
                part = pairs >> 16 + MATRIX.bit_length() - 1
                cut = np.append(np.flatnonzero(np.diff(part, prepend=np.uint32(0xFFFFFFFF))), len(part)).tolist()
                out += [(stripe, int(part[x]), pairs[x:y].tobytes(), counts[x:y].tobytes()) for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["stripe", "part", "pairs", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = np.zeros((MATRIX, size_a), np.int64), None

        def settled() -> Iterator[pa.RecordBatch]:
            if now is not None:
                best = matrix.max(axis=1)
                b, a = np.nonzero(matrix)
                counts = matrix[b, a]
                pairs = ((now[1] * MATRIX + b) << 16 | a).astype(np.uint32)
                row = [[now[0]], [now[1]], [pack(pairs)], [pack(counts)], [pack(counts == best[b])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["stripe", "part", "pairs", "counts", "best"])
                matrix.fill(0)

        for batch in batches:
            for stripe, part, raw, times in zip(*(batch.column(c).to_pylist() for c in ("stripe", "part", "pairs", "counts"))):
                if now != (stripe, part):
                    yield from settled()
                    now = (stripe, part)
                pairs = np.frombuffer(raw, np.uint32)
                np.add.at(matrix, ((pairs >> 16) % MATRIX, pairs & 0xFFFF), np.frombuffer(times, np.uint32))
        yield from settled()

    dealt = links.select("stripe", "pairs", "counts").mapInArrow(deal, "stripe int, part int, pairs binary, counts binary")
    return dealt.repartition(parts, "stripe", "part").sortWithinPartitions("stripe", "part").mapInArrow(add, "stripe int, part int, pairs binary, counts binary, best binary")


def scores(links: DataFrame, counted: DataFrame, tasks: dict[int, int]) -> DataFrame:
    """(uid, best, total) for every document and stripe: links that hold their B id's highest count, and the sum of counts."""
    dealt = F.create_map(*(F.lit(x) for stripe, n in tasks.items() for x in (stripe, n)), F.lit(-1), F.lit(1))
    share = F.coalesce(dealt[F.col("stripe")], F.lit(1))
    none = F.lit(None)
    given = counted.withColumn("share", F.explode(F.sequence(F.lit(0), share - 1))).select(
        "stripe", "share", F.lit(0).alias("kind"), "part", "pairs", "counts", "best", none.cast("long").alias("base"), none.cast("binary").alias("docs")
    )
    asked = links.withColumn("share", F.pmod(F.xxhash64("base", F.crc32("pairs")), share).cast("int")).select(
        "stripe", "share", F.lit(1).alias("kind"), F.lit(0).alias("part"), "pairs", "counts", none.cast("binary").alias("best"), "base", "docs"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, known = None, [], None
        for whole in batches:
            for start in range(0, whole.num_rows, 16):
                batch = whole.slice(start, 16)
                out = []
                for stripe, share, kind, raw, times, best, base, docs in zip(*(batch.column(c).to_pylist() for c in ("stripe", "share", "kind", "pairs", "counts", "best", "base", "docs"))):
                    if now != (stripe, share):
                        now, waiting, known = (stripe, share), [], None
                    if kind == 0:
                        waiting.append((unpack(raw, np.uint32), unpack(times, np.int64), unpack(best, bool)))
                        continue
                    if known is None:
                        known, waiting = [np.concatenate(x) for x in zip(*waiting)], []
                    at = np.searchsorted(known[0], unpack(raw, np.uint32))
                    n, docs = unpack(times, np.uint32), unpack(docs, np.uint16)
                    rows = int(docs.max()) + 1
                    total, first = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                    np.add.at(total, docs, np.repeat(known[1][at], n))
                    np.add.at(first, docs, np.repeat(known[2][at], n))
                    there = np.flatnonzero(total)
                    out.append((base + there, first[there], total[there]))
                columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "best", "total"])

    n = max(1, sum(tasks.values()))
    moved = given.unionByName(asked).repartition(n, "stripe", "share").sortWithinPartitions("stripe", "share", "kind", "part")
    return moved.mapInArrow(run, "uid long, best long, total long")


def align(docs: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`, by
    the vocabulary files of tokenizers A (`vocabulary`, byte-level BPE over space + text) and B (`model`, pieces;
    it adds the space itself), both read on the driver and broadcast: fixed files of a few MB. Strings of special tokens
    in a text are plain text.

    A null or empty text, and one whose B tokens spell other bytes than space + text, has no tokens: zeros and an empty
    digest. Repeated rows count each, in the corpus-wide counts too; all pairs that tie as a B id's
    highest are its best. Texts of any length are read whole; empty tables give no rows; other columns of any name
    are not carried."""
    spark = docs.sparkSession
    spec = read_spec(vocabulary)
    with open(model, "rb") as f:
        pieces = f.read()
    size_a = max(json.loads(spec)["model"]["vocab"].values()) + 1
    with scratch(spark) as keep:
        both = stash(tokenized(docs, spec, pieces, key, text), "alignment-tokens")
        links = both.where(F.col("stripe").isNotNull())
        sizes = dict(links.groupBy("stripe").agg(F.sum("links")).toArrow().to_pandas().itertuples(index=False, name=None))  # a row a stripe
        counted = stash(pair_counts(links, size_a, max(STRIPES, -(-sum(sizes.values()) // TASK))), "alignment-counts")
        scored = scores(links, counted, {int(stripe): -(-int(n) // TASK) for stripe, n in sizes.items()})
        scored = scored.groupBy("uid").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
        given = both.where(F.col("uid").isNotNull()).select("uid", "key", *[c for c, _ in DOC])
        out = given.join(scored, "uid", "left").select(
            F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
        )
        return keep(out, "alignment")
