"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match. A guess is right exactly if every
token re-encodes to itself and every adjacent pair keeps its boundary when the two are merged
together; both are tested for all words of a batch at once. Only words with a failing pair are
merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import SPACES, RollingHash, column_bytes, mix, slices, text_bytes

# UTF-8 of the white space beyond ASCII that separates words.
WIDE_SPACES = [
    b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(bytes([0xE2, 0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80",
]
CACHE_CHUNKS = 1 << 20
TAILS = ".,!?#*$%&;:|-"
STOPS, CLOSERS = ".!?…", "\"')]»”’"
SEED = 11
LONG_WORD = 200
_codecs: dict[str, "WordBpe"] = {}


def byte_letters() -> list[str]:
    """The printable letter of every byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Table:
    """A map from 64-bit keys to integers with room for `most` entries, looked up for whole
    arrays (missing: -1). Keys are added once each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, most: int = 0, kind: type = np.int64):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(4 * len(keys), 2 * most, 1))))))
        slots = 1 << (64 - int(self.shift))
        self.keys = np.zeros(slots + 256, np.uint64)
        self.values = np.full(slots + 256, -1, kind)
        self.probes = 0
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        left, probe = np.arange(len(keys)), 0
        while len(left):  # one entry a free slot and round; the others go one slot further
            at = self.slot(keys[left]) + probe
            _, first = np.unique(at, return_index=True)
            first = first[self.values[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            left = np.delete(left, first)
            probe += 1
        self.probes = max(self.probes, probe)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, given: np.ndarray) -> np.ndarray:
        keys = given.ravel()
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        left = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            near = at[left] + probe
            hit = self.keys[near] == keys[left]
            out[left[hit]] = self.values[near[hit]]
            left = left[~hit & (self.values[near] >= 0)]
        return out.reshape(given.shape)


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the white-space-free stretches of UTF-8 texts end to end."""
    space = SPACES[data]
    leads = np.flatnonzero((data == 0xC2) | (data - np.uint8(0xE1) <= 2))
    if len(leads):
        padded = np.append(data, np.zeros(2, np.uint8))
        for wide in WIDE_SPACES:
            at = leads[padded[leads] == wide[0]]
            for step in range(1, len(wide)):
                at = at[padded[at + step] == wide[step]]
            for step in range(len(wide)):
                space[at + step] = True
    # A gap before every text parts the last stretch of one from the first of the next.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left, right = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    left[1:], right[:-1] = space, space
    starts = np.flatnonzero(~right & (left | edge))
    ends = np.flatnonzero(~left & (right | edge))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class WordBpe:
    """Encoder of a lower-casing BPE vocabulary with word ends, with a bounded cache of chunks
    (white-space-free stretches of text). Ids of merged tokens must rise with merge rank."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.tokens = [""] * len(vocab)
        for token, i in vocab.items():
            self.tokens[i] = token
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.tokens += [""] * (max(added.values(), default=-1) + 1 - len(self.tokens))
        for token, i in added.items():
            self.tokens[i] = token
        self.special = added
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in added) + ")") if added else None
        self.words = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        if (np.diff(merged) <= 0).any():
            raise ValueError("ids of merged tokens must rise with merge rank")
        self.size = len(self.tokens)
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        lefts = np.array([vocab[a] for a, _ in merges], np.int64)
        rights = np.array([vocab[b] for _, b in merges], np.int64)
        self.left[merged], self.right[merged] = lefts, rights
        self.pairs = Table((lefts * self.size + rights).astype(np.uint64), merged)
        letters = byte_letters()
        self.byte_ids = np.array([[vocab[c] for c in letters], [vocab[c + suffix] for c in letters]])
        back = {c: b for b, c in enumerate(letters)}
        inner = {bytes(back[c] for c in t): i for t, i in vocab.items() if i not in added.values() and not t.endswith(suffix)}
        final = {bytes(back[c] for c in t[: -len(suffix)]): i for t, i in vocab.items() if i not in added.values() and t.endswith(suffix)}
        self.inner, self.final = self.token_table(inner), self.token_table(final)
        self.longest = max(map(len, [*inner, *final]))
        own = self.kept_apart(lefts, rights, merged)
        self.sound = np.ones(self.size, bool)
        for i, a, b, ok in zip(merged.tolist(), lefts.tolist(), rights.tolist(), own.tolist()):
            self.sound[i] = ok and self.sound[a] and self.sound[b]
        self.clear()

    @staticmethod
    def token_table(tokens: dict[bytes, int]) -> Table:
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([len(t) for t in tokens])
        starts = np.concatenate([[0], ends[:-1]])
        return Table(RollingHash(data, SEED)(starts, ends), np.array(list(tokens.values())))

    def clear(self, chunks: int = 0) -> None:
        none = np.zeros(0, np.uint64)
        self.index, self.known = Table(none, none, 2 * max(CACHE_CHUNKS, chunks), np.int32), 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int32)
        self.marks = np.zeros(1 << 16, np.int64)
        self.ends_sentence = np.zeros(1 << 16, bool)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def kept_apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For pairs of tokens: whether merging the joined pair never crosses the boundary.

        Walks back in merge time: the two tokens at the boundary could have merged while both
        stood there, that is before the later of them was itself merged into its parent."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40) if limit is None else limit.copy()
        apart = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            met = self.pairs((x * self.size + y).astype(np.uint64))
            crosses = (met >= 0) & (met < limit[live])
            apart[live[crosses]] = False
            undo_left = (x > y) & (self.left[x] != x)
            undo_right = (x <= y) & (self.left[y] != y)
            go = live[undo_left & ~crosses]
            limit[go], a[go] = a[go], self.right[a[go]]
            go = live[undo_right & ~crosses]
            limit[go], b[go] = b[go] + 1, self.left[b[go]]
            live = live[(undo_left | undo_right) & ~crosses]
        return apart

    def guess(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for words laid end to end: (tokens, how many each word has).
        A token that ends a word is looked up among those with the word-end suffix."""
        hashed = RollingHash(data, SEED)
        lengths = np.diff(offsets)
        stop = np.repeat(offsets[1:], lengths)
        token = np.full(len(data), -1)
        step = np.ones(len(data), np.int64)
        here = np.arange(len(data))
        for n in range(1, self.longest + 1):
            here = here[here + n < stop[here]]
            if not len(here):
                break
            found = self.inner(hashed(here, here + n))
            hit = found >= 0
            token[here[hit]], step[here[hit]] = found[hit], n
        here = np.flatnonzero(stop - np.arange(len(data)) <= self.longest)
        found = self.final(hashed(here, stop[here]))
        hit = found >= 0
        token[here[hit]], step[here[hit]] = found[hit], (stop[here] - here)[hit]
        counts = np.zeros(len(lengths), np.int64)
        at, live, rows, out = offsets[:-1].copy(), np.arange(len(lengths)), [], []
        while len(live):
            rows.append(live)
            out.append(token[at[live]])
            counts[live] += 1
            at[live] += step[at[live]]
            live = live[at[live] < offsets[live + 1]]
        order = np.argsort(np.concatenate(rows), kind="stable") if rows else []
        return (np.concatenate(out)[order] if out else token), counts

    def merge(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words given as byte tokens end to end: the lowest-ranked pair
        first, the leftmost of equals; one merge a word and round, for all words at once."""
        counts = np.diff(offsets)
        out, order = [], np.argsort(counts, kind="stable")
        done = np.zeros(len(counts), np.int64)
        none = 1 << 40
        *groups, long = np.split(order, np.searchsorted(counts[order], (5, 9, 13, 20, 40, LONG_WORD)))
        for i in long.tolist():
            exact = self.merge_long(ids[offsets[i] : offsets[i + 1]].tolist())
            done[i] = len(exact)
            out.append((np.array([i]), np.array(exact)))
        for group in groups:
            for rows in np.array_split(group, max(1, int(counts[group].sum() >> 20))):
                if not len(rows):
                    continue
                width = int(counts[rows].max())
                grid = np.full((len(rows), width + 2), -1)
                cols = np.arange(width)
                there = cols < counts[rows][:, None]
                grid[:, :width][there] = ids[(offsets[rows][:, None] + cols)[there]]

                def rank(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                    found = self.pairs((np.maximum(x, 0) * self.size + np.maximum(y, 0)).astype(np.uint64))
                    return np.where((x < 0) | (y < 0) | (found < 0), none, found)

                ranks = rank(grid[:, :-1], grid[:, 1:])
                live = np.arange(len(rows))
                while len(live):
                    best_at = ranks[live].argmin(axis=1)
                    best = ranks[live, best_at]
                    live, best_at, best = live[best < none], best_at[best < none], best[best < none]
                    if not len(live):
                        break
                    for array, gap in ((grid, 1), (ranks, 0)):
                        at = np.arange(array.shape[1] - 1)
                        part = array[live]
                        part[:, :-1] = np.take_along_axis(part, at + (at >= best_at[:, None] + gap), axis=1)
                        part[:, -1] = none if array is ranks else -1
                        array[live] = part
                    grid[live, best_at] = best
                    ranks[live, best_at] = rank(best, grid[live, best_at + 1])
                    before = best_at > 0
                    ranks[live[before], best_at[before] - 1] = rank(grid[live[before], best_at[before] - 1], best[before])
                done[rows] = (grid >= 0).sum(axis=1)
                out.append((rows, grid[grid >= 0]))
        flat = np.concatenate([x for _, x in out])
        row = np.concatenate([np.repeat(r, done[r]) for r, _ in out])
        return flat[np.argsort(row, kind="stable")], done

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for one long word: pairs wait in a heap by rank and place."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.pairs((np.array(ids[:-1]) * self.size + np.array(ids[1:])).astype(np.uint64)).tolist()
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := int(self.pairs(np.array([ids[a] * self.size + ids[b]], np.uint64))[0])) >= 0:
                    heapq.heappush(heap, (found, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens end to end, how many each word has); words hold no line feed."""
        data = np.frombuffer("\n".join(words).encode("utf-8", "replace") + b"\n", np.uint8)
        feeds = np.flatnonzero(data == 10)
        offsets = np.concatenate([[0], feeds - np.arange(len(words)) if words else []]).astype(np.int64)
        data = data[data != 10]
        flat, counts = self.guess(data, offsets)
        row = np.repeat(np.arange(len(words)), counts)
        bad = np.zeros(len(words), bool)
        bad[row[~self.sound[flat]]] = True
        at = np.flatnonzero(row[1:] == row[:-1])
        keys, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        bad[row[at[~self.kept_apart(keys // self.size, keys % self.size)[back]]]] = True
        wrong = np.flatnonzero(bad)
        if not len(wrong):
            return flat, counts
        last = np.zeros(len(data), np.int64)
        last[offsets[1:] - 1] = 1
        lengths = np.diff(offsets)
        ids = self.byte_ids[last, data][np.repeat(bad, lengths)]
        own = np.concatenate([[0], np.cumsum(lengths[wrong])])
        exact, n = self.merge(ids, own)
        keep = ~bad[row]
        counts[wrong] = n
        rows = np.concatenate([row[keep], np.repeat(wrong, n)])
        return np.concatenate([flat[keep], exact])[np.argsort(rows, kind="stable")], counts

    @staticmethod
    def normal(part: str) -> str:
        if part.isascii():
            return part.lower()
        return (part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()

    def pieces(self, chunk: str) -> list[int | str]:
        """The special ids and the words of a chunk, in order."""
        out: list[int | str] = []
        for part in self.special_split.split(chunk) if self.special_split and "<" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words.findall(self.normal(part))
        return out

    def learn(self, chunks: list[str], marks: np.ndarray) -> None:
        """Encode new chunks and keep them under the numbers that follow the known ones."""
        words: list[str] = []
        fixed: dict[int, int] = {}
        counts = []
        # Lower case of all chunks at once: no chunk holds a line feed.
        for chunk, low in zip(chunks, self.normal("\n".join(chunks)).split("\n")):
            if low.isalpha():
                words.append(low)
                counts.append(1)
                continue
            base = low.rstrip(TAILS)
            if base.isalpha():
                words += (base, low[len(base) :])
                counts.append(2)
                continue
            own = self.pieces(chunk)
            counts.append(len(own))
            for piece in own:
                if isinstance(piece, int):
                    fixed[len(words)] = piece
                    piece = "!"
                words.append(piece)
        flat, sizes = self.encode_words(words)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for at, special in fixed.items():
            flat[ends[at]] = special
        stops = ends[np.cumsum(counts)]
        counts = np.diff(np.concatenate([[0], stops]))
        first, n = self.known, len(chunks)
        while first + n > len(self.starts):
            for name in ("starts", "counts", "marks", "ends_sentence"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[first : first + n] = self.used + stops - counts
        self.counts[first : first + n] = counts
        self.marks[first : first + n] = marks
        self.ends_sentence[first : first + n] = [c[-1] in STOPS or c[-1] in CLOSERS and c.rstrip(CLOSERS)[-1:] in (*STOPS,) for c in chunks]
        self.used += len(flat)
        self.known += n

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache's number of every chunk; unknown ones are learnt. A chunk is known by its
        hash, and by its length and the sum of its bytes: if these differ, its next hash is tried."""
        keys = RollingHash(data, SEED + 1)(starts, ends)
        sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
        marks = (sums[ends] - sums[starts]) << 24 | np.minimum(ends - starts, (1 << 24) - 1)
        at = self.index(keys).astype(np.int64)
        left = np.arange(len(keys))
        while True:
            unknown = left[at[left] < 0]
            if len(unknown):
                fresh, first = np.unique(keys[unknown], return_index=True)
                first = unknown[first]
                raw = data.tobytes()
                chunks = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                self.index.add(fresh, np.arange(self.known, self.known + len(fresh)))
                self.learn(chunks, marks[first])
                at[unknown] = self.index(keys[unknown])
            left = left[self.marks[at[left]] != marks[left]]
            if not len(left):
                return at
            keys[left] = mix(keys[left] + np.uint64(1))
            at[left] = self.index(keys[left])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids end to end, the offsets of each text, and for each id whether a sentence ends after it."""
        return self.encode_bytes(*text_bytes(texts))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for UTF-8 texts laid end to end."""
        starts, ends, row = chunk_spans(data, offsets)
        if self.known + len(starts) > 2 * CACHE_CHUNKS or self.known > CACHE_CHUNKS:
            self.clear(len(starts))
        at = self.numbers(data, starts, ends)
        lengths = self.counts[at].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - lengths), lengths)]
        out = np.zeros(len(offsets), np.int64)
        out[1:] = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(1, len(offsets)), side="left")]
        stops = np.zeros(total, bool)
        stops[ends[self.ends_sentence[at] & (lengths > 0)] - 1] = True
        return ids, out, stops

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by spaces, as the library does without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(spec: str) -> WordBpe:
    """The worker's encoder for this vocabulary, kept between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = WordBpe(spec)
    return _codecs[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) of every row of `docs`, by the vocabulary file at
    `vocabulary` (read on the driver and broadcast: a fixed file of a few MB).

    Ids equal the library's without special tokens; strings of the added tokens in a text are
    those tokens. A null text counts as empty and gives no ids and an empty string; empty tables
    give none; repeated rows are encoded each; other columns of any name are not carried."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(spec.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets, _ = bpe.encode_bytes(*column_bytes(part.column("text")))
                decoded = [bpe.decode(ids[a:b]) for a, b in zip(offsets, offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists, pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"`{key}` {given.schema['key'].dataType.simpleString()}, ids array<int>, decoded string")
