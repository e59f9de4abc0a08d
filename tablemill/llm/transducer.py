"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines annotate their transitions with what they emit. The first reads classes of
characters and emits a mark where a word starts. It has eight states, so the map of a chunk from
every entry state to its exit state is computed for all chunks at once, maps are composed by a
parallel prefix scan, and each chunk is read again from the entry state so found. The second
reads the bytes of a word and emits token counts: a state holds the longest suffix of what was read that
begins a token, and for every suffix of it that begins a token the last token before that suffix
and how many tokens fewer it took to get there. The token that ends at a byte is the one whose
boundary with the last token before it is kept when both are merged together; exactly one is.
A transition's count is the change of the number of tokens, so the counts of a word add up to the
library's. States and transitions are made when first met. Long words are cut in pieces; a
piece's map is taken at a guessed entry state, and again where composing the maps shows another one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm.bpe import Table, byte_letters, read_spec
from tablemill.llm.common import column_bytes, slices

# Endings that the pre-tokenizer cuts off behind an apostrophe.
SHORT_ENDINGS = (b"s", b"t", b"m", b"d")
LONG_ENDINGS = (b"re", b"ve", b"ll")

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, LAST_BLANK, LAST_SPACE = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PREFIX, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)
#: Characters in a chunk of the first machine and bytes in a piece of the second.
CHUNK, PIECE = 256, 64
#: Transitions kept between slices, and bytes that the second machine reads between two looks at that bound.
KEPT, STRETCH = 1 << 19, 1 << 20
UNKNOWN = 255
_machines: dict[str, "Counter"] = {}


def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, word starts here) by [symbol, state]; symbols from 9 on are those that begin a text."""
    to, mark = np.zeros((18, 8), np.uint8), np.ones((18, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: ONE_LEFT, LONG: TWO_LEFT, BLANK: IN_SPACES, SPACE: IN_SPACES, LAST_BLANK: PREFIX, LAST_SPACE: FRESH}
    for symbol, state in run.items():
        to[symbol] = to[symbol + 9] = state
    for symbol, states in ((LETTER, (IN_LETTERS, PREFIX)), (NUMBER, (IN_NUMBERS, PREFIX)), (OTHER, (IN_OTHERS, PREFIX)), (SHORT, (IN_OTHERS, PREFIX)), (LONG, (IN_OTHERS, PREFIX)), (BLANK, (IN_SPACES,)), (SPACE, (IN_SPACES,))):
        for state in states:
            mark[symbol, state] = False
            if symbol in (SHORT, LONG):
                to[symbol, state] = IN_OTHERS
    for state, after in ((TWO_LEFT, ONE_LEFT), (ONE_LEFT, FRESH)):
        to[LETTER, state], mark[LETTER, state] = after, False
    return to, mark


WORD_TO, WORD_MARK = word_machine()


def word_starts(symbols: np.ndarray) -> np.ndarray:
    """For each symbol, whether a word starts with it."""
    n = len(symbols)
    grid = np.zeros(-(-n // CHUNK) * CHUNK, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (grid.shape[1], 8))
    for column in grid:
        maps = WORD_TO[column[:, None], maps]
    step = 1
    while step < len(maps):  # after each round a map spans twice as many chunks
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)])
        step *= 2
    state = np.full(len(maps), FRESH, np.uint8)
    state[1:] = maps[:-1, FRESH]
    out = np.zeros(grid.shape, bool)
    for i, column in enumerate(grid):
        out[i] = WORD_MARK[column, state]
        state = WORD_TO[column, state]
    return out.T.reshape(-1)[:n]


class Counter:
    """Both machines of one vocabulary file of the library's kind `ByteLevel` + `BPE`."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model, before = parsed["model"], parsed["pre_tokenizer"]
        plain = (model["type"], before["type"], before.get("add_prefix_space"), before.get("use_regex"), parsed["normalizer"])
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if plain != ("BPE", "ByteLevel", False, True, None) or odd:
            raise ValueError("no plain byte-level BPE vocabulary")
        added = [t["content"] for t in parsed["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parsed["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not known")
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(added, key=len, reverse=True))) if added else None
        self.library = Tokenizer.from_str(spec).pre_tokenizer
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        # Tokens are numbered by merge rank: bytes first.
        byte = {c: b for b, c in enumerate(byte_letters())}
        number = {c: b for c, b in byte.items()}
        self.left, self.right, self.sound = list(range(256)), list(range(256)), [True] * 256
        self.merged: dict[tuple[int, int], int] = {}
        spelled = [bytes([b]) for b in range(256)]
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, new = number[a], number[b], len(self.left)
            number[a + b] = new
            self.sound.append(self.sound[x] and self.sound[y] and self.apart(x, y, new))
            self.merged[x, y] = new
            self.left.append(x)
            self.right.append(y)
            spelled.append(spelled[x] + spelled[y])
        self.child: dict[int, int] = {}
        self.parent, self.token, edge = [0], [-1], [0]
        for t, spelling in enumerate(spelled):
            node = 0
            for b in spelling:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(node)
                    self.token.append(-1)
                    edge.append(b)
                node = self.child[key]
            if self.sound[t]:
                self.token[node] = t
        # Suffix links: by depth, so that those of parents are known.
        depth = [0] * len(self.parent)
        for node in range(1, len(depth)):
            depth[node] = depth[self.parent[node]] + 1
        self.link = [0] * len(depth)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            if self.parent[node]:
                self.link[node] = self.follow(self.link[self.parent[node]], edge[node])
        self.clear()

    def follow(self, node: int, byte: int) -> int:
        while (found := self.child.get(node << 8 | byte)) is None and node:
            node = self.link[node]
        return found or 0

    def apart(self, a: int, b: int, limit: int = 1 << 40) -> bool:
        """Whether merging the two tokens' bytes together (as far as merge `limit`) keeps the boundary between them: walks
        back in merge time and looks whether the two tokens that meet there could have merged first."""
        while True:
            met = self.merged.get((a, b))
            if met is not None and met < limit:
                return False
            if a > b and self.left[a] != a:
                limit, a = a, self.right[a]
            elif a <= b and self.left[b] != b:
                limit, b = b + 1, self.left[b]
            else:
                return True

    def clear(self) -> None:
        none = np.zeros(0, np.uint64)
        self.moves, self.known = Table(none, none, KEPT + STRETCH), 0
        self.kept: dict[tuple[int, int], bool] = {}
        start = (0, ((-1, 0),))
        self.states, self.numbers = [start], {start: 0}

    def move(self, state: int, byte: int) -> int:
        """The transition: next state and emitted count, as one number."""
        node, held = self.states[state]
        near: dict[int, tuple[int, int]] = {}
        for entry in held:
            near[node] = entry
            node = self.link[node]
        node = self.follow(self.states[state][0], byte)
        token, change, suffix = -1, 0, node
        while suffix:
            t = self.token[suffix]
            if t >= 0:
                last, fewer = near[self.parent[suffix]]
                if last < 0:
                    fits = True
                elif (fits := self.kept.get((last, t))) is None:
                    fits = self.kept[last, t] = self.apart(last, t)
                if fits:
                    token, change = t, fewer + 1
                    break
            suffix = self.link[suffix]
        after, suffix = [], node
        while suffix:
            last, fewer = near[self.parent[suffix]]
            after.append((last, fewer - change))
            suffix = self.link[suffix]
        found = (node, (*after, (token, 0)))
        number = self.numbers.get(found)
        if number is None:
            number = self.numbers[found] = len(self.states)
            self.states.append(found)
        return number << 16 | change + (1 << 15)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, count) of every piece of `data` from its entry state, all in step."""
        order = np.argsort(-lengths, kind="stable")
        starts, falling = starts[order], -lengths[order]
        state, count = entry[order], np.zeros(len(order), np.int64)
        for i in range(-int(falling[0]) if len(falling) else 0):
            live = np.searchsorted(falling, -i)  # pieces longer than i
            keys = (state[:live] << 8 | data[starts[:live] + i]).astype(np.uint64)
            found = self.moves(keys)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                fresh = np.unique(keys[missing])
                self.moves.add(fresh, np.array([self.move(k >> 8, k & 255) for k in fresh.tolist()], np.int64))
                self.known += len(fresh)
                found[missing] = self.moves(keys[missing])
            state[:live] = found >> 16
            count[:live] += (found & 0xFFFF) - (1 << 15)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The counts of pieces in order; those not `first` go on with the word of the piece before."""
        entry = np.zeros(len(starts), np.int64)
        leave, count = self.run(data, starts, lengths, entry)
        while True:
            wrong = np.flatnonzero(~first[1:] & (entry[1:] != leave[:-1])) + 1
            if not len(wrong):
                return count
            entry[wrong] = leave[wrong - 1]
            leave[wrong], count[wrong] = self.run(data, starts[wrong], lengths[wrong], entry[wrong])

    def symbols(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first machine's input for valid UTF-8, and the place of each character; `begins` marks bytes that begin a text."""
        if len(data) and data.max() < 128:
            at, code = np.arange(len(data)), data.astype(np.int64)
        else:
            at = np.flatnonzero((data & 0xC0) != 0x80)
            lead = data[at].astype(np.int64)
            more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            code = lead & np.array([0x7F, 0x1F, 0x0F, 0x07])[more]
            padded = np.append(data, np.zeros(3, np.uint8))
            for step in (1, 2, 3):
                code = np.where(more >= step, code << 6 | padded[at + step] & 0x3F, code)
        symbol = self.classes[code]
        if (symbol == UNKNOWN).any():
            self.learn(np.unique(code[symbol == UNKNOWN]))
            symbol = self.classes[code]
        begin = begins[at]
        # What follows inside the same text: nothing counts as a space.
        after = np.full(len(at) + 2, -1)
        after[: len(at)] = np.where(begin, -1, code)
        n, m = after[1:-1].copy(), after[2:].copy()
        m[n < 0] = -1
        apostrophe = code == 0x27
        if apostrophe.any():
            symbol[apostrophe & np.isin(n, [x[0] for x in SHORT_ENDINGS])] = SHORT
            for x, y in LONG_ENDINGS:
                symbol[apostrophe & (n == x) & (m == y)] = LONG
        spaces = symbol == SPACE
        solid = np.zeros(len(at), bool)
        solid[:-1] = ~spaces[1:] & ~begin[1:]
        symbol[spaces & (code == 0x20)] = BLANK
        symbol[spaces & solid] += LAST_SPACE - SPACE
        symbol[begin] += 9
        return symbol, at

    def learn(self, codes: np.ndarray) -> None:
        """The classes of characters, as the library's own pre-tokenizer joins them to known ones."""
        for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            text = "".join(f"{lead}{chr(c)}\n\n" for c in codes.tolist())
            starts, ends = np.array([span for _, span in self.library.pre_tokenize_str(text)]).T
            end = dict(zip(starts.tolist(), ends.tolist()))
            self.classes[codes[[end.get(4 * i) == 4 * i + 2 for i in range(len(codes))]]] = kind
        left = codes[self.classes[codes] == UNKNOWN]
        self.classes[left] = SPACE

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The token counts of UTF-8 texts laid end to end."""
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(offsets))
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        out = np.zeros(rows, np.int64)
        raw = data.tobytes()
        if self.special is not None:
            found = [m.span() for m in self.special.finditer(raw)]
            found = [(a, b) for a, b in found if row[a] == row[b - 1]]
            if found:
                keep = np.ones(len(data), bool)
                for a, b in found:
                    keep[a:b] = False
                    out[row[a]] += 1
                    if b < len(data):
                        begins[b] = True
                # The next byte kept begins a text where any byte since the last one did.
                group = np.cumsum(keep) - keep
                opens = np.bincount(group[begins], minlength=int(keep.sum()) + 1)[: int(keep.sum())] > 0
                data, row, begins = data[keep], row[keep], opens
        if not len(data):
            return out
        symbol, at = self.symbols(data, begins)
        starts = at[word_starts(symbol)]
        lengths = np.diff(np.append(starts, len(data)))
        first = np.ones(len(starts), bool)
        if lengths.max() > PIECE:
            n = -(-lengths // PIECE)
            ends = np.cumsum(n)
            part = np.arange(ends[-1]) - np.repeat(ends - n, n)
            first = part == 0
            whole = np.repeat(starts + lengths, n)
            starts = np.repeat(starts, n) + part * PIECE
            lengths = np.minimum(whole - starts, PIECE)
        # A stretch of STRETCH bytes ends with a word; a longer word is a stretch alone.
        cut = np.flatnonzero(first)
        stretch = np.unique(cut[np.searchsorted(starts[cut], np.arange(0, len(data), STRETCH))[1:].clip(max=len(cut) - 1)])
        for a, b in zip([0, *stretch.tolist()], [*stretch.tolist(), len(starts)]):
            if a < b:
                if self.known > KEPT:
                    self.clear()
                count = self.pieces(data, starts[a:b], lengths[a:b], first[a:b])
                out += np.bincount(row[starts[a:b]], weights=count, minlength=rows).astype(np.int64)
        return out


def machine(spec: str) -> Counter:
    """The worker's machines for this vocabulary, kept between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _machines:
        _machines.clear()
        _machines[key] = Counter(spec)
    return _machines[key]


def valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with replacement characters for bytes that are no UTF-8."""
    raw = data.tobytes()
    try:
        raw.decode()
        return data, offsets
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets, offsets[1:])]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of `docs`, by the vocabulary file at
    `vocabulary` (read on the driver and broadcast: a fixed file of a few MB).

    The tokens are those that the library gives without special tokens; strings of the added
    tokens in a text are those tokens. A null text counts as empty: no bytes, no tokens. Texts of any
    length are read whole; repeated rows are counted each; bytes that are no UTF-8 count as
    replacement characters; empty tables give no rows; other columns of any name are not carried."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = machine(spec.value)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                tokens = count(*valid(data, offsets))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"`{key}` {given.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
