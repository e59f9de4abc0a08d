"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words: space and the controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `max_bytes` of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def text_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts (null: empty) as one UTF-8 array, and the offsets of each."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of an Arrow string or binary column, without making Python objects."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class RollingHash:
    """64-bit polynomial hashes of any slices of one byte array, from prefix sums.

    Equal slices have equal hashes wherever they stand; two hashes with different seeds
    serve as one of 128 bits. Symbols and powers of a seed are made once a process."""

    tables: dict[int, tuple[np.ndarray, int, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        symbol, base, forth, back = self.tables.get(seed) or self.made(seed, 1 << 16)
        if len(back) <= len(data):
            symbol, base, forth, back = self.made(seed, len(data) + len(data) // 4)
        if len(back) <= 1 << 21:  # longer tables serve one text alone
            self.tables[seed] = (symbol, base, forth, back)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = symbol[data]
        terms *= forth[: len(data)]
        np.cumsum(terms, out=self.sums[1:])
        self.back = back

    @staticmethod
    def made(seed: int, n: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        symbol = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) | 5
        return symbol, base, powers(base, n), powers(pow(base, -1, 1 << 64), n)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs of non-space bytes) of texts laid end to end."""
    inside = ~SPACES[data]
    left = np.ones(len(data), bool)
    left[1:] = ~inside[:-1]
    left[offsets[:-1][offsets[:-1] < len(data)]] = True
    right = np.ones(len(data), bool)
    right[:-1] = ~inside[1:]
    right[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & left)
    ends = np.flatnonzero(inside & right) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: A group of more than one MOST_HEAVY-th of all rows is joined by broadcast: there are fewer
#: than MOST_HEAVY such groups in any table.
MOST_HEAVY = 512


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """`rows` joined (inner or left) to `groups`, a stored table of one narrow row per `on` with
    the number `n` of that group's rows; `n` goes away. `rows` is read twice, so it should be a
    stored table; `total` is its size, or more.

    Rows of heavy groups never meet in one task: these groups are fewer than MOST_HEAVY by
    arithmetic, so they are told by a list of their keys' hashes and broadcast; other rows are
    shuffled. A light group whose hash is on the list is broadcast as well."""
    key = F.xxhash64(*on)
    heavy = [r[0] for r in groups.where(F.col("n") * MOST_HEAVY > total).select(key).distinct().collect()]
    groups = groups.drop("n")
    if not heavy:
        return rows.join(groups, on, how)
    known = key.isin(heavy)
    near = rows.where(known).join(F.broadcast(groups.where(known)), on, how)
    return near.unionByName(rows.where(~known).join(groups.where(~known), on, how))


def content_id(*columns: Column) -> Column:
    """128 bits of the columns' UTF-8 (null: empty), the same for equal contents."""
    full = [F.coalesce(c, F.lit("")) for c in columns]
    return F.unhex(F.md5(full[0] if len(full) == 1 else F.concat_ws("\x1f", *full)))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have: `name`, or that with underscores behind."""
    while name in docs.columns:
        name += "_"
    return name
