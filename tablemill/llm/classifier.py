"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded as character-class statistics and a
learned layer; a gated attention weighs the passages, trained from document labels alone; the
weighted passage representation is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import SPACES, RollingHash, content_id, mix, slices, text_bytes, word_spans

#: Passages have PASSAGE bytes in texts of every length. Training alone takes at most MOST of a
#: document, those with the least hash of key and number; scoring reads all, BLOCK at a time.
PASSAGE, MOST, BLOCK = 512, 64, 2048
#: The classifier is fitted on at most so many labelled documents, taken by the hash of their id.
TRAINING_DOCS = 2048
CLASSES = 16


def _classes() -> np.ndarray:
    table = np.full(256, 13, np.int64)  # other signs and controls
    groups = (b" \t\r\x0b\x0c", b"\n", b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"#", b"*", b"$%&", b"|<>")
    for n, group in enumerate(groups):
        table[list(group)] = n
    table[0x80:0xC0] = 14
    table[0xC0:] = 15
    return table


CLASS_OF = _classes()
EXTRA = 4
WIDTH = CLASSES * CLASSES + EXTRA


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, the row of each). An empty or null text has one passage."""
    return _encode(*text_bytes(texts))


def passage_blocks(text: str) -> Iterator[np.ndarray]:
    """The features of one text's passages, BLOCK at a time; a word belongs whole to the passage
    where it starts, so they equal those of `encode_passages`."""
    data, offsets = text_bytes([text])
    spaces = np.flatnonzero(SPACES[data])
    for start in range(0, len(data), BLOCK * PASSAGE):
        end = min(len(data), start + BLOCK * PASSAGE)
        after = np.searchsorted(spaces, end)
        word_end = int(spaces[after]) if after < len(spaces) else len(data)
        yield _encode(data[start:word_end], np.array([0, end - start]), word_end - end, start > 0 and not SPACES[data[start - 1]])[0]


def _encode(data: np.ndarray, offsets: np.ndarray, tail: int = 0, in_word: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """`tail` bytes after the last offset only complete its last word; with `in_word` the first
    bytes continue a word counted before."""
    whole, data = data, data[: len(data) - tail]
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(sizes)), n)
    out = np.zeros((len(row), WIDTH), np.float32)
    if len(data):
        text_row = np.repeat(np.arange(len(sizes)), sizes)
        passage = first[text_row] + (np.arange(len(data)) - offsets[text_row]) // PASSAGE
        kind = CLASS_OF[data]
        inside = passage[1:] == passage[:-1]
        bins = passage[:-1][inside] * CLASSES**2 + kind[:-1][inside] * CLASSES + kind[1:][inside]
        counts = np.bincount(bins, minlength=len(row) * CLASSES**2).reshape(len(row), -1)
        # Short passages say little: 16 unseen pairs stand beside those that were seen.
        out[:, : CLASSES**2] = np.sqrt(counts / (counts.sum(axis=1, keepdims=True) + 16))
        starts, ends, _ = word_spans(whole, np.append(offsets[:-1], len(whole)))
        mine = (starts < len(data)) & ((starts > 0) | (not in_word))
        starts, ends = starts[mine], ends[mine]
        if len(starts):
            word, at = RollingHash(whole, 41)(starts, ends), passage[starts]
            words = np.bincount(at, minlength=len(row))
            again = np.bincount(at[1:], weights=(word[1:] == word[:-1]) & (at[1:] == at[:-1]), minlength=len(row))
            distinct = np.unique(mix(word + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            kinds = np.bincount(at[distinct], minlength=len(row))
            out[:, -4] = again / np.maximum(1, words)
            out[:, -3] = kinds / np.maximum(1, words)
            out[:, -2] = np.bincount(at, weights=ends - starts, minlength=len(row)) / np.maximum(1, words) / 8
            out[:, -1] = np.log1p(words) / 5
    return out, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Parameters and passes of the model; arrays only, so that it can be sent to executors."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.w = {
            "W": start(WIDTH, hidden), "b": np.zeros(hidden), "V": start(hidden, gate), "bv": np.zeros(gate),
            "U": start(hidden, gate), "bu": np.zeros(gate), "a": start(gate), "c": start(hidden), "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, row: np.ndarray) -> dict[str, np.ndarray]:
        """row: the bag of each passage, rising from 0 without gaps."""
        w = self.w
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        h = np.tanh(x @ w["W"] + w["b"])
        a1, a2 = np.tanh(h @ w["V"] + w["bv"]), _sigmoid(h @ w["U"] + w["bu"])
        e = (a1 * a2) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[row])
        attention = e / np.add.reduceat(e, starts)[row]
        z = np.add.reduceat(attention[:, None] * h, starts)
        return {"starts": starts, "h": h, "a1": a1, "a2": a2, "attention": attention, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def gradients(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, row)
        h, a1, a2, attention, starts = f["h"], f["a1"], f["a2"], f["attention"], f["starts"]
        slope = (f["p"] - y) / len(y)
        dz = slope[:, None] * w["c"]
        dh = attention[:, None] * dz[row]
        da = (h * dz[row]).sum(axis=1)
        de = attention * (da - np.add.reduceat(attention * da, starts)[row])
        gated = de[:, None] * w["a"]
        d1, d2 = gated * a2 * (1 - a1**2), gated * a1 * a2 * (1 - a2)
        dh += d1 @ w["V"].T + d2 @ w["U"].T
        dx = dh * (1 - h**2)
        out = {
            "W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ d1, "bv": d1.sum(axis=0), "U": h.T @ d2, "bu": d2.sum(axis=0),
            "a": (a1 * a2).T @ de, "c": f["z"].T @ slope, "d": slope.sum(keepdims=True),
        }
        for name in ("W", "V", "U", "c"):
            out[name] += decay * w[name]
        return out

    def fit(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = 160, rate: float = 0.02, decay: float = 2e-4) -> GatedAttention:
        """Full-batch Adam on the labelled bags; the same rows give the same parameters."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02
        x = x - self.mean
        x /= self.scale
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, rounds + 1):
            for k, g in self.gradients(x, row, y, decay).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """All passages count. A text of more than a block's characters is read by blocks, with
        running attention sums; the others go together, about a block's characters at a time."""
        out = np.zeros(len(texts))
        sizes = np.array([len(t or "") for t in texts], np.int64)
        for i in np.flatnonzero(sizes > BLOCK * PASSAGE):
            out[i] = self._long(texts[i])
        short = np.flatnonzero(sizes <= BLOCK * PASSAGE)
        group = np.cumsum(sizes[short] + PASSAGE) // (BLOCK * PASSAGE)
        for at in np.split(short, np.flatnonzero(np.diff(group)) + 1):
            if len(at):
                x, row = encode_passages([texts[i] for i in at])
                out[at] = self.forward((x - self.mean) / self.scale, row)["p"]
        return out

    def _long(self, text: str) -> float:
        w, top, total, z = self.w, -np.inf, 0.0, np.zeros(len(self.w["c"]))
        for x in passage_blocks(text):
            h = np.tanh((x - self.mean) / self.scale @ w["W"] + w["b"])
            e = (np.tanh(h @ w["V"] + w["bv"]) * _sigmoid(h @ w["U"] + w["bu"])) @ w["a"]
            higher = max(top, e.max())
            share, fade = np.exp(e - higher), np.exp(top - higher)
            top, total, z = higher, total * fade + share.sum(), z * fade + share @ h
        return float(_sigmoid(z / total @ w["c"] + w["d"])[0])


def sampled(key: str, text: str | None) -> Iterator[np.ndarray]:
    """The features of at most MOST passages of a text, by the least hash of key and number."""
    n = max(1, -(-len((text or "").encode("utf-8", "replace")) // PASSAGE))
    order = mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(key.encode())))
    chosen = np.sort(np.argsort(order, kind="stable")[:MOST])
    for i, x in enumerate(passage_blocks(text) if text else [encode_passages([text])[0]]):
        yield x[chosen[(chosen >= i * BLOCK) & (chosen < (i + 1) * BLOCK)] - i * BLOCK]


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the key's text modulo 3 is 1, or no key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", training_docs: int = TRAINING_DOCS) -> GatedAttention:
    """Fit on a bounded sample: the `training_docs` labelled documents (not held out, label not
    null) with the least hash of their key; with several labels the lowest counts, with several
    texts the one with the least content hash. At most training_docs * MOST passages of WIDTH numbers come to the driver.
    Without any label the model scores 0.5."""
    chosen = (
        labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
        .join(docs.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
        .orderBy(F.xxhash64("key"), "key").limit(training_docs)
    )
    # Bounded by training_docs rows of a key and a label; then one row a key, whatever the stored order.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    least = F.min(F.struct(content_id(F.col("text")).alias("id"), "text"))
    rows = rows.groupBy("key", "label").agg(least.alias("least")).select("key", "label", F.col("least.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                packed = [b"".join(x.tobytes() for x in sampled(k, t)) for k, t in zip(part.column("key").cast(pa.string()).to_pylist(), texts)]
                yield pa.RecordBatch.from_arrays([part.column("key").cast(pa.string()), part.column("label"), pa.array(packed, pa.binary())], names=["key", "label", "passages"])

    found = sorted({r["key"]: (r["key"], r["label"], bytes(r["passages"])) for r in rows.mapInArrow(run, "key string, label int, passages binary").collect()}.values())
    model = GatedAttention()
    if not found:
        model.w["c"][:] = 0
        return model
    row = np.repeat(np.arange(len(found)), [len(p) // (4 * WIDTH) for _, _, p in found])
    y = np.array([y for _, y, _ in found], float)
    x = np.frombuffer(b"".join(p for _, _, p in found), np.float32)
    del found  # the driver holds one copy of the sample
    return model.fit(x.reshape(-1, WIDTH).astype(np.float64), row, y)


def score(docs: DataFrame, model: GatedAttention, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row of `docs`, from the text alone.

    score is the probability of label 1, predicted is 1 from 0.5 on. Null and empty texts are
    bags of one empty passage and scored as such; repeated rows give equal rows; rows with a
    null key count as held out; other columns are neither read nor carried."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = sent.value.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(p, pa.float64())], names=["key", "score"])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    scored = given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, score double")
    return scored.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: GatedAttention, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores `least` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        return pd.Series(np.concatenate([sent.value.scores(list(texts[i : i + 1000])) for i in range(0, len(texts), 1000)]) if len(texts) else np.zeros(0))

    return docs.where(scores(F.col(f"`{text}`")) >= least)
