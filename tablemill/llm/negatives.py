"""Hard negatives by a full sort of every anchor's scores.

Anchors are taken in blocks of bounded size, and every block meets all rows in a scan that
shuffles no vector. A task lays the rows of a batch in the order of their ids, computes the integer
scores of each anchor and sorts them; equal scores so stay in the order of ids. The first pass
reads the best rows of the anchor's label off that order (the positives). The second searches
each positive's upper limit in it and reads the rows of other labels that follow, down to the
lower limit. Tasks keep the best few for an anchor (or an anchor and positive), and a ranking of
these few over all tasks decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.storage import scratch, stash

#: Anchors that meet all rows in one job: 2,048 vectors, or fewer if these are long.
BLOCK = 2048
BLOCK_COMPONENTS = 1 << 20
#: Rows whose scores with one anchor are sorted at once.
ROWS = 16384
LONG = np.iinfo(np.int64)
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, key: str, vector: str, label: str, relabel_every: int, labels: int) -> DataFrame:
    """(id, v, label) of the rows that take part."""
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return given.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad).select("id", "v", moved.alias("label"))


def matrix(column: pa.ListArray, scale: int) -> np.ndarray:
    """Lists of doubles as rows of floor(scale * x); missing components are zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.finfo(float).max
    with np.errstate(over="ignore"):
        flat = np.floor(np.clip(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale, -end, end))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of `a` and of `b`, whole numbers as doubles, exactly; what does
    not fit 64 bits stays at their end."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


class Best:
    """The first `k` entries of each slot by falling score, then rising id (a missing id last)."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id, self.none = (np.zeros(0, np.int64) for _ in range(4))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting, self.most = 0, max(1 << 16, 4 * slots * k)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        self.new.append((slot, score, ids, none))
        self.waiting += len(slot)
        if self.waiting > self.most:
            self.settle()

    def settle(self) -> None:
        entries = [np.concatenate(x) for x in zip((self.slot, self.score, self.id, self.none), *self.new)]
        slot, score, ids, none = entries
        order = np.lexsort((ids, none, ~score, slot))
        falling = slot[order]
        order = order[np.arange(len(order)) - np.searchsorted(falling, falling) < self.k]
        self.slot, self.score, self.id, self.none = (x[order] for x in entries)
        self.new, self.waiting = [], 0


def sorted_scores(batches: Iterator[pa.RecordBatch], anchors: np.ndarray, scale: int) -> Iterator[tuple]:
    """For every batch of rows and every anchor: (anchor's number, scores in falling order, and
    the ids, missing marks and labels in that order)."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            ids = batch.column("id")
            none = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            by_id = np.lexsort((ids, none))
            ids, none, labels = ids[by_id], none[by_id], batch.column("label").to_numpy(zero_copy_only=False)[by_id]
            vectors = matrix(batch.column("v"), scale)[by_id]
            step = max(1, (1 << 21) // max(1, len(ids)))
            for first in range(0, len(anchors), step):
                scores = dot(anchors[first : first + step], vectors)
                order = np.argsort(~scores, axis=1, kind="stable")  # ~ falls as scores rise, without overflow
                for i in range(len(scores)):
                    own = order[i]
                    yield first + i, scores[i, own], ids[own], none[own], labels[own]


def mine(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, k: int = 5,
    low: int = 80, high: int = 100, scale: int = 256, relabel_every: int = 7, labels: int = 10,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor
    (a row whose key is divisible by `every`) and each of its first `positives` other rows of the
    same label, the first `k` rows of other labels whose score is from `low` to `high` percent of
    the positive's. Components become floor(scale * x); where the key is divisible by
    `relabel_every`, the label first becomes (label + 1) % `labels`. Higher scores come first,
    equal ones by smaller key.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows
    without a key are no anchors, but partners; they come last among equal scores. Rows with an anchor's
    key are never its partners; an anchor that stands twice gives its rows twice. A shorter vector
    counts as filled with zeros; scores beyond 64 bits stay at their end. Empty tables give no
    rows; other columns of any name are not read."""
    spark = rows.sparkSession
    with scratch(spark) as keep:
        own = stash(usable(rows, key, vector, label, relabel_every, labels), "negatives-rows")
        anchors = stash(own.where(F.col("id") % every == 0).withColumn("uid", F.monotonically_increasing_id()), "negatives-anchors")
        widest = anchors.agg(F.max(F.size("v"))).first()[0]
        size = max(1, min(BLOCK, BLOCK_COMPONENTS // max(1, widest or 1)))
        n = anchors.count()
        blocks = -(-n // size)
        dealt = stash(anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(max(1, blocks)))), "negatives-blocks") if blocks > 1 else anchors.withColumn("block", F.lit(0))
        parts = []
        for block in range(blocks):
            given = dealt.where(F.col("block") == block).select("id", "label", "v").toArrow().combine_chunks()
            parts.append(stash(block_negatives(own, given, scale, positives, k, low, high), "negatives-part"))
        return keep(reduce(DataFrame.unionByName, parts, spark.createDataFrame([], SCHEMA)), "negatives")


def block_negatives(own: DataFrame, given: pa.Table, scale: int, positives: int, k: int, low: int, high: int) -> DataFrame:
    """The rows of one block of anchors: (uid, id, label, v) of at most a few times BLOCK rows."""
    spark = own.sparkSession
    anchor_ids = given.column("id").to_numpy()
    anchor_labels = given.column("label").to_numpy()
    vectors = given.column("v").combine_chunks()
    held = spark.sparkContext.broadcast((anchor_ids, anchor_labels, matrix(vectors, scale)))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors = held.value
        best = Best(len(anchors), positives)
        for i, scores, near, none, other in sorted_scores(batches, anchors, scale):
            at = np.flatnonzero((other == labels[i]) & ((near != ids[i]) | (none > 0)))[:positives]
            best.add(np.full(len(at), i), scores[at], near[at], none[at])
        best.settle()
        yield entries(best, "anchor")

    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = own.mapInArrow(first_pass, "anchor long, score long, id long").withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= positives)
    # At most `positives` rows an anchor of the block.
    table = found.select("anchor", "place", "score", "id").toArrow().sort_by([("anchor", "ascending"), ("place", "ascending")])
    pos_anchor, pos_score = table.column("anchor").to_numpy(), table.column("score").to_numpy()
    span = np.searchsorted(pos_anchor, np.arange(len(anchor_ids) + 1))
    limits = spark.sparkContext.broadcast((span, pos_score))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, anchors = held.value
        span, pos_score = limits.value
        best = Best(len(pos_score), k)
        for i, scores, near, none, other in sorted_scores(batches, anchors, scale):
            if span[i] == span[i + 1]:
                continue
            differs = np.flatnonzero(other != labels[i])
            falling = ~scores[differs]  # in rising order
            for slot in range(span[i], span[i + 1]):
                limit = int(pos_score[slot])
                top = max(LONG.min, min(LONG.max, high * limit // 100))
                least = -(-low * limit // 100)
                start = np.searchsorted(falling, ~np.int64(top))
                at = differs[start : start + k]
                at = at[scores[at] >= least] if least > LONG.min else at
                best.add(np.full(len(at), slot), scores[at], near[at], none[at])
        best.settle()
        yield entries(best, "slot")

    if not len(pos_score):
        return spark.createDataFrame([], SCHEMA)
    slots = spark.createDataFrame(pa.table({
        "slot": np.arange(len(pos_score)), "anchor_id": anchor_ids[pos_anchor], "positive_id": table.column("id"), "positive_score": table.column("score"),
    }))
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    near = own.mapInArrow(second_pass, "slot long, score long, id long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.join(F.broadcast(slots), "slot").select(  # at most positives * BLOCK rows
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def entries(best: Best, slot: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(best.slot, pa.int64()), pa.array(best.score, pa.int64()), pa.array(best.id, pa.int64(), mask=best.none > 0)], names=[slot, "score", "id"]
    )


#: The query's rows by all pairs of anchors and rows.
ORACLE_SQL = """
with given as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same,
        cast(coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) as bigint) as score
    from given a join given r on r.vec_id is distinct from a.vec_id
    where a.vec_id % 100 = 0
),
positives as (
    select anchor_id, other_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id nulls last) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over w as int) as rank, s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
    and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id nulls last)
qualify row_number() over w <= 5
"""
