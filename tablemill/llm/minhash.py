"""Near-duplicate classes of documents by DartMinHash signatures and banded joining.

Every weighted element of a set owns a region of unit intensity over (weight, rank). Darts are
thrown into it by hashing, so equal elements get equal darts everywhere. A set keeps the darts
within its weights and below a rank that yields about k ln k of them, each dart falls on one of
k coordinates, and the earliest dart of a coordinate is the signature there. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity. Work per set is its number
of elements plus k ln k, not their product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import RollingHash, content_id, free_name, join_groups, mix, powers, slices, text_bytes, word_spans
from tablemill.operators.graph import components
from tablemill.storage import scratch, stash

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: So many further members of each open bucket are compared with the others before all that are
#: left: most links are found by them, at one comparison a member.
PIVOTS = 2
#: Members of a bucket are compared with each other in blocks of about so many.
DEAL = 256
_ONE = 1 << 30  # ranks are fixed-point, so that sums don't depend on their order


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `words` lower-cased words, and the row of each. A text of fewer
    words has one run of all its words; a text without words (or null) has none."""
    data, offsets = text_bytes([t.lower() if t else t for t in texts])
    starts, ends, row = word_spans(data, offsets)
    each = RollingHash(data, 5)(starts, ends)
    count = np.bincount(row, minlength=len(texts))
    base = powers(0x9E3779B97F4A7C15, max(words, int(count.max(initial=0))))
    if len(each) >= words:
        runs = sum((each[j : len(each) - words + 1 + j] * base[j] for j in range(words)), np.uint64(0))
        whole = row[: len(runs)] == row[words - 1 :]
        runs, rows = runs[whole], row[: len(whole)][whole]
    else:
        runs, rows = each[:0], row[:0]
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        few = [(each[first[i] : first[i] + count[i]] * base[: count[i]]).sum(dtype=np.uint64) for i in short.tolist()]
        runs = np.concatenate([runs, np.array(few, np.uint64) + count[short].astype(np.uint64)])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        runs, rows = runs[order], rows[order]
    return mix(runs), rows


def _gaps(elements: np.ndarray, nth: np.ndarray | int) -> np.ndarray:
    """The hashed exponential gap before dart `nth` of each element, in fixed point."""
    salt = (np.atleast_1d(nth).astype(np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019)
    uniform = ((mix(elements + salt) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return (-np.log(uniform) * _ONE).astype(np.int64) + 1


def dart_signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """An (n_rows, k) array of earliest darts; rows without elements keep the largest value.

    elements: 64-bit hashes; rows: the set of each; weights: non-negative numbers (1 if None).
    A weight w owns ceil(w) unit cells; a dart in the last one counts if its own place in the
    cell is within the fraction."""
    if weights is not None:
        cells = np.ceil(weights).astype(np.int64)
        nth = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        share = np.minimum(np.repeat(weights, cells) - nth, 1.0)
        elements, rows = mix(np.repeat(elements, cells) + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), np.repeat(rows, cells)
    else:
        share = None
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n_rows, k), none)
    total = np.bincount(rows, weights=share, minlength=n_rows)
    throw = k * math.log(k) + 2 * k
    limit = np.where(total > 0, throw / np.maximum(total, 1e-9), 0.0)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[rows])
        theta = (limit[rows] * _ONE).astype(np.int64)
        many = limit[rows[mine]] > 8
        for dense in (True, False):
            part = mine[many == dense]
            if dense and len(part):  # few elements, many darts each: all of them at once
                need = np.ceil(limit[rows[part]] + 8 * np.sqrt(limit[rows[part]]) + 12).astype(np.int64)
                at, nth = np.repeat(part, need), np.arange(need.sum()) - np.repeat(np.cumsum(need) - need, need)
                sums = np.cumsum(_gaps(elements[at], nth))
                start = np.cumsum(need) - need
                before = np.where(start > 0, sums[start - 1], 0)
                rank = sums - np.repeat(before, need)
                _land(out, elements, rows, share, at, nth, rank, theta, k)
            elif not dense:  # many elements, few darts each: dart by dart among those still below
                rank = np.zeros(len(part), np.int64)
                nth = 0
                while len(part):
                    rank = rank + _gaps(elements[part], nth)
                    low = rank <= theta[part]
                    part, rank = part[low], rank[low]
                    _land(out, elements, rows, share, part, np.full(len(part), nth), rank, theta, k)
                    nth += 1
        todo &= (out == none).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return out


def _land(out: np.ndarray, elements: np.ndarray, rows: np.ndarray, share: np.ndarray | None, at: np.ndarray, nth: np.ndarray, rank: np.ndarray, theta: np.ndarray, k: int) -> None:
    """Keep the earliest dart of each coordinate: rank above, 20 bits of the dart's hash below."""
    dart = mix(elements[at] ^ (nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB)))
    keep = rank <= theta[at]
    if share is not None:
        keep &= ((dart >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.float64) < share[at] * 65536
    at, dart, rank = at[keep], dart[keep], rank[keep]
    value = (rank.astype(np.uint64) << np.uint64(20)) | (dart & np.uint64(0xFFFFF))
    np.minimum.at(out.reshape(-1), rows[at] * k + ((dart >> np.uint64(36)) % np.uint64(k)).astype(np.int64), value)


def sketch(texts: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(v, bands) of (v, text): one hash per band of the signature, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found, row = shingles(texts, words)
                signature = dart_signatures(found, row, len(texts), bands * rows).reshape(len(texts), bands, rows)
                band = np.full((len(texts), bands), np.uint64(0))
                for j in range(rows):
                    band = mix(band * np.uint64(0x2545F4914F6CDD1D) + signature[:, :, j] + np.uint64(j))
                band = mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64)
                there = np.bincount(row, minlength=len(texts)) > 0
                starts = np.concatenate([[0], np.cumsum(there)]) * bands
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(band[there].ravel()), mask=pa.array(~there))
                yield pa.RecordBatch.from_arrays([part.column("v"), lists], names=["v", "bands"])

    return texts.select("v", "text").mapInArrow(run, "v binary, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, words: int = WORDS, detail: bool = False) -> DataFrame:
    """(a, b, similarity): the exact Jaccard similarity of the word-run sets of each pair.

    pairs (a, b) is a stored table of distinct pairs; texts (v, text) has distinct v. The pairs
    of one `a` are dealt out in blocks of DEAL. A block is a stream of rows, first the text of
    `a`, then those of its partners, so a text travels once a pair or block, and a task holds
    one slice of texts and the runs of one `a`. With `detail` come how many runs b has (runs),
    how many of them a has too (common), and the others (extra)."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / DEAL).cast("int"))
    many = stash(many, "pairs-of-each")
    dealt = join_groups(pairs, many, ["a"], pairs.count()).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    right = dealt.join(texts.withColumnRenamed("v", "b"), "b").select("a", "block", "b", "text")
    left = many.join(texts.withColumnRenamed("v", "a"), "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("a", "block", F.lit(None).cast("binary").alias("b"), "text")
    stream = left.unionByName(right).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_set = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, row = shingles(part.column("text").to_pylist(), words)
                order = np.lexsort((found, row))
                found, row = found[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
                found, row = found[new], row[new]
                edges = np.searchsorted(row, np.arange(part.num_rows + 1))
                out: dict[str, list] = {f: [] for f in ("similarity", "runs", "common", "extra")}
                pairs_here = np.flatnonzero(part.column("b").is_valid().to_numpy(zero_copy_only=False))
                partner = set(pairs_here.tolist())
                for i in range(part.num_rows):
                    own = found[edges[i] : edges[i + 1]]
                    if i not in partner:
                        left_set = own
                        continue
                    at = np.searchsorted(left_set, own)
                    both = left_set[np.minimum(at, len(left_set) - 1)] == own if len(left_set) else np.zeros(len(own), bool)
                    shared = int(both.sum())
                    out["similarity"].append(shared / max(1, len(left_set) + len(own) - shared))
                    if detail:
                        out["runs"].append(len(own))
                        out["common"].append(shared)
                        out["extra"].append(own[~both].view(np.int64))
                kinds = {"similarity": pa.float64(), "runs": pa.int64(), "common": pa.int64(), "extra": pa.list_(pa.int64())}
                columns = {f: pa.array(v, kinds[f]) for f, v in out.items() if detail or f == "similarity"}
                at = pa.array(pairs_here)
                yield pa.RecordBatch.from_arrays([part.column("a").take(at), part.column("b").take(at), *columns.values()], names=["a", "b", *columns])

    return stream.mapInArrow(run, "a binary, b binary, similarity double" + ", runs long, common long, extra array<long>" * detail)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after further links (a, b): components of the labels, not of all
    vertices anew."""
    of_a, of_b = (labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    met = links.join(of_a, "a").join(of_b, "b").where("ca <> cb").select("ca", "cb").distinct()
    moved = components(met, "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("into"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    joined = join_groups(labels, stash(sizes.join(moved, "component"), "moved-labels"), ["component"], labels.count(), "left")
    return stash(joined.select("id", F.coalesce("into", "component").alias("component")), "labels")


def _classes(docs: DataFrame, keep, key: str, text: str, similarity: float, words: int, bands: int, rows: int) -> DataFrame:
    """(id, v, class, worded): the stored rows of `docs` with their content id and their class,
    which is a content id: of texts with words, the least of their component."""
    texts_of_rows = docs.select(F.col(f"`{key}`").alias("id"), content_id(F.col(f"`{text}`")).alias("v"), F.col(f"`{text}`").alias("text"))
    narrow = stash(texts_of_rows.select("id", "v"), "rows")
    total = narrow.count()
    # Each different text is read once from here on; copies are put together before the shuffle.
    once = texts_of_rows.groupBy("v").agg(F.first("text").alias("text"))
    sketches = stash(sketch(texts_of_rows, bands, rows, words), "sketches")
    chosen = sketches.groupBy("v").agg(F.count("*").alias("n"), F.first("bands").alias("bands"))
    chosen = stash(chosen, "chosen")
    banded = chosen.where("bands is not null").select("v", F.posexplode("bands").alias("band", "bucket"))
    centres = stash(banded.groupBy("bucket").agg(F.min("v").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    placed = stash(join_groups(banded, centres, ["bucket"], total * bands), "buckets")
    stars = stash(placed.where("v <> centre").select(F.col("centre").alias("a"), F.col("v").alias("b")).distinct(), "stars")
    # Every text that a later comparison can ask for stands in a star.
    wanted = stash(stars.select(F.col("a").alias("v")).union(stars.select("b")).distinct(), "wanted")
    # The plan is the same at every size: ids are hashed, texts stream past them.
    texts = stash(once.join(wanted.hint("shuffle_hash"), "v", "left_semi"), "texts")
    compared = stash(similarities(stars, texts, words), "similarities")

    def linked(found: DataFrame) -> DataFrame:
        return found.where(F.col("similarity") >= similarity - 1e-12).select("a", "b")

    found = components(linked(compared), "a", "b")
    labels = stash(wanted.select(F.col("v").alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    measured = placed.where("v <> centre").join(compared.select(F.col("a").alias("centre"), F.col("b").alias("v"), "similarity"), ["centre", "v"])
    measured = stash(measured.unionByName(placed.where("v = centre").withColumn("similarity", F.lit(1.0))), "measured")
    size = measured.count()

    def still_open(labels: DataFrame) -> DataFrame:
        """Members, but for centres, of the buckets whose members are in several components."""
        grouped = stash(measured.join(labels.select(F.col("id").alias("v"), F.col("component").alias("group")), "v"), "grouped")
        split = grouped.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n"))
        split = stash(split.where("low < high").select("bucket", "n"), "split")
        return stash(join_groups(grouped, split, ["bucket"], size).where("v <> centre"), "open")

    def in_reach(a: str, b: str) -> Column:
        """d(x,y) >= |d(x,c) - d(y,c)|: what the bucket's centre leaves possible."""
        return (F.col(f"{a}.group") != F.col(f"{b}.group")) & (F.abs(F.col(f"{a}.similarity") - F.col(f"{b}.similarity")) <= 1 - similarity + 1e-9)

    open_members = still_open(labels)
    for turn in range(PIVOTS):  # one more member of each open bucket is compared with the others
        order = F.struct(F.xxhash64("v", F.lit(turn)), "v")
        pivots = open_members.groupBy("bucket").agg(F.min_by(F.struct("v", "group", "similarity"), order).alias("p"), F.count("*").alias("n"))
        met = join_groups(open_members, stash(pivots, "pivots"), ["bucket"], size).alias("x").where(in_reach("p", "x"))
        star = stash(met.select(F.least("p.v", "x.v").alias("a"), F.greatest("p.v", "x.v").alias("b")).distinct(), "pivot-pairs")
        labels = _merged(labels, stash(linked(similarities(star, texts, words)), "links"))
        open_members = still_open(labels)
    # What two texts share lies in the centre, or in what neither has from it: with few common
    # runs outside the centre, the smaller share of the centre bounds their similarity.
    spokes = stash(open_members.select(F.col("centre").alias("a"), F.col("v").alias("b")).distinct(), "spokes")
    outside = similarities(spokes, texts, words, detail=True).select(F.col("a").alias("centre"), F.col("b").alias("v"), "runs", "common", "extra")
    open_members = open_members.join(outside, ["centre", "v"]).join(chosen.select("v", "bands"), "v")
    counts = stash(open_members.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / DEAL).cast("int")), "open-buckets")
    open_members = join_groups(stash(open_members, "outside"), counts, ["bucket"], size).withColumn("own", F.pmod(F.xxhash64("v", F.lit(9)), F.col("blocks")).cast("int"))
    open_members = stash(open_members, "dealt")
    # Block i meets block j >= i, so no task holds a whole bucket.
    x = open_members.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1))).alias("x")
    y = open_members.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).alias("y")
    shared = F.least("x.common", "y.common") + F.size(F.array_intersect("x.extra", "y.extra"))
    possible = shared * (1 + similarity) >= (F.col("x.runs") + F.col("y.runs")) * similarity - 1e-6
    # A pair is made in the first bucket that it shares.
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.band") + 1
    blocks = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    met = blocks & ((F.col("x.own") < F.col("y.own")) | (F.col("x.v") < F.col("y.v")))
    rest = x.join(y, met & in_reach("x", "y") & first & possible).select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b"))
    rest = stash(rest.distinct(), "rest")
    labels = _merged(labels, stash(linked(similarities(rest, texts, words)), "links"))
    vertices = chosen.join(labels.withColumnRenamed("id", "v"), "v", "left")
    vertices = stash(vertices.select("v", F.coalesce("component", "v").alias("class"), F.col("bands").isNotNull().alias("worded"), "n"), "vertices")
    return keep(join_groups(narrow, vertices, ["v"], total), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, null_keys: bool = False) -> DataFrame:
    """(key, class_id, class_size): one row per row of `docs`.

    class_id is the smallest key of the texts connected by word-run similarity of `similarity`
    or more. Texts are compared in lower case. Exact copies are one text. Null texts and texts
    without words are alike with nothing: each key's are their own class. Rows repeating a key
    and text give equal rows; a key with several texts has one row for each, in the class of
    that text. Rows with a null key count in their classes; they are left out of the answer
    unless `null_keys`, and are then null in class_id where no key is in the class. Other
    columns are not carried.

    Work: texts that share a band are linked to the smallest id of that bucket, and each such
    pair is compared exactly. Members of a bucket that are still in different components
    afterwards are compared with each other unless their similarities to the bucket's centre
    rule a link out (Jaccard distance is a metric), or the runs that they have from the centre
    and those that both have besides are too few; before that, PIVOTS further members stand in
    for the centre, so that few members are left. No pair that shares a band is left undecided."""
    with scratch(docs.sparkSession) as keep:
        found = _classes(docs, stash, key, text, similarity, words, bands, rows)
        own = content_id(F.concat(F.lit("without words "), F.coalesce(F.col("id").cast("string"), F.lit(""))))
        classed = keep(found.select("id", F.when(F.col("worded"), F.col("class")).otherwise(own).alias("class")), "classed")
        sizes = classed.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
        sizes = keep(sizes.withColumn("n", F.col("class_size")), "class-sizes")
        out = join_groups(classed, sizes, ["class"], classed.count())
        return (out if null_keys else out.where("id is not null")).select(F.col("id").alias(key), "class_id", "class_size")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of `docs` that stand for their class of near copies: of each class the row with
    the smallest key, null keys last, and of rows repeating that key and text one. Texts without
    words are alike with nothing and stay, but for repeats of a key. All columns are kept."""
    with scratch(docs.sparkSession) as keep:
        found = _classes(docs, stash, key, text, similarity, words, bands, rows)
        best = found.where("worded").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "v")).alias("best"))
        bare = found.where("not worded").select("id", "v")
        chosen = keep(best.select("best.id", "best.v").unionByName(bare).distinct(), "representatives")
    at, name = free_name(docs, "v"), free_name(docs, "id")
    # A null key is compared like a value: two columns, one of them never null.
    rows_of = docs.withColumn(at, content_id(F.col(f"`{text}`")))
    keys = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null key"))
    rows_of = rows_of.withColumn(name, keys)
    wanted = chosen.select(F.col("v").alias(at), F.coalesce(F.col("id").cast("string"), F.lit("null key")).alias(name))
    return rows_of.join(wanted.hint("shuffle_hash"), [at, name], "left_semi").dropDuplicates([at, name]).select(*map(_named, docs.columns))


def _named(column: str) -> Column:
    return F.col(f"`{column}`")
