"""Joins beyond Spark's own: tolerance bands, cardinality of matches, snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.filters import within_band


def band_neighbours(rows: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(a_id, b_id): as band_pairs, but a row with a null value, which is within reach of every
    row, is given once, with a null b_id, instead of a pair with each: the table grows with the
    rows and the near pairs, and a reader that wants the pairs of one such row joins them."""
    near = band_pairs(rows.where(F.col(value).isNotNull()), key, value, tolerance)
    every = rows.where(F.col(value).isNull() & F.col(key).isNotNull())
    return near.unionByName(every.select(F.col(key).alias("a_id"), F.lit(None).cast(rows.schema[key].dataType).alias("b_id")))


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def near_pairs(left: DataFrame, right: DataFrame, tolerance: float, keep: Column, on: list[str]) -> DataFrame:
    """Rows of `left` (a_id, a_value, on) and `right` (b_id, b_value, on) with equal `on` and finite values within `tolerance`
    for which `keep` holds, by an equi-join on slots wider than the tolerance, one side in three of them, so that a pair meets once."""
    width = 1.25 * tolerance
    slot = F.floor(F.col("a_value") / width)
    placed = left.where(finite("a_value")).withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    held = right.where(finite("b_value")).withColumn("slot", F.floor(F.col("b_value") / width))
    keys = ["slot", *on]
    # A slot with very many rows is a grid of blocks of either side, each a task's work.
    crowded = F.broadcast(heavy_groups(placed.select(*keys).unionByName(held.select(*keys)), keys))
    deals = F.coalesce("_deals", F.lit(1))

    def gridded(side: DataFrame, k: str, own: str, other: str) -> DataFrame:
        dealt = side.join(crowded, keys, "left").withColumn(own, F.pmod(F.xxhash64(k), deals).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")

    met = gridded(placed, "a_id", "_i", "_j").join(gridded(held, "b_id", "_j", "_i"), [*keys, "_i", "_j"])
    return met.where(keep & within_band(F.col("a_value"), F.col("b_value"), tolerance)).drop("slot", "_i", "_j")


def class_pairs(rows: DataFrame, key: str, value: str, same: str, tolerance: float) -> DataFrame:
    """(a_id, b_id, distance), a < b: rows with equal `same` and values within `tolerance`, told by classes of rows with
    equal values: every pair of the classes' least keys, and each other member with its class's least key (distance 0).

    Vertices, components and the greatest distance of a component are those of all pairs; the table grows with the rows and the
    pairs of different values. Rows with a null in key, value or `same` have no pairs. `rows` is read several times."""
    given = rows.select(F.col(key).alias("b_id"), F.col(value).alias("b_value"), F.col(same).alias("_same")).where("b_id is not null and _same is not null").where(finite("b_value"))
    first = given.groupBy("_same", "b_value").agg(F.min("b_id").alias("a_id"), F.count("*").alias("_n"))
    several = first.where("_n > 1").drop("_n")
    members = dealt_join(given, several, ["_same", "b_value"], ["b_id"]).where("a_id <> b_id").select("a_id", "b_id", F.lit(0.0).alias("distance"))
    a = first.select("a_id", F.col("b_value").alias("a_value"), "_same")
    b = first.select(F.col("a_id").alias("b_id"), "b_value", "_same")
    met = near_pairs(a, b, tolerance, F.col("a_id") < F.col("b_id"), ["_same"])
    return met.select("a_id", "b_id", F.abs(F.col("a_value") - F.col("b_value")).alias("distance")).unionByName(members)


#: Pairs of a null value and a row that a task makes, about, and the most tasks that these are dealt over.
NULL_PAIRS, NULL_DEALS = 1 << 25, 4096


def null_deals(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_slots, _l, _ln, _r, _rn), one row: over how many deals the pairs with a null on either side are spread; rows and nulls of either side."""
    of = lambda side, c, n: side.agg(F.count("*").alias(f"_{n}"), F.count_if(F.col(c).isNull()).alias(f"_{n}n"))
    sizes = of(left, "a_value", "l").crossJoin(F.broadcast(of(right, "b_value", "r")))
    pairs = (F.col("_ln").cast("double") * F.col("_r") + F.col("_rn").cast("double") * F.col("_l")) / NULL_PAIRS
    slots = F.least(F.greatest(F.ceil(pairs), F.lit(16)), F.lit(NULL_DEALS)).cast("int")
    return sizes.select(slots.alias("_slots"), "_l", "_ln", "_r", "_rn")


def dealt_cross(nulls: DataFrame, rows: DataFrame, null_key: str, row_key: str, n_nulls: int, n_rows: int, tasks: int) -> DataFrame:
    """Every row of `nulls` with every one of `rows`, by a grid of about `tasks` cells, each of them one task: the partition is the
    cell, so that adaptive execution, which goes by the few bytes that are shuffled, puts no cells together."""
    across = min(tasks, max(1, round((tasks * n_rows / n_nulls) ** 0.5)))
    down = -(-tasks // across)

    def celled(side: DataFrame, own: Column, other: int, cell: Column) -> DataFrame:
        placed = side.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        return placed.withColumn("_cell", cell.cast("int")).drop("_own", "_other").repartitionById(across * down, F.col("_cell"))

    of = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n))
    few = celled(nulls, of(null_key, down), across, F.col("_other") * down + F.col("_own"))
    many = celled(rows, of(row_key, across), down, F.col("_own") * down + F.col("_other"))
    return many.join(few.hint("shuffle_hash"), "_cell").drop("_cell")  # a cell's nulls are held by hash, its rows pass by


def band_pairs(rows: DataFrame, key: str, value: str, tolerance: float, fresh: DataFrame | None = None) -> DataFrame:
    """(a_id, b_id): pairs of keys whose values are within `tolerance`, by an equi-join on buckets.

    Without `fresh` all pairs a < b of `rows`; with it, pairs of a fresh and another row. A slot of values that holds very many
    rows (equal values, say) is dealt over tasks. A null value is within reach of every row: those pairs are asked for by
    the operator, and are dealt over more tasks the more of them there are, which a count of the rows tells when this is called. NaN
    and infinite values behave as in comparisons of doubles: they are within no band. Rows with a null key are dropped."""
    left = (rows if fresh is None else fresh).select(F.col(key).alias("a_id"), F.col(value).alias("a_value")).where("a_id is not null")
    right = rows.select(F.col(key).alias("b_id"), F.col(value).alias("b_value")).where("b_id is not null")
    order = F.col("a_id") < F.col("b_id") if fresh is None else F.col("a_id") != F.col("b_id")
    out = near_pairs(left, right, tolerance, order, []).select("a_id", "b_id")
    told = null_deals(left, right).first()
    null_left, null_right = told["_ln"] * told["_r"], told["_rn"] * (told["_l"] - told["_ln"])
    share = lambda n: max(1, -(-told["_slots"] * n // (null_left + null_right)))
    if null_left:
        met = dealt_cross(left.where("a_value is null").select("a_id"), right.select("b_id"), "a_id", "b_id", told["_ln"], told["_r"], share(null_left))
        out = out.union(met.where(order).select("a_id", "b_id"))
    if null_right:
        met = dealt_cross(right.where("b_value is null").select("b_id"), left.where("a_value is not null").select("a_id"), "b_id", "a_id", told["_rn"], told["_l"] - told["_ln"], share(null_right))
        out = out.union(met.where(order).select("a_id", "b_id"))
    return out


def match_cardinality(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, order: str) -> DataFrame:
    """(left_id, n_matches, match, candidates): how many rows of `right` each left row's key
    meets: none, one (pending) or several (ambiguous, their ids joined in catalogue order)."""
    ids = right.groupBy(key).agg(
        F.count("*").alias("n_matches"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(right_id).alias("v")))), lambda x: x["v"].cast("string")), ",").alias("candidates"),
    )
    met = left.select(left_id, key).join(ids, key, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return met.select(
        left_id, "n_matches",
        F.when(F.col("n_matches") == 0, "none").when(F.col("n_matches") == 1, "pending").otherwise("ambiguous").alias("match"), "candidates",
    )


def match_status(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, n_matches, match, single): how many rows of `right` a left row's key meets, and
    which one it is where there is one. No list travels; see match_members."""
    met = right.groupBy(key).agg(F.count("*").alias("n_matches"), F.min(right_id).alias("_least"))
    rows = dealt_join(left.select(left_id, key), met, [key], [left_id], "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    match = F.when(F.col("n_matches") == 0, "none").when(F.col("n_matches") == 1, "pending").otherwise("ambiguous")
    return rows.select(left_id, "n_matches", match.alias("match"), F.when(F.col("n_matches") == 1, F.col("_least")).alias("single"))


def match_members(right: DataFrame, key: str, right_id: str) -> DataFrame:
    """(key, right_id): the candidates of every ambiguous key, once per key and not per left row,
    as rows, so that a key of very many candidates is no large value."""
    several = right.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return right.join(several, key, "left_semi").select(key, right_id)


def snapshot_diff(listing: DataFrame, stored: DataFrame, key: str, compared: list[str], removable: Column | None = None) -> DataFrame:
    """(key, change): added, updated, unchanged or removed for every key of either side.

    Compared columns differ null-safely. Stored rows that are not `removable` (an expression
    over stored columns) and vanished are `kept`."""
    free = F.lit(True) if removable is None else removable
    new = listing.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in compared))
    old = stored.select(key, F.lit(True).alias("_old"), free.alias("_free"), *(F.col(c).alias(f"_old_{c}") for c in compared))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"_new_{c}").eqNullSafe(F.col(f"_old_{c}"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull() & F.col("_free"), "removed")
        .when(F.col("_new").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    )
    return new.join(old, key, "full_outer").select(key, change.alias("change"))


#: A group of more than one MOST_HEAVY-th of all rows is dealt over tasks: there are fewer than
#: MOST_HEAVY such groups in any table. Groups of up to LIGHT rows never are.
MOST_HEAVY, LIGHT = 8192, 1024


def heavy_groups(rows: DataFrame, on: list[str]) -> DataFrame:
    """(on, _deals): the groups of `rows` that are dealt over tasks, and over how many; fewer than MOST_HEAVY rows."""
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))  # one row
    share = F.greatest(F.col("_total") / MOST_HEAVY, F.lit(float(LIGHT)))
    return sizes.crossJoin(F.broadcast(total)).where(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / share).cast("int").alias("_deals"))


def dealt_join(rows: DataFrame, groups: DataFrame, on: list[str], spread: list[str], how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """`rows` joined (inner or left) to `groups`, which has one row for each `on`, so that a key with very many rows
    does not meet in one task: its rows are dealt by the hash of `spread`, and its row of `groups` is repeated for each deal.

    `rows` is read twice and so should be a stored or cheap table; `heavy` may hold `heavy_groups` of it. Rows with a null in
    `on` are dropped by an inner join and pass by with nulls in a left one, as in Spark's own."""
    heavy = F.broadcast(heavy_groups(rows, on) if heavy is None else heavy)
    dealt = rows.join(heavy, on, "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_deals")), F.lit(0)).cast("int")).drop("_deals")
    copies = groups.join(heavy, on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    return dealt.join(copies, [*on, "_deal"], how).drop("_deal")


def prefer(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The row of each key with the least `order` (ascending expressions, nulls first; numbers
    are negated to prefer great ones); the order must end in a unique column.

    An aggregate, so each task sends one row a key, however many rows a key has."""
    others = [c for c in rows.columns if c not in key]
    ranks = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*others), ranks).alias("_best"))
    return best.select(*key, "_best.*").select(*rows.columns)
