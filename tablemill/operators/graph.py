"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators import joins
from tablemill.storage import scratch, stash


def components(edges: DataFrame, a: str = "a_id", b: str = "b_id", max_rounds: int = 60) -> DataFrame:
    """(id, component): every vertex of `edges` with the smallest id it is connected to.

    Each round takes the smallest label among the neighbours (aggregated before the shuffle) and then
    jumps to that label's own label, which halves long chains. Edges of a vertex with very many are dealt
    over tasks, each with the vertex's label; where no vertex (or no label) has so many, the plain join keeps plans small.
    Only the number of vertices, whether any is a hub, and whether a label changed come to the driver.
    Null ends are dropped, self-edges keep their vertex, no edges give no rows."""
    with scratch(edges.sparkSession) as keep:
        pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna().distinct()
        both = stash(pairs.union(pairs.select("y", "x")).distinct(), "edges")
        hubs = stash(joins.heavy_groups(both, ["y"]), "hubs")
        labels = both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("component"))
        labels = keep(labels, "labels")
        dealt, vertices = hubs.limit(1).count(), labels.count()
        for _ in range(max_rounds):
            told = labels.select(F.col("id").alias("y"), F.col("component").alias("c"))
            met = joins.dealt_join(both, told, ["y"], ["x"], heavy=hubs) if dealt else both.join(told, "y")
            near = met.groupBy(F.col("x").alias("id")).agg(F.min("c").alias("c"))
            hop = stash(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("c")), "hop")
            jump = labels.select(F.col("id").alias("c"), F.col("component").alias("far"))
            # Very many vertices may have one label: these rows are dealt as well.
            crowds = stash(joins.heavy_groups(hop, ["c"]), "crowds") if vertices > joins.LIGHT else None
            far = joins.dealt_join(hop, jump, ["c"], ["id"], "left", heavy=crowds) if crowds is not None and crowds.limit(1).count() else hop.join(jump, "c", "left")
            moved = keep(far.select("id", "old", F.least("c", "far").alias("component")), "moved")
            changed = moved.where("old <> component").limit(1).count()
            labels = moved.select("id", "component")
            if not changed:
                return labels
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
