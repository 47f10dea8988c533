"""Consolidating pairwise matches into groups: alternating large-star and small-star rewrites.

Large-star links every larger neighbour of a node to the least node around it; small-star does the same with the smaller
neighbours. Repeated until the edges no longer change, every record hangs on the least identifier of its component.
Each rewrite is one partial aggregation and one join; edges of hub nodes meet their minimum by broadcast, as there can be only
few nodes with more than a fixed share of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.plans.materialize import materialize, release

#: A node with more than this share of all edges is a hub; there are at most twice the inverse of it. With fewer edges than
#: MIN_HUB_EDGES no node is worth a plan of its own; the result is the same.
HUB_SHARE = 1 / 2000
MIN_HUB_EDGES = 20_000


def _with_least(edges: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """Adds ``m``, the least of ``u`` and its neighbours ``v``, to every edge (u, v); and the tables that this needs."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    limit = max(MIN_HUB_EDGES, int(total * HUB_SHARE))
    if total <= limit:
        return edges.join(least.drop("n"), "u"), []
    hubs = materialize(least.where(F.col("n") > limit).drop("n"))
    if hubs.isEmpty():
        return edges.join(least.drop("n"), "u"), [hubs]
    named = F.broadcast(hubs)
    return edges.join(named, "u").unionByName(edges.join(named, "u", "left_anti").join(least.where(F.col("n") <= limit).drop("n"), "u")), [hubs]


def _round(edges: DataFrame, total: int) -> DataFrame:
    """Large-star, then small-star; ``moved`` tells of edges that came from another place, without any the stars are done."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked, first = _with_least(both, 2 * total)
    large = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
    # every edge leads from the greater to the least now
    linked, second = _with_least(large, total)
    off = F.col("v") != F.col("m")
    pair = F.when(off, F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct("u", F.col("m").alias("v"))))
    small = linked.select(F.explode(pair).alias("e"), (F.col("moved") | off).alias("moved")).select("e.u", "e.v", "moved").where("u <> v")
    fresh = materialize(small.groupBy("u", "v").agg(F.max("moved").alias("moved")))
    release(*first, *second)
    return fresh


def connected_components(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """``(record_id, group_id)`` of every record in a pair; ``group_id`` is the least record identifier of the component.

    Rows without one of both identifiers are left out; empty strings count as missing; self pairs make a record a group of
    its own unless other pairs link it; repeated and turned-round pairs change nothing; an empty table gives no
    rows; other columns are not read. Identifiers are compared as they are written.
    """
    ids = pairs.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v"))
    ids = materialize(ids.where("u is not null and v is not null and trim(u) <> '' and trim(v) <> ''").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    selves = ids.where("u = v").select("u")
    edges = ids.where("u <> v")
    total, before = edges.count(), None
    while total:
        edges = _round(edges, total)
        if before is not None:
            release(before)
        before = edges
        if edges.where("moved").isEmpty():
            break
        total = edges.count()
    grouped = edges.select(F.col("u").alias("record_id"), F.col("v").alias("group_id"))
    roots = edges.select(F.col("v").alias("record_id")).distinct().withColumn("group_id", F.col("record_id"))
    linked = grouped.unionByName(roots)
    alone = selves.select(F.col("u").alias("record_id")).join(linked.select("record_id"), "record_id", "left_anti")
    return linked.unionByName(alone.withColumn("group_id", F.col("record_id")))
