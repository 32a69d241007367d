"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut_lineage


def _large_star(edges: DataFrame, within: Sequence[str]) -> DataFrame:
    turned = edges.select(*within, F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.select(*within, "u", "v").union(turned)
    low = both.groupBy(*within, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(low, [*within, "u"]).where(F.col("v") > F.col("u"))
    return linked.select(*within, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, within: Sequence[str]) -> DataFrame:
    down = edges.select(*within, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy(*within, "u").agg(F.min("v").alias("m"))
    linked = down.join(low, [*within, "u"]).where(F.col("v") != F.col("m"))
    moved = linked.select(*within, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select(*within, "u", F.col("m").alias("v"))).distinct()


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", within: Sequence[str] = ()
) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    Each round halves the distance to the smallest node or better and is
    checkpointed, so the plan stays short and a lost executor costs one round.
    With columns ``within``, which come first in the result, their values are graphs of
    their own that are contracted in the same rounds.
    """
    current = cut_lineage(
        edges.select(
            *within, F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")
        )
        .where("u <> v")
        .distinct()
    )
    mark = None
    while True:
        current = cut_lineage(_small_star(_large_star(current, within), within))
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*within, "u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    members = current.select(*within, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = members.select(*within, "component").distinct().select(
        *within, F.col("component").alias("node"), "component"
    )
    return members.union(roots)
