"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of edges (u, v), both long; component is the least node reachable.

    Neighbourhoods are never gathered: each step takes a minimum per node (combined before the
    shuffle) and joins it back. Lineage is cut each round; ends when a round changes nothing."""
    e = checkpointed(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").distinct()
        large = large.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").unionByName(low.selectExpr("u", "m AS v"))
        e = checkpointed(small.where("u <> v").distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("the components haven't settled")
    found = e.selectExpr("u AS node", "v AS component")
    return found.unionByName(e.selectExpr("v AS node", "v AS component").distinct())
