"""Connected components of an edge table by alternating large-star and small-star steps.

Large star: every node sends its larger neighbours to the least of its neighbourhood. Small star: every node sends its
smaller neighbours and itself there. Both shrink the diameter, so the number of rounds follows its logarithm. The least
neighbour comes from a combining aggregation and a join that adaptive execution may split, so a node with very many edges
is no single task; each round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _least(edges: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """id and component (the least id reachable) of every id that has an edge to another."""
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialise(links, "links")
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
