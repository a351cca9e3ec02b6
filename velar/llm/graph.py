"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _signature(edges: DataFrame) -> tuple:
    """Row count and an order-free hash: two numbers, whatever the size of the graph."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another one.

    Edges are undirected; loops and repeats don't matter; an edge with a null end links nothing. No edges: no rows.
    Each round halves the distance to the root, so that rounds grow with the logarithm of the diameter. A hub is a
    hot key of a grouped minimum, which combines before the shuffle, and of a join, which adaptive execution splits.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = written(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(hi.alias("u"), lo.alias("v"))
        .distinct()
    )
    sign = _signature(now)
    for _ in range(rounds):
        if not sign[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        now = written(small)
        last, sign = sign, _signature(now)
        if last == sign:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), "component").unionByName(roots)
