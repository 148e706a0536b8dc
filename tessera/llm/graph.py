"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """The smallest node that each node of ``edges(a, b)`` can reach.

    Returns ``(node, component)`` for every node with an edge to another node;
    loops (a = b), repeated edges and nulls add nothing, and no edges give an
    empty table. Each round minimises over the neighbours of a node with
    map-side combining and joins the minimum back; both join sides are read
    from files, so that an executor's loss costs one round and the runtime can
    split a hub's partition.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = scratch.keep(e)
    before = _signature(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of u hangs on u's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        big = (
            both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        big = scratch.keep(big)
        # small star: u's smaller neighbours, and u, hang on the smallest of them
        low = scratch.keep(big.groupBy("u").agg(F.min("v").alias("m")))
        linked = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.keep(linked.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
