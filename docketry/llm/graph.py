"""Connected components of a large edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import written

MAX_ROUNDS = 60
SALTS = 16  # tasks that the neighbours of one node are dealt over


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node of every node's component, for ``n`` nodes held in memory."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link neighbours to the smallest of a node's neighbourhood.

    With ``both_ways`` every node moves its larger neighbours; else every node moves
    itself and its smaller neighbours.
    """
    if both_ways:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # a node's neighbours are dealt over salts, so that those of a hot one do not meet in one task
    near = near.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    salted = near.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = salted.groupBy("u").agg(F.min("m").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(salted.select("u", "salt").join(least, "u"), ["u", "salt"])
    if both_ways:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node on the larger side has one partner, which is on that side of no edge."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("larger")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("larger")))
    seen = sides.groupBy("node").agg(F.sum("larger").alias("n"), F.min("larger").alias("least"))
    return seen.where("n > 1 or (n = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """``node, root`` for every node of an edge (``u, v``, longs); the root is the smallest node reachable.

    Alternates large and small stars until the edges are stars, which takes a number of
    rounds that grows with the logarithm of the largest component. Every round is
    written to the shared folder. An empty table gives no rows.
    """
    current = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    for _ in range(MAX_ROUNDS):
        if _settled(current):
            break
        current = written(_stars(_stars(current, True), False), name)
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
