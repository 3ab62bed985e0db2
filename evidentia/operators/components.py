"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import cut

#: Rounds after which the search gives up. Each round at least halves the longest remaining paths of roots.
MOST_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    """The number of distinct links and the exclusive or of their hashes: equal for equal sets."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node of it) for every node of the edges.

    Alternates large-star and small-star steps: every node points to smaller ones until each points to the least. Both are
    group-by-node steps with map-side minimum, so a node with many edges is no hot spot beyond its own rows. NULL ends are
    left out; self-loops give components of one.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = cut(both.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    now = cut(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        # Large star: each larger neighbour of u is linked to the least of u and its neighbours.
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: u and its smaller neighbours are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small_star = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small_star.where("u <> v").distinct())
        seen, state = state, _state(after)
        if seen == state:
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    if nodes.isEmpty():
        return spark.createDataFrame([], nodes.schema.add("component", nodes.schema["node"].dataType))
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
