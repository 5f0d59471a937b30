"""Connected components of a graph given as an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, tasks: int | None = None, rounds: int = 60) -> DataFrame:
    """edges: (a long, b long). Returns (node, root): the smallest node that each node reaches.

    Alternates the large-star and small-star steps, which keep every node's links few: after
    each pair of steps the edge table is written, and the search ends when a pair changes
    nothing. A hub's neighbours are only reduced to their minimum, never gathered.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = both.join(least, "u").filter("v > m" if not large else "v > u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        if not large:
            linked = linked.unionByName(least.filter("u > m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return linked.filter("a > b").distinct()

    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges", tasks)
    state = None
    for _ in range(rounds):
        edges = written(star(star(edges, True), False), "edges", tasks)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
