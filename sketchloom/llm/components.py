"""Connected components of an edge table, without collecting links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each node reaches; only nodes with an edge to another appear.

    Edges may repeat, lie either way round or join a node to itself; an edge with a null end counts as none; without edges the result is empty.

    Alternating large-star and small-star steps: every step links neighbours to their common
    minimum, so hubs shrink and the number of rounds is logarithmic.  Minima are partial aggregates, and the
    joins back on a hub are ordinary joins that adaptive execution can split.
    """
    now = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())  # a null end is dropped here too
    before = None
    while True:
        # large star: neighbours larger than u go to the least of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        fresh = scratch.keep(small)
        # a fixed point: the same links again, told by order-free sums of their hashes
        mark = fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        scratch.drop(now)
        now = fresh
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
