"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node reachable; nodes without edges have no row.

    Each round hangs every node's larger neighbours below its smallest neighbour (large star), then its
    smaller ones below the smallest of them (small star). Both are a partial minimum per node and a join,
    so a hub's edges are combined map-side and its join partition can be split. Rounds grow with the
    logarithm of the longest chain. Every round is written to the shared folder; only two numbers a round
    reach the driver. Nulls, self-links and repeated edges are ignored; an empty table gives an empty one.
    """
    clean = (
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    links = written(clean, "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        both = links.unionByName(links.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        large = (
            both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        )
        large = written(large, "links")
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("low").alias("m"))
        links = written(small.where("v <> m").distinct(), "links")
    nodes = links.select(F.col("v").alias("node"), F.col("m").alias("component"))
    roots = links.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return nodes.unionByName(roots)
