"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces edges by edges to the least neighbour, until every node points to the least node that it reaches.
A step is two aggregations with partial minima, their joins and one distinct; the tables of minima are written, so a join
is one between two plain shuffles, whose hot nodes adaptive execution splits, or a broadcast where Spark finds the table small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import released, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) for every node of ``edges`` (a, b: long); loops are allowed."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null")
    now, steps = written(both, "edges"), 0
    while True:
        mirrored = now.union(now.select("b", "a"))
        least = written(mirrored.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "minima")
        # large star: neighbours greater than a node point to its least neighbour
        large = written(now.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"), (F.col("m") != F.col("b")).alias("moved")), "edges")
        released(now, least)
        # small star: a node and its lesser neighbours point to the least of them, or to where that one points
        own = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.max("b").alias("most"), F.max("moved").alias("moved")), "minima")
        # after a step every node has an edge; where none moved and each node has one target, all targets are least
        if steps and own.filter("moved or m <> most").isEmpty():
            released(large)
            return own.select(F.col("u").alias("node"), F.col("m").alias("component"))
        on = own.select(F.col("u").alias("t"), F.col("m").alias("next"))
        small = large.join(own.select("u", "m"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), "m").union(own.select("u", "m"))
        small = small.join(on, F.col("m") == F.col("t"), "left").select("a", F.coalesce("next", "m").alias("b")).distinct()
        now, steps = written(small, "edges"), steps + 1
        released(large, own)
