"""Connected components by alternating large-star and small-star contraction.

Every round is two aggregations and two joins on plain exchanges and ends in a
written table, so lineage stays short and lost executors cost one round. Up to
``ONE_TASK`` edges, which are counted, are one task's work. Only
counts come to the driver. Neighbours are never gathered: each node needs its
smallest neighbour alone, which partial aggregation gives even for a node with
a third of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .oneroom import ONE_TASK, components, in_one_task

MAX_ROUNDS = 60

def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges(a, b)`` of longs: label is the smallest node it reaches.

    Direction, repeated edges, self-edges and edges with a null end don't
    matter; a node whose only edge is to itself isn't returned. An empty input
    gives an empty result.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = written(now.distinct(), "cc")
    seen = _print_of(now)
    if seen[0] <= ONE_TASK:
        return in_one_task(now, components, "node long, label long")
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "cc-large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").filter("a <> b").distinct(), "cc")
        was, seen, now = seen, _print_of(after), after
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
