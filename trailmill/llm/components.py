"""Connected components of a distributed edge list.

Alternating large-star and small-star steps: every step replaces an edge by one
towards a smaller neighbour, and ends with stars around the smallest node of
each component after O(log^2) rounds.  All steps are groupings and joins, so
hubs are pre-aggregated and their joins can be split; each half round is
written to the shared folder, and so is the smallest neighbour of each node, so that the
joins read plain shuffles and Spark can split a hub.  Lineage stays short and
survives lost executors; the tables of a half round go once the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm._scratch import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "components-least")
    joined = both.filter("v > u").join(least, F.col("u") == F.col("n"))
    found = written(joined.select(F.col("v").alias("u"), F.least("m", "n").alias("v")).distinct(), "components")
    dropped(least, edges)
    return found


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node."""
    least = written(edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "components-least")
    joined = edges.join(least, F.col("u") == F.col("n")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    found = written(joined.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "components")
    dropped(least, edges)
    return found


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long nodes to (node, root), the smallest node, for every node but the roots themselves."""
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(pairs, "components")
    state = _state(now)
    while True:
        now = _large_star(now)
        before, state = state, _state(now)
        if state == before:  # stars already: neither step changes them
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = _small_star(now)
        state = _state(now)
