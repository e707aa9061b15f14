"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.session import discard, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each number in ``links`` (a, b); a component is its least number.

    Large-star and small-star steps in turn: every node's neighbours are hung on the
    least of them, until nothing moves. A round is two aggregations and two joins by
    node, whose skew joins can split; rounds grow with the logarithm of the longest
    chain. Each round is written to the shared folder. Links of a node with itself
    or with null, and repeated links, add nothing.
    """
    greater, least = F.greatest("a", "b"), F.least("a", "b")
    start = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(start.select(greater.alias("a"), least.alias("b")).distinct(), "component-links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("of", "m").alias("m"))
        large = both.filter("b > a").join(nearest, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a != b").distinct(), "component-large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
        moved = large.join(lowest, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        kept = lowest.select(F.col("of").alias("a"), F.col("m").alias("b"))
        before, edges = edges, written(moved.unionByName(kept).distinct(), "component-links")
        discard(before, large)
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select("b").distinct()
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
    found._written_path = edges._written_path  # so that a caller who is done with it can discard it
    return found
