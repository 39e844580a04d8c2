"""Connected components of links that stay in Spark: large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gazette.scale import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node reachable.

    Nulls and links of a node with itself are left out. Every round is written to
    the shared folder; the number of rounds grows with the logarithm of the
    longest chain. A node of very many links meets only its minimum, joined.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(pairs, "links")
    state = _state(pairs)
    while state[0]:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the larger end of each link has its smaller neighbours.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        pairs = written(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(pairs)
        if state == before:
            break
    roots = pairs.select("b").distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
