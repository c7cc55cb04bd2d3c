"""Connected components of an edge table, for the operators that link documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmart.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b): longs. Returns (node, root) for every node of an edge, `root` the smallest node it reaches.

    Large-star and small-star steps take turns until the edges stop changing: each hangs the neighbours of a node on
    the smallest of them, so the number of rounds follows the logarithm of the longest path. Every round is written.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, before = written(pairs, "edges"), None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a")
        star = hung.select("a", F.col("m").alias("b")).union(hung.select(F.col("b").alias("a"), F.col("m").alias("b")))
        pairs = written(star.where("a <> b").distinct(), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
