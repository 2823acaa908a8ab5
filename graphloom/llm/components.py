"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stage, unstage


def _mark(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Only stars of one edge for each node are kept between rounds, in the shared folder; rounds grow with
    the logarithm of the longest path. Minima are pre-aggregated before they are shuffled, and the joins
    are plain equi-joins that adaptive execution can split at a hub. Self-loops and repeated edges are
    harmless; null ends are dropped; no edges give no rows.
    """
    cur = stage(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = _mark(cur)
    while seen[0]:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stage(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        mark = _mark(new)
        unstage(large)
        unstage(cur)
        cur, done, seen = new, mark == seen, mark
        if done:
            break
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
