"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node and root (the least node of its component) for every node that is
    not a root. ``edges``: a, b of one orderable type, in any direction.

    Alternates large-star and small-star steps until every edge points at its
    root, O(log^2 n) rounds. Each round is written to the shared folder, so the
    plan stays short and a lost executor repeats one round at most. Only a count
    and a checksum come to the driver.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = materialize(e, "edges"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(lower.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        discard(e)
        e = after
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
