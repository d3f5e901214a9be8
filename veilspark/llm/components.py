"""Connected components by alternating large-star and small-star steps; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import discard, materialized


def components(edges: DataFrame) -> DataFrame:
    """``edges`` ``(a, b)`` of longs to ``(node, root)``: every node that has an edge, and the least node of its component.

    Loops and repeated edges are allowed; no edges give no rows. Only counts and checksums reach the driver. Rows are two
    numbers; where the edges of one root make a partition too large, adaptive execution splits it.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held: list[str] = []
    e, seen = materialized(start, "edges", held), None
    while True:
        n, check = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not n or (n, check) == seen:
            break
        seen = (n, check)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(low, "u")
        last, held = held, []
        e = materialized(
            small.where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).union(low.select("u", F.col("w").alias("v"))).distinct(), "edges", held
        )
        discard(edges.sparkSession, last)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
