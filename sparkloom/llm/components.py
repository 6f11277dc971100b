"""Connected components by alternating stars: each round is a few joins and grouped minima over the edges, written in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize


def connected(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, comp) for every id in the edges (x, y); comp is the smallest id that can be reached. No row for ids without an edge."""
    now = materialize(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "components")
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least")
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        # Small star: smaller neighbours and the node itself do.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        was, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
