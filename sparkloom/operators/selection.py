"""Selections with quotas: per source, round robin and priority fronts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows per key."""
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank_in_group") <= k)


def round_robin(df: DataFrame, task: list[str], group: str, order: list[Column]) -> DataFrame:
    """position: first of each group, then second of each, groups by their first row. order must be total in a task."""
    own = Window.partitionBy(*task).orderBy(*order)
    numbered = df.withColumn("_at", F.row_number().over(own))
    in_group = Window.partitionBy(*task, group).orderBy("_at")
    numbered = numbered.withColumn("_turn", F.row_number().over(in_group)).withColumn("_first", F.min("_at").over(Window.partitionBy(*task, group)))
    return numbered.withColumn("position", F.row_number().over(Window.partitionBy(*task).orderBy("_turn", "_first")).cast("long")).drop("_at", "_turn", "_first")


def front(df: DataFrame, task: list[str], first: Column, order: list[Column], k: int) -> DataFrame:
    """position: the first k rows that must come first, then all others in their order."""
    marked = df.withColumn("_must", first).withColumn("_n", F.row_number().over(Window.partitionBy(*task, "_must").orderBy(*order)))
    lead = F.when(F.col("_must") & (F.col("_n") <= k), 0).otherwise(1)
    return marked.withColumn("position", F.row_number().over(Window.partitionBy(*task).orderBy(lead, *order)).cast("long")).drop("_must", "_n")


def domain_penalty(hits: DataFrame, task: list[str], domain: str, order: list[Column]) -> DataFrame:
    """.06 for each hit of the domain before this one, .18 at most."""
    before = F.row_number().over(Window.partitionBy(*task, domain).orderBy(*order)) - 1
    return hits.withColumn("prior_same_domain", before.cast("long")).withColumn("penalty", F.least(F.lit(0.18), before * 0.06))
