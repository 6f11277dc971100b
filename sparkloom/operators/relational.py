"""Ledger reads: filters, pages, latest rows, ordered selections, sequences and sinks' upserts, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(df: DataFrame, order: list[Column], limit: int, where: Column | None = None) -> DataFrame:
    """The first rows in an order; at least one."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(max(1, limit))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the number of all rows on each of its rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The greatest row of each key by these columns: an aggregate, which needs no sort and is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "sequence_no") -> DataFrame:
    """Dense numbers from 1 by key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def after(df: DataFrame, sequence_no: int, order: str = "sequence_no") -> DataFrame:
    return df.where(F.col(order) > sequence_no)


def ordered_selection(df: DataFrame, key: str, ids: list, limit: int | None = None) -> DataFrame:
    """The rows with these ids in the ids' order, first mention counts; position tells the order. The list is a caller's literal."""
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(ids))], f"position long, {key} {df.schema[key].dataType.simpleString()}")
    out = df.join(F.broadcast(wanted), key)
    return out.orderBy("position").limit(limit) if limit else out


def missing_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The ids of a selection that no row has."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], f"{key} {df.schema[key].dataType.simpleString()}")
    return wanted.join(df.select(key), key, "left_anti")


def histogram(df: DataFrame, by: Column, name: str) -> DataFrame:
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n"))


def top_groups(df: DataFrame, keys: list[Column], names: list[str], limit: int) -> DataFrame:
    """The commonest groups; ties by key."""
    counted = df.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), *[F.asc_nulls_first(n) for n in names]).limit(limit)


def most_common(df: DataFrame, value: str, order: str, limit: int) -> DataFrame:
    """The commonest values; ties go to the one that came first."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_at")).orderBy(F.desc("n"), "first_at", value).limit(limit)


def keep_best(evidence: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """One row per key with its greatest score."""
    return evidence.groupBy(*keys).agg(F.max(score).alias(score))
