"""Funnels, yields, gaps, and what a report is made of: manifests, versions and Markdown lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def funnel(steps: dict[str, DataFrame]) -> DataFrame:
    """(step, n): the rows of each table. Each is one pass over the columns its own plan reads."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n") for name, df in steps.items()))


def rates(counts: DataFrame, of: dict[str, tuple[str, str]]) -> DataFrame:
    """One row with a share per name: part by whole, null if the whole is empty, else to six places."""
    value = lambda s: F.max(F.when(F.col("step") == s, F.col("n")))
    return counts.agg(*[F.when(value(whole) > 0, F.round(value(part) / value(whole), 6)).alias(name) for name, (part, whole) in of.items()])


def first_that_holds(*ladder: tuple[Column, str], rest: str | None = None) -> Column:
    """The name of the first condition that holds."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for holds, name in ladder], F.lit(rest))


def expand_queries(queries: DataFrame, key: str, text: str, domains: list[str], most: int) -> DataFrame:
    """Each query and its restrictions to domains: blank domains go, equal texts (by case) count once, at most `most`."""
    named = list(dict.fromkeys(d.strip().lower() for d in domains if d.strip()))
    base = F.trim(F.col(text))
    kinds = F.array(F.struct(F.lit(0).alias("position"), F.lit("base").alias("kind"), base.alias("query")), *[F.struct(F.lit(i).alias("position"), F.lit("site").alias("kind"), F.concat(F.lit(f"site:{d} "), base).alias("query")) for i, d in enumerate(named, 1)])
    return queries.where(base != "").select(key, F.inline(F.slice(kinds, 1, most)))


def supplemental(slots: DataFrame, variants: list[str], existing: DataFrame, limit: int) -> DataFrame:
    """Queries for required slots that are missing (first) or weak, without those asked before. slots: slot_id, required, status; existing: query."""
    open_ = slots.where("required and status in ('missing', 'weak')")
    asked = open_.select("slot_id", "status", F.posexplode(F.array(*map(F.lit, variants))).alias("at", "variant"))
    new = asked.select("slot_id", "status", "at", F.concat_ws(" ", "slot_id", "variant").alias("query")).join(existing.select("query"), "query", "left_anti")
    return new.orderBy(F.col("status") == "weak", "at", "slot_id").limit(max(1, limit)).select("slot_id", "status", "query")


def manifest(claims: DataFrame, by: str, id_col: str, block: int = 1000) -> DataFrame:
    """Every id of every status: a row per block of ids (block: id div `block`) with the ids in order and their digest, and per status the number of claims and
    content_hash, the digest of its blocks' digests. Digests are digested by `block` blocks first, so no status is gathered in one place. id_col: a number, each id once a status."""
    digest = lambda x: F.concat(F.lit("sha256:"), F.sha2(x, 256))
    ordered = lambda value, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ",")
    blocks = claims.withColumn("block", F.floor(F.col(id_col) / block)).groupBy(by, "block").agg(F.count("*").alias("n"), ordered(id_col, id_col).alias("ids"))
    blocks = blocks.withColumn("block_hash", digest(F.col("ids")))
    upper = blocks.groupBy(by, F.floor(F.col("block") / block).alias("upper")).agg(F.sum("n").alias("n"), digest(ordered("block_hash", "block")).alias("upper_hash"))
    whole = upper.groupBy(by).agg(F.sum("n").alias("claims"), digest(ordered("upper_hash", "upper")).alias("content_hash"))
    return blocks.join(whole, by)


def next_version(artifacts: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The version under which new content is stored: the latest one if its hash is the same, else the next. artifacts: keys, version, content_hash; new: keys, content_hash."""
    latest = artifacts.groupBy(*keys).agg(F.max_by("content_hash", "version").alias("_hash"), F.max("version").alias("_version"))
    found = new.join(latest, keys, "left")
    same = F.col("_hash") == F.col("content_hash")
    version = F.when(F.coalesce(same, F.lit(False)), F.col("_version")).otherwise(F.coalesce("_version", F.lit(0)) + 1)
    return found.select(*new.columns, version.cast("long").alias("version"), F.coalesce(same, F.lit(False)).alias("reused"))


def markdown(title: str, claims: DataFrame, by: str, text: str, id_col: str) -> DataFrame:
    """(section, part, position, line): a title, and per status a heading, its number of claims and every claim as a bullet. In the order of the first three columns the
    lines are the report; they are sorted when they are written, by as many tasks as it takes."""
    line = lambda section, part, position, x: [section.alias("section"), F.lit(part).alias("part"), position.cast("long").alias("position"), x.alias("line")]
    s = F.col(by)
    counts = claims.groupBy(by).agg(F.count("*").alias("n"))
    head = claims.sparkSession.range(1).select(*line(F.lit(""), 0, F.lit(0), F.lit(f"# {title}")))
    named = counts.select(*line(s, 0, F.lit(0), F.concat(F.lit("## "), s)))
    said = counts.select(*line(s, 1, F.lit(0), F.concat(F.col("n").cast("string"), F.lit(" claims"))))
    bullets = claims.select(*line(s, 2, F.col(id_col), F.concat(F.lit("- "), F.regexp_replace(text, r"\s+", " "), F.lit(" ["), F.col(id_col).cast("string"), F.lit("]"))))
    return reduce(DataFrame.unionByName, (head, named, said, bullets))
