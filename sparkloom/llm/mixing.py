"""Mixing sources to target weights by Pareto order sampling.

Targets. The mix has `share` times the words of all documents. Sources in code point order, null last,
weigh `weights`, repeating; a source's target is its weight's part of the mix but at most `most_copies`
times its own words, and what that leaves over goes to the others by weight until none is above.
With targets min(most_copies * size, level * weight), the level is found from running sums over sources.

Taking. A source whose target is r times its size takes floor(r) whole copies of each document for certain.
The rest is a sample: every document gets odds of inclusion, (f / (1 - f)) times a tilt by its size (the
square root of its size by the source's mean, between 1/2 and 2), and a uniform number u from its id; documents
go in ascending order of (u / (1 - u)) / odds, as Pareto sampling ranks them, and the sample's fixed size is
counted in words: the longest run of that order that stays within the words still needed. One closing document,
of the size nearest to what is then missing, is added if that comes closer to the target.

Scale. A source may hold a third of all rows, so no task ranks a source. Scores fall into `buckets` equal steps
of a monotone function of the score; sums by source and bucket find the bucket in which the order is cut, the same again
inside that bucket the step, and only the documents of this step (some 1 in buckets squared) are ranked. What is ordered of a source otherwise is `buckets` sums. Decisions are thresholds by source: one row per source, joined back.

Defined cases: a null text has size 0; null ids count as the empty string; documents of size 0 follow the same
order and take no words; rows that agree in score and id are in or out together; a source without words has
target 0; an empty table gives no rows. Helper columns start with _mix_, so other names can't clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACE, SPACE_CHARS, WORD, materialize

U_DIGITS = 13  # hexadecimal: 52 bits, exact in a double


def uniform(id_col: Column, seed: str) -> Column:
    """In (0, 1), from the id alone, so reruns and lost tasks agree."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, U_DIGITS)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 4 * U_DIGITS)


def word_count(text: Column) -> Column:
    """The words of a text. Each, with the space behind it, becomes one letter: regexp_count would hold an array of all words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WORD}{SPACE[:-1]}*", "x")
    return F.length(F.ltrim(marks, F.lit(SPACE_CHARS))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_copies: int = 2) -> DataFrame:
    """Per source: _mix_source, source_size, docs, target. sizes: a row per source; its number bounds the windows."""
    order = Window.orderBy(F.asc_nulls_last("_mix_source"))
    n = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int"))
    capped = sizes.withColumn("_mix_w", weight).withColumn("_mix_cap", (F.col("source_size") * most_copies).cast("double"))
    before = Window.orderBy(F.col("_mix_cap") / F.col("_mix_w"), F.asc_nulls_last("_mix_source"))
    everything = Window.partitionBy()
    total, all_w = F.sum("source_size").over(everything) * share, F.sum("_mix_w").over(everything)
    done = lambda c: F.sum(c).over(before) - F.col(c)
    level = (total - done("_mix_cap")) / (all_w - done("_mix_w"))
    ranked = capped.withColumn("_mix_level", level).withColumn("_mix_at", F.row_number().over(before))
    fits = F.when(F.col("_mix_level") * F.col("_mix_w") <= F.col("_mix_cap"), F.struct("_mix_at", "_mix_level"))
    found = ranked.withColumn("_mix_found", F.min(fits).over(everything)["_mix_level"])
    return found.select("_mix_source", "source_size", "docs", F.least("_mix_cap", F.coalesce(F.col("_mix_found") * F.col("_mix_w"), "_mix_cap")).alias("target"))


def _score(size: Column, u: Column) -> Column:
    tilt = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.sqrt(size / F.col("_mix_mean"))))
    return (u / (1.0 - u)) / (F.col("_mix_odds") * tilt)


def _bucket(score: Column, buckets: int) -> Column:
    return F.floor((1.0 - 1.0 / (1.0 + score)) * buckets).cast("int")


def thresholds(base: DataFrame, weights: tuple[int, ...], share: float, most_copies: int, buckets: int) -> DataFrame:
    """Per source: target, whole copies, and where its sample ends. base: _mix_id, _mix_source, size, _mix_u."""
    sizes = base.groupBy("_mix_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ratio = F.col("target") / F.col("source_size")
    plan = targets(sizes, weights, share, most_copies)
    plan = plan.withColumn("_mix_whole", F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long"))
    plan = plan.withColumn("_mix_need", F.col("target") - F.col("_mix_whole") * F.col("source_size"))
    part = F.least(F.lit(1.0 - 2.0**-20), F.col("_mix_need") / F.col("source_size"))
    plan = plan.withColumn("_mix_odds", F.when(F.col("_mix_need") > 0, part / (1.0 - part)))
    plan = plan.withColumn("_mix_mean", F.col("source_size") / F.col("docs"))
    plan = materialize(plan.repartition(1), "mix-plan")  # a row per source
    scored = lambda p: _scored(base, p)

    # The bucket of the cut, then the step within it: `buckets` rows a source are ordered each time.
    plan = plan.withColumn("_mix_low", F.lit(0).cast("long"))
    for steps in (buckets, buckets * buckets):
        step = _bucket(F.col("_mix_score"), steps)
        rows = scored(plan).where("_mix_odds is not null")
        if steps > buckets:
            rows = rows.where(_bucket(F.col("_mix_score"), buckets) == F.col("_mix_cut_b"))
        sums = rows.withColumn("_mix_b", step).groupBy("_mix_source", "_mix_b", "_mix_need", "_mix_low").agg(F.sum("size").alias("_mix_s"))
        running = F.col("_mix_low") + F.sum("_mix_s").over(Window.partitionBy("_mix_source").orderBy("_mix_b"))
        cut = (sums.withColumn("_mix_cum", running).where("_mix_cum > _mix_need")
               .groupBy("_mix_source").agg(F.min_by(F.struct("_mix_b", (F.col("_mix_cum") - F.col("_mix_s")).alias("_mix_before")), "_mix_b").alias("_mix_c"))
               .select(F.col("_mix_source").alias("_mix_cs"), F.col("_mix_c._mix_b").alias("_mix_new_b"), F.col("_mix_c._mix_before").alias("_mix_new_low")))
        plan = plan.join(cut, F.col("_mix_source").eqNullSafe(F.col("_mix_cs")), "left").drop("_mix_cs", "_mix_cut_b", "_mix_low")
        plan = materialize(plan.withColumnsRenamed({"_mix_new_b": "_mix_cut_b", "_mix_new_low": "_mix_low"}).repartition(1), "mix-plan")
    buckets *= buckets

    at_cut = scored(plan).where(_bucket(F.col("_mix_score"), buckets) == F.col("_mix_cut_b"))
    inside = F.sum("size").over(Window.partitionBy("_mix_source").orderBy("_mix_score", "_mix_key").rangeBetween(Window.unboundedPreceding, 0))
    order = F.struct("_mix_score", "_mix_key")
    last = (at_cut.withColumn("_mix_cum", inside + F.col("_mix_low")).where("_mix_cum <= _mix_need")
            .groupBy("_mix_source").agg(F.max(F.struct(order.alias("o"), "_mix_cum")).alias("_mix_m"))
            .select(F.col("_mix_source").alias("_mix_ls"), F.col("_mix_m.o._mix_score").alias("_mix_last"), F.col("_mix_m.o._mix_key").alias("_mix_last_key"), F.col("_mix_m._mix_cum").alias("_mix_got")))
    plan = plan.join(last, F.col("_mix_source").eqNullSafe(F.col("_mix_ls")), "left").drop("_mix_ls")
    plan = plan.withColumn("_mix_missing", F.col("_mix_need") - F.coalesce("_mix_got", "_mix_low"))
    plan = materialize(plan.repartition(1), "mix-plan")

    off = F.abs(F.col("size") - F.col("_mix_missing"))
    close = (scored(plan).where(~_in_sample(buckets) & (off < F.col("_mix_missing")))
             .groupBy("_mix_source").agg(F.min(F.struct(off.alias("_mix_off"), "_mix_score", "_mix_key")).alias("_mix_m"))
             .select(F.col("_mix_source").alias("_mix_ks"), F.col("_mix_m._mix_score").alias("_mix_close"), F.col("_mix_m._mix_key").alias("_mix_close_key")))
    plan = plan.join(close, F.col("_mix_source").eqNullSafe(F.col("_mix_ks")), "left").drop("_mix_ks")
    return materialize(plan.repartition(1), "mix-plan")


def _scored(base: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its source's plan and its score. The plan is a small table whose size Spark knows: it is broadcast below the session's limit."""
    plan = plan.withColumnRenamed("_mix_source", "_mix_ps").drop("docs")  # base may have a column of that name
    joined = base.join(plan, F.col("_mix_source").eqNullSafe(F.col("_mix_ps"))).drop("_mix_ps")
    return joined.withColumn("_mix_score", _score(F.col("size"), F.col("_mix_u"))).withColumn("_mix_key", F.coalesce(F.col("_mix_id").cast("string"), F.lit("")))


def _in_sample(buckets: int) -> Column:
    """Whether the order reaches the row: before the bucket of the cut, or in it up to the last one taken. Without a cut all are."""
    b, cut = _bucket(F.col("_mix_score"), buckets), F.col("_mix_cut_b")
    to_last = (F.col("_mix_score") < F.col("_mix_last")) | ((F.col("_mix_score") == F.col("_mix_last")) & (F.col("_mix_key") <= F.col("_mix_last_key")))
    return F.col("_mix_odds").isNotNull() & (cut.isNull() | (b < cut) | ((b == cut) & F.coalesce(to_last, F.lit(False))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_copies: int = 2, seed: str = "mix", buckets: int = 4096,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = True) -> DataFrame:
    """docs (only id_col and source_col if not keep) with size, source_size, target and copies, the times the mix takes each row."""
    sized = docs.select(
        F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"), word_count(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("_mix_u")
    )
    base = materialize(sized.hint("rebalance"), "mix-base")  # some 40 bytes a row: each file costs its task several processes on a local store
    plan = thresholds(base, weights, share, most_copies, buckets)
    if keep:
        own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
        base = docs.select(
            *own, F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"), word_count(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("_mix_u")
        )
    else:
        own = ["_mix_id", "_mix_source"]
    closing = (F.col("_mix_score") == F.col("_mix_close")) & (F.col("_mix_key") == F.col("_mix_close_key"))
    copies = F.col("_mix_whole") + (_in_sample(buckets * buckets) | F.coalesce(closing, F.lit(False))).cast("long")
    out = _scored(base, plan).select(*own, "size", "source_size", "target", copies.alias("copies"))
    return out if keep else out.withColumnsRenamed({"_mix_id": id_col, "_mix_source": source_col})
