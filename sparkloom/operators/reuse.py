"""Choice of evidence claim by claim, where what earlier claims of a task have used costs later ones.

The rule is sequential: claims of a task choose in order, at most one support, one contradiction, and one weak support (only without a support
or beside a contradiction). A candidate's rank loses .04 for each earlier choice of its chunk (.08 at most), .05 for its span (.10), .03 for its
content (.06), .14 in all; the best adjusted one is chosen. A weak support from a source (domain and content hash) that the claim has already is
chosen only if there is no other.

Here it is a fixpoint over all tasks at once. Four facts make it small:
- A candidate more than .14 below the best of its claim and relation is never chosen; for weak supports, where two sources may be barred, the
  best three sources of a claim count. All others go (grouped maxima) where a claim gets all its candidates.
- Each cost is reached by two choices, so of a chunk, span or content only its first two choices in claim order matter to later claims. They come from a
  window cut to two rows, which Spark limits before the shuffle: a chunk that all claims of a huge task choose is two rows a map task.
- In each round only claims that have a candidate whose first two choices changed choose again.
- Hardly a claim chooses beyond its first candidates, so the rounds see the first HELD of each claim and relation, and one more, the first of the rest, as if nothing
  it has were in use and its source never barred. A choice that beats this one beats all the rest, whatever is in use. Claims that choose it get all their candidates, and the
  rounds go on from there; they end when no claim is left that chooses one.
The first claim of a task is right after the first round and the k-th after the k-th at the latest, so the fixpoint is the sequential result; in practice the
rounds are as many as choices depend on each other in a row. State is written to the shared folder after each round. No task's claims ever meet in one group.

Scores are whole 1/10,000, as ranks have four places. Ties: higher rank, source quality, content quality, then domain, chunk number, start, id of the candidate.
Defined cases: rows without a relation of the three are ignored, null qualities count as the lowest, null keys (chunk, span, content) are never in use; claims without
candidates have no row in the choice and a row of zeros in `diversity` if they are listed; rows that are equal in every column are one candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import scratch

RELATIONS = ("support", "contradict", "weak_support")
UNIT = 10_000
#: Cost of a use by kind of key, and the most it costs, in units.
COSTS = {"chunk": (400, 800), "span": (500, 1000), "content": (300, 600)}
MOST = 1400
#: Candidates of a claim and relation that the rounds see at first.
HELD = 128
CLAIM = ("task_id", "claim_no")
ORDER = ("rank", "source_quality", "content_quality")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(candidates: DataFrame) -> DataFrame:
    """The candidates by claim and code of the relation, each with its sort key."""
    code = F.coalesce(*[F.when(F.col("relation") == r, F.lit(i)) for i, r in enumerate(RELATIONS)])
    rank = F.round(F.col("rank_score") * UNIT).cast("long")
    last = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
    return candidates.select(
        *CLAIM, code.alias("code"), "candidate_id", rank.alias("rank"), last("source_quality").alias("source_quality"), last("content_quality").alias("content_quality"), "domain", "chunk_no", "start_offset",
        F.col("chunk_id").alias("chunk"), F.col("span_key").alias("span"), F.col("content_key").alias("content"), F.struct("domain", "content_hash").alias("source"),
    ).where("code is not null and rank is not null")


def _key(adjusted: Column) -> list[Column]:
    """What is chosen by, the least first."""
    return [(-adjusted).alias("a"), *[(-F.col(c)).alias(c) for c in ORDER], *map(F.col, ("domain", "chunk_no", "start_offset", "candidate_id", "source", "chunk", "span", "content"))]


def heads(candidates: DataFrame, held: int) -> DataFrame:
    """The first candidates of each claim and relation, and the first of the rest, which is open: it has no keys and a source of its own."""
    place = F.row_number().over(Window.partitionBy(*CLAIM, "code").orderBy(*_key(F.col("rank"))))
    own = _ranked(candidates)
    # What these can't reach is told by counts of ranks, so that few rows are sorted.
    ranks = own.groupBy(*CLAIM, "code", "rank").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy(*CLAIM, "code").orderBy(F.desc("rank")))
    least = ranks.withColumn("above", above - F.col("n")).where(F.col("above") <= held).groupBy(*CLAIM, "code").agg(F.min("rank").alias("least"))
    near = own.join(_written(least, "reuse-least"), [*CLAIM, "code"]).where("rank >= least").drop("least")
    first = near.withColumn("n", place).where(F.col("n") <= held + 1).withColumn("open", F.col("n") > held).drop("n")
    none = F.lit(None).cast("string")
    source = F.struct(none.alias("domain"), F.lit("\0open").alias("content_hash")).cast(own.schema["source"].dataType)
    return first.withColumns({**{k: F.when(~F.col("open"), F.col(k)) for k in COSTS}, "source": F.when(F.col("open"), source).otherwise(F.col("source"))})


def contenders(candidates: DataFrame) -> DataFrame:
    """The candidates that may be chosen whatever others use, each with its sort key."""
    own = _ranked(candidates).distinct()
    best = own.groupBy(*CLAIM, "code").agg(F.max("rank").alias("best"))
    strong = own.where("code < 2").join(best, [*CLAIM, "code"]).where(F.col("rank") >= F.col("best") - MOST).drop("best")
    # Weak supports: none beside a support without a contradiction.
    which = best.groupBy(*CLAIM).agg(F.bool_or(F.col("code") == 0).alias("has_support"), F.bool_or(F.col("code") == 1).alias("has_contradict"))
    weak = own.where("code = 2").join(which.where("not has_support or has_contradict").select(*CLAIM), [*CLAIM], "left_semi")
    by_source = weak.groupBy(*CLAIM, "source").agg(F.max("rank").alias("best"))
    third = Window.partitionBy(*CLAIM).orderBy(F.desc("best"))
    least = by_source.withColumn("n", F.row_number().over(third)).where("n <= 3").groupBy(*CLAIM).agg(F.min("best").alias("third"))
    sources = by_source.join(least, [*CLAIM]).where(F.col("best") >= F.col("third") - MOST).select(*CLAIM, F.col("source").alias("of"), "best")
    # Sources may hold nulls, so they meet by their text.
    text = lambda c: F.to_json(F.col(c))
    met = weak.withColumn("_source", text("source")).join(sources.select(*CLAIM, text("of").alias("_source"), "best"), [*CLAIM, "_source"])
    return strong.unionByName(met.where(F.col("rank") >= F.col("best") - MOST).drop("_source", "best"))


def first_uses(picks: DataFrame) -> DataFrame:
    """(task_id, kind, key, first, second): the claims that use a key first, in claim order."""
    uses = None
    for kind in COSTS:
        part = picks.where(F.col(kind).isNotNull()).select("task_id", F.lit(kind).alias("kind"), F.col(kind).alias("key"), "claim_no", "code")
        uses = part if uses is None else uses.unionByName(part)
    place = F.row_number().over(Window.partitionBy("task_id", "kind", "key").orderBy("claim_no", "code"))
    two = uses.withColumn("n", place).where("n <= 2")
    return two.groupBy("task_id", "kind", "key").agg(F.min("claim_no").alias("first"), F.max(F.when(F.col("n") == 2, F.col("claim_no"))).alias("second"))


def choose(pool: DataFrame, uses: DataFrame | None) -> DataFrame:
    """What the claims of the pool choose, given who uses a key first."""
    cost = F.lit(0)
    for kind, (each, most) in COSTS.items():
        if uses is None:
            continue
        mine = uses.where(F.col("kind") == kind).select("task_id", F.col("key").alias(kind), F.col("first").alias(f"{kind}_1"), F.col("second").alias(f"{kind}_2"))
        pool = pool.join(mine, ["task_id", kind], "left")
        before = lambda c: F.coalesce((F.col("claim_no") > F.col(c)).cast("int"), F.lit(0))
        cost = cost + F.least(F.lit(most), (before(f"{kind}_1") + before(f"{kind}_2")) * each)
    adjusted = F.greatest(F.lit(0), F.col("rank") - F.least(F.lit(MOST), cost))
    key = F.struct(*_key(adjusted), "open")
    by_source = pool.groupBy(*CLAIM, "code", "source").agg(F.min(key).alias("best"))
    # Two sources at most are barred to a weak support, so three of each relation are enough.
    place = F.row_number().over(Window.partitionBy(*CLAIM, "code").orderBy("best"))
    three = by_source.withColumn("n", place).where("n <= 3").groupBy(*CLAIM)
    one = lambda c: F.min(F.when(F.col("code") == c, F.col("best")))
    found = three.agg(one(0).alias("s"), one(1).alias("c"), F.array_sort(F.collect_list(F.when(F.col("code") == 2, F.col("best")))).alias("weak"))
    other = F.filter("weak", lambda w: ~(F.coalesce(w["source"].eqNullSafe(F.col("s.source")) & F.col("s").isNotNull(), F.lit(False)) | F.coalesce(w["source"].eqNullSafe(F.col("c.source")) & F.col("c").isNotNull(), F.lit(False))))
    weak = F.when(F.col("s").isNull() | F.col("c").isNotNull(), F.coalesce(F.get(other, F.lit(0)), F.get("weak", F.lit(0))))
    rows = found.select(*CLAIM, F.explode(F.array(*[F.struct(F.lit(i).alias("code"), x.alias("p")) for i, x in enumerate((F.col("s"), F.col("c"), weak))])).alias("r")).where("r.p is not null")
    return rows.select(*CLAIM, "r.code", "r.p.candidate_id", "r.p.chunk", "r.p.span", "r.p.content", "r.p.open")


def settle(candidates: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(task_id, claim_no, code, candidate_id, chunk, span, content): the sequential choice of all tasks."""
    pool = _written(heads(candidates, HELD), "reuse-pool")
    picks = _written(choose(pool, None), "reuse-picks")
    uses: DataFrame | None = None
    for _ in range(most_rounds):
        now = _written(first_uses(picks), "reuse-uses")
        key, seen = ["task_id", "kind", "key"], F.struct("first", "second")
        changed = now.select(*key, seen.alias("now"))
        if uses is not None:
            both = changed.join(uses.select(*key, seen.alias("was")), key, "full")
            changed = both.where(~F.col("now").eqNullSafe(F.col("was")))
        changed = _written(changed.select(*key), "reuse-changed")
        if changed.isEmpty():
            again = _written(picks.where("open").select(*CLAIM).distinct(), "reuse-open")
            if again.isEmpty():
                return picks.drop("open")
            all_ = contenders(candidates.join(again, [*CLAIM], "left_semi")).withColumn("open", F.lit(False))
            pool = _written(pool.join(again, [*CLAIM], "left_anti").unionByName(all_), "reuse-pool")
        else:
            again = None
            for kind in COSTS:
                part = pool.join(changed.where(F.col("kind") == kind).select("task_id", F.col("key").alias(kind)), ["task_id", kind], "left_semi").select(*CLAIM)
                again = part if again is None else again.unionByName(part)
            again = _written(again.distinct(), "reuse-again")
        chosen = choose(pool.join(again, [*CLAIM], "left_semi"), now)
        picks = _written(picks.join(again, [*CLAIM], "left_anti").unionByName(chosen), "reuse-picks")
        uses = now
    raise RuntimeError("choices did not settle")


def _uses_before(picks: DataFrame, kind: str, bucket: int = 1024) -> DataFrame:
    """picks with the exact number of choices of the same key by earlier claims. A key's claims are counted by stretches of claim
    numbers, so no stretch but its own meets a claim, however many claims use the key."""
    key = ["task_id", kind]
    marked = picks.withColumn("_stretch", F.floor(F.col("claim_no") / bucket))
    sums = marked.groupBy(*key, "_stretch").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*key, "_stretch", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    inside = F.count("*").over(Window.partitionBy(*key, "_stretch").orderBy("claim_no").rangeBetween(Window.unboundedPreceding, -1))
    counted = marked.withColumn("_inside", inside).join(sums, [*key, "_stretch"], "left")
    return counted.withColumn(f"{kind}_before", F.when(F.col(kind).isNull(), 0).otherwise(F.coalesce("_earlier", F.lit(0)) + F.col("_inside")).cast("long")).drop("_stretch", "_earlier", "_inside")


def penalty(before: dict[str, Column]) -> Column:
    """What so many earlier uses cost, in units."""
    return F.least(F.lit(MOST), sum((F.least(F.lit(most), before[k] * each) for k, (each, most) in COSTS.items()), F.lit(0)))


def select_evidence(candidates: DataFrame) -> DataFrame:
    """The candidates chosen, with chunk_before, span_before and content_before (choices by earlier claims of the task), reuse_penalty,
    adjusted_score and selection_rank. candidates: task_id, claim_no (a whole number, in the order of choice), candidate_id (unique in a claim and relation), relation,
    rank_score, chunk_id, span_key, content_key, domain, content_hash, source_quality, content_quality, chunk_no, start_offset; other columns stay."""
    picks = settle(candidates)
    for kind in COSTS:
        picks = _uses_before(picks, kind)
    cost = penalty({k: F.col(f"{k}_before") for k in COSTS})
    place = F.row_number().over(Window.partitionBy(*CLAIM).orderBy("code")).cast("long")
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("code") + 1)
    picks = picks.select(*CLAIM, relation.alias("relation"), "candidate_id", *[f"{k}_before" for k in COSTS], cost.alias("_cost"), place.alias("selection_rank"))
    # Written, so that its size is known: the candidates need no shuffle if it is small.
    met = candidates.join(_written(picks, "reuse-chosen"), [*CLAIM, "relation", "candidate_id"]).dropDuplicates([*CLAIM, "relation", "candidate_id"])
    units = F.round(F.col("rank_score") * UNIT).cast("long")
    adjusted = F.greatest(F.lit(0), units - F.col("_cost")) / F.lit(float(UNIT))
    return met.withColumn("reuse_penalty", F.col("_cost") / F.lit(float(UNIT))).withColumn("adjusted_score", adjusted).drop("_cost")


def diversity(selected: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Per claim: how many sources, chunks, spans and contents its evidence comes from, how many repeat one, and what reuse cost. claims (task_id, claim_no) get a row of zeros without evidence."""
    nonempty = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    unique = {n: F.count_distinct(nonempty(c)).alias(f"unique_{n}_count") for n, c in (("source", "source_id"), ("chunk", "chunk_id"), ("span", "span_key"), ("content", "content_key"))}
    repeats = [(F.count(nonempty(c)) - F.count_distinct(nonempty(c))).alias(f"duplicate_{n}_count") for n, c in (("chunk", "chunk_id"), ("span", "span_key"), ("content", "content_key"))]
    counted = selected.groupBy(*CLAIM).agg(
        F.count("*").alias("evidence_count"), *unique.values(), *repeats,
        F.max("reuse_penalty").alias("max_reuse_penalty"), F.round(F.avg("reuse_penalty"), 4).alias("mean_reuse_penalty"), F.array_sort(F.collect_set("relation")).alias("relation_types"),
    )
    if claims is None:
        return counted
    filled = claims.select(*CLAIM).distinct().join(counted, [*CLAIM], "left")
    numbers = [c for c in counted.columns if c not in (*CLAIM, "relation_types")]
    return filled.na.fill(0, numbers).withColumn("relation_types", F.coalesce("relation_types", F.array().cast("array<string>")))
