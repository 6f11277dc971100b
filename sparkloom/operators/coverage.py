"""Evidence yield, slot coverage, stop decisions and duplicate metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"missing": 0, "weak": 1, "moderate": 2, "covered": 2, "strong": 3}


def candidate_state(accepted: Column, reasons: Column) -> Column:
    return F.when(accepted, "accepted").when(F.size(reasons) > 0, "rejected").otherwise("unselected")


def _total(n: Column) -> Column:
    """Of counted rows, 0 if there are none."""
    return F.coalesce(F.sum(n), F.lit(0)).cast("long")


def evidence_yield(candidates: DataFrame, by: Column, name: str, empty: str, n: Column | int = 1) -> DataFrame:
    """Counts by state. candidates: state and the column to count by; its null or blank is `empty`. n: for how many candidates a row stands."""
    n = F.lit(n) if isinstance(n, int) else n
    key = F.when(F.coalesce(by, F.lit("")) == "", F.lit(empty)).otherwise(by)
    state = lambda s: _total(F.when(F.col("state") == s, n)).alias(s)
    return candidates.groupBy(key.alias(name)).agg(_total(n).alias("total"), state("accepted"), state("rejected"), state("unselected"))


def slot_status(supported: Column, weak: Column, accepted: Column, required: Column) -> Column:
    return F.when(supported > 0, "covered").when((weak > 0) | (accepted > 0), "weak").when(required, "missing").otherwise("weak")


def slot_coverage(slots: DataFrame, candidates: DataFrame, claims: DataFrame, n: Column | int = 1) -> DataFrame:
    """A row per slot. slots: slot_id, required; candidates: slot_id, source, state; claims: slot_id, status, source. n: for how many candidates or claims a row stands."""
    n = F.lit(n) if isinstance(n, int) else n
    found = candidates.groupBy("slot_id").agg(_total(n).alias("candidates"), _total(F.when(F.col("state") == "accepted", n)).alias("accepted_evidence"))
    status = lambda s: _total(F.when(F.col("status") == s, n))
    said = claims.groupBy("slot_id").agg(status("supported").alias("supported_claims"), status("weak").alias("weak_claims"), F.countDistinct("source").alias("sources"))
    counts = ("candidates", "accepted_evidence", "supported_claims", "weak_claims", "sources")
    out = slots.join(found, "slot_id", "left").join(said, "slot_id", "left").na.fill(0, list(counts))
    return out.withColumn("status", slot_status(F.col("supported_claims"), F.col("weak_claims"), F.col("accepted_evidence"), F.col("required")))


def contribution(accepted: Column, claims: Column, candidates: Column) -> Column:
    most = F.greatest(accepted, claims)
    return F.when(most >= 3, "high").when(most >= 1, "medium").when(candidates > 0, "low").otherwise("none")


def normalised(status: Column, supported: Column, sources: Column, accepted: Column) -> Column:
    """The strength of a slot's coverage."""
    broad = F.when((supported >= 2) | (sources >= 2), "strong").when((accepted < 3) & (sources < 2), "weak").otherwise("moderate")
    return F.when(status == "covered", broad).when(supported > 0, F.when((accepted < 3) & (sources < 2), "weak").otherwise("moderate")).when((accepted > 0) | (status == "weak"), "weak").otherwise("missing")


def level(strength: Column) -> Column:
    return F.coalesce(*[F.when(strength == k, F.lit(v)) for k, v in LEVELS.items()], F.lit(0))


def evaluate(coverage: DataFrame, sources: DataFrame, least: str = "moderate", domains: int = 3, authoritative: int = 1, roles: int = 2) -> DataFrame:
    """One row: whether research can stop and what is missing. sources: domain, role, authoritative, used."""
    strength = normalised(F.col("status"), F.col("supported_claims"), F.col("sources"), F.col("accepted_evidence"))
    slots = coverage.agg(F.count_if("required").alias("required_slots"), F.count_if(F.col("required") & (level(strength) >= LEVELS[least])).alias("satisfied_slots"))
    used = sources.where("used").agg(F.countDistinct("domain").alias("domains"), F.countDistinct("role").alias("roles"), F.countDistinct(F.when(F.col("authoritative"), F.col("domain"))).alias("authoritative"))
    short = F.array_compact(F.array(
        F.when(F.col("satisfied_slots") < F.col("required_slots"), "required_slots"), F.when(F.col("domains") < domains, "domains"),
        F.when(F.col("authoritative") < authoritative, "authoritative"), F.when(F.col("roles") < roles, "roles"),
    ))
    return slots.join(F.broadcast(used)).withColumn("missing", F.concat_ws(",", short)).withColumn("can_stop", F.size(short) == 0)  # a row each


def quality_gate(counts: dict[str, Column], least: dict[str, int]) -> Column:
    """Names of the counts that fall short, as one string."""
    return F.concat_ws(",", F.array_compact(F.array(*[F.when(counts[k] < n, F.lit(k)) for k, n in least.items()])))


def duplicate_rate(distinct: Column, n: Column) -> Column:
    return F.when(n > 0, 1 - distinct / n).otherwise(F.lit(0.0))


def reuse(uses: DataFrame, key: str, user: str, limit: int = 5) -> DataFrame:
    """The most reused keys, with their extra uses and distinct users."""
    counted = uses.groupBy(key).agg((F.count("*") - 1).alias("reused"), F.countDistinct(user).alias("users")).where("reused > 0")
    return counted.orderBy(F.desc("reused"), F.desc("users"), key).limit(limit)
