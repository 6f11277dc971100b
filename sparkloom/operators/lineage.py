"""From candidates to claims: one row for each candidate and for each document that no candidate led to.

A candidate's job, its latest attempt and that attempt's snapshot come from grouped maxima by their own keys, so a candidate with many jobs or a job with many attempts is combined
before its shuffle and nothing is sorted. Documents meet candidates by task and address; those that no candidate has are added by an anti join, so each
candidate and each document is there, documents once for each candidate that names them. What a document yields (chunks, evidence, claims) is counted by document before it is joined.

Defined cases: null addresses meet nothing; null flags are false; a candidate without job wasn't attempted; without chunks or evidence the counts are 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.coverage import contribution

SUPPORTED_MIME = ("text/html", "text/plain")


def latest_fetch(jobs: DataFrame, attempts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(candidate_id, fetched, blocked, mime_type) by each candidate's last job and that job's last attempt.
    jobs: id, candidate_url_id, status; attempts: id, fetch_job_id, attempt_no, blocked; snapshots: fetch_attempt_id, mime_type."""
    job = jobs.groupBy(F.col("candidate_url_id").alias("candidate_id")).agg(F.max_by(F.struct("id", "status"), "id").alias("job")).select("candidate_id", F.col("job.id").alias("job_id"), (F.col("job.status") == "SUCCEEDED").alias("fetched"))
    attempt = attempts.groupBy(F.col("fetch_job_id").alias("job_id")).agg(F.max_by(F.struct("id", "blocked"), F.struct("attempt_no", "id")).alias("attempt")).select("job_id", F.col("attempt.id").alias("attempt_id"), F.col("attempt.blocked").alias("blocked"))
    snapshot = snapshots.groupBy(F.col("fetch_attempt_id").alias("attempt_id")).agg(F.max("mime_type").alias("mime_type"))
    return job.join(attempt, "job_id", "left").join(snapshot, "attempt_id", "left").drop("job_id", "attempt_id")


def document_yield(chunks: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """(document_id, chunks, eligible_chunks, candidates, accepted, rejected, claims). chunks: source_document_id, eligible; evidence: source_document_id, accepted, rejected; claims: source_document_id."""
    key = F.col("source_document_id").alias("document_id")
    a = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.count_if("eligible").alias("eligible_chunks"))
    b = evidence.groupBy(key).agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), F.count_if("rejected").alias("rejected"))
    c = claims.groupBy(key).agg(F.count("*").alias("claims"))
    return a.join(b, "document_id", "full").join(c, "document_id", "full").na.fill(0, ["chunks", "eligible_chunks", "candidates", "accepted", "rejected", "claims"])


def dropped_reason(attempted: Column, fetched: Column, parsed: Column, blocked: Column, unsupported: Column) -> Column:
    """Why a source gave nothing: the first step of its way that failed, null if it gave something. Reads the counts of document_yield."""
    nothing = (F.col("accepted") == 0) & (F.col("claims") == 0)
    return (
        F.when(~attempted, "not_selected_low_priority").when(~fetched & blocked, "blocked_by_policy").when(~fetched, "fetch_failed").when(~parsed & unsupported, "unsupported_content_type")
        .when(~parsed | (F.col("chunks") == 0), "parse_failed").when(F.col("eligible_chunks") == 0, "low_chunk_quality").when(F.col("candidates") == 0, "no_evidence_candidates")
        .when(nothing & (F.col("rejected") > 0), "evidence_rejected").when(nothing, "off_intent")
    )


def low_yield(text_length: Column, relevant: Column, categories: Column) -> Column:
    """Why a parsed document answers nothing, null if it answers something: no text, no usable chunk, no sentence, none relevant, or none of a wanted category."""
    return (
        F.when(F.col("chunks") == 0, "no_chunks").when(text_length < 80, "very_short_extracted_text").when(F.col("eligible_chunks") == 0, "no_eligible_chunks").when(F.col("candidates") == 0, "no_candidate_sentences")
        .when(relevant == 0, "no_answer_relevant_candidates").when(categories == 0, "no_answer_category_coverage")
    )


def lineage(candidates: DataFrame, fetches: DataFrame, documents: DataFrame, yields: DataFrame) -> DataFrame:
    """(task_id, candidate_id, document_id, url, origin, attempted, fetched, parsed, indexed, the counts, dropped_reason, contribution). candidates: id, task_id, canonical_url; fetches as latest_fetch
    gives them; documents: id, task_id, canonical_url; yields as document_yield gives them."""
    own = candidates.select(F.col("id").alias("candidate_id"), "task_id", F.col("canonical_url").alias("url"))
    found = documents.select(F.col("id").alias("document_id"), "task_id", F.col("canonical_url").alias("url"))
    led = own.join(found, ["task_id", "url"], "left").join(fetches.withColumn("_job", F.lit(True)), "candidate_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    led = led.select("task_id", "candidate_id", "document_id", "url", F.when(F.col("document_id").isNull(), "candidate").otherwise("both").alias("origin"), flag("_job").alias("attempted"), flag("fetched").alias("fetched"), flag("blocked").alias("blocked"), "mime_type")
    orphans = found.join(own.select("task_id", "url"), ["task_id", "url"], "left_anti")
    orphans = orphans.select("task_id", F.lit(None).cast(own.schema["candidate_id"].dataType).alias("candidate_id"), "document_id", "url", F.lit("document").alias("origin"), F.lit(True).alias("attempted"), F.lit(True).alias("fetched"), F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("mime_type"))
    counts = [c for c in yields.columns if c != "document_id"]
    rows = led.unionByName(orphans).join(yields, "document_id", "left").na.fill(0, counts)
    parsed = F.col("document_id").isNotNull()
    unsupported = F.coalesce(~F.col("mime_type").isin(*SUPPORTED_MIME), F.lit(False))
    rows = rows.withColumn("parsed", parsed).withColumn("indexed", F.col("chunks") > 0)
    rows = rows.withColumn("dropped_reason", dropped_reason(F.col("attempted"), F.col("fetched"), parsed, F.col("blocked"), unsupported))
    rows = rows.withColumn("contribution", contribution(F.col("accepted"), F.col("claims"), F.col("candidates")))
    return rows.select("task_id", "candidate_id", "document_id", "url", "origin", "attempted", "fetched", "parsed", "indexed", *counts, "dropped_reason", "contribution")
