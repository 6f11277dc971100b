"""Metrics of an event log in one reading: many conditional counts and histograms per task at once, over the newest events of each kind.

Which events are the newest n of a key is a threshold on their numbers, found without sorting the log: events are counted by stretches of numbers, sums from the
top tell in which stretch the n-th newest lies, and only that stretch is ranked. So a task with a third of all events costs what its stretches cost, and the reading itself
is a filter. Payloads are parsed once into typed columns (a field of another type than it should be is null, a payload that isn't an object says nothing).

log: task_id, sequence_no (a number, unique in a task), event_type, payload_json. Histograms are maps in the order of their keys. Tasks without events have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event types that carry metrics.
BATCH_SUMMARY, BROWSER_FALLBACK = "acquisition.fetch_batch_summary", "acquisition.browser_fallback"
DECISIONS = "array<struct<decision:string,status:string,reason:string>>"
PAYLOAD = (
    f"result struct<parse_decisions:{DECISIONS}>, details struct<parse_decisions:{DECISIONS}>, stop_reason string, unattempted_candidate_ids array<string>, success_target_continue_count long, "
    "browser_fallback_considered boolean, browser_fallback_attempted boolean, browser_fallback_result string"
)
STRETCH = 1024


def thresholds(log: DataFrame, keys: list[str], n: int, newest: bool = True, name: str = "least") -> DataFrame:
    """(keys, name): the number of the n-th newest event of each key (of the n-th oldest, if not newest); no row for keys with fewer than n events."""
    way = F.desc if newest else F.asc
    marked = log.select(*keys, "sequence_no", F.floor(F.col("sequence_no") / STRETCH).alias("_s"))
    sums = marked.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(way("_s")))
    # The stretch where the count reaches n: what is before it is fewer than n.
    at = sums.withColumn("_upto", upto).where((F.col("_upto") >= n) & (F.col("_upto") - F.col("_n") < n)).withColumn("_place", n - F.col("_upto") + F.col("_n"))
    inside = marked.join(at.select(*keys, "_s", "_place"), [*keys, "_s"])
    place = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(way("sequence_no")))
    return inside.withColumn("_at", place).where(F.col("_at") == F.col("_place")).select(*keys, F.col("sequence_no").alias(name))


def histogram(values: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): a map from each value to its count, in the order of the values. values: key, value."""
    counted = values.where(F.coalesce("value", F.lit("")) != "").groupBy(key, "value").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(name))


def parsed(log: DataFrame) -> DataFrame:
    """The log with its payload's fields in p."""
    return log.select("task_id", "sequence_no", "event_type", F.from_json("payload_json", PAYLOAD).alias("p"))


def decisions(events: DataFrame) -> DataFrame:
    """(task_id, decision, status, reason) of every parse decision that results and details carry."""
    both = F.concat(*[F.coalesce(F.col(f"p.{c}.parse_decisions"), F.array().cast(DECISIONS)) for c in ("result", "details")])
    rows = events.select("task_id", F.explode(both).alias("d")).where("d is not null")
    return rows.select("task_id", "d.decision", "d.status", "d.reason")


def rejection(row_status: Column, decision: Column) -> Column:
    """Whether a decision's reason is one of rejection."""
    return F.coalesce(row_status.isin("SKIPPED", "FAILED"), F.lit(False)) | F.coalesce(decision != "parsed", F.lit(False))


def candidate_stops(log: DataFrame, limit: int = 200) -> DataFrame:
    """(task_id, candidate_id, stop_reason): why a candidate wasn't attempted, by the last of the task's first `limit` batch summaries that names it."""
    events = log.where(F.col("event_type") == BATCH_SUMMARY)
    last = thresholds(events, ["task_id"], limit, newest=False, name="most")
    first = parsed(events).join(last, "task_id", "left").where(F.col("most").isNull() | (F.col("sequence_no") <= F.col("most")))
    named = first.where("p.stop_reason is not null").select("task_id", "sequence_no", "p.stop_reason", F.explode("p.unattempted_candidate_ids").alias("candidate_id"))
    return named.where("candidate_id is not null").groupBy("task_id", "candidate_id").agg(F.max_by("stop_reason", "sequence_no").alias("stop_reason"))


def metrics(log: DataFrame, events_scanned: int = 200, batches_scanned: int = 200, fallbacks_scanned: int = 500) -> DataFrame:
    """A row per task: what its newest events say of parsing, of fetch batches and of browser fallbacks."""
    limits = thresholds(log, ["task_id"], events_scanned, name="least_event")
    for kind, n, name in ((BATCH_SUMMARY, batches_scanned, "least_batch"), (BROWSER_FALLBACK, fallbacks_scanned, "least_fallback")):
        limits = limits.join(thresholds(log.where(F.col("event_type") == kind), ["task_id"], n, name=name), "task_id", "full")
    # A row per task at most: the log meets it on the task alone.
    events = parsed(log).join(limits, "task_id", "left")
    since = lambda c: F.col("sequence_no") >= F.coalesce(F.col(c), F.col("sequence_no"))
    batch = (F.col("event_type") == BATCH_SUMMARY) & since("least_batch")
    fallback = (F.col("event_type") == BROWSER_FALLBACK) & since("least_fallback")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    considered, attempted, result = is_("p.browser_fallback_considered"), is_("p.browser_fallback_attempted"), F.coalesce("p.browser_fallback_result", F.lit(""))
    continued = F.greatest(F.coalesce("p.success_target_continue_count", F.lit(0)), F.lit(0))
    counted = events.groupBy("task_id").agg(
        F.count("*").alias("events"), F.count_if(batch).alias("batch_summaries"), F.sum(F.when(batch, continued).otherwise(0)).alias("success_target_continued"),
        F.count_if(fallback).alias("fallback_events"), F.count_if(fallback & considered).alias("fallback_considered"), F.count_if(fallback & attempted).alias("fallback_attempted"),
        F.count_if(fallback & (result == "succeeded")).alias("fallback_succeeded"), F.count_if(fallback & (result == "failed")).alias("fallback_failed"), F.count_if(fallback & considered & ~attempted).alias("fallback_skipped"),
    )
    said = decisions(events.where(since("least_event")))
    histograms = {
        "stop_reasons": events.where(batch).select("task_id", F.col("p.stop_reason").alias("value")), "parser_decisions": said.select("task_id", F.col("decision").alias("value")),
        "parser_rejections": said.where(rejection(F.col("status"), F.col("decision"))).select("task_id", F.col("reason").alias("value")),
        "unattempted_candidates": candidate_stops(log, batches_scanned).select("task_id", F.col("stop_reason").alias("value")),
    }
    for name, values in histograms.items():
        counted = counted.join(histogram(values, "task_id", name), "task_id", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,bigint>")))
    return counted


def rate(part: Column, whole: Column) -> Column:
    """part by whole to six places, null without a whole."""
    return F.when(whole > 0, F.round(part / whole, 6))


def funnel(queries: DataFrame, candidates: DataFrame, jobs: DataFrame, attempts: DataFrame, snapshots: DataFrame, documents: DataFrame, chunks: DataFrame, claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A row per task that any table knows: counts along the way from queries to reports, and their rates. The ledger's columns: id and what points to the table before
    (candidates: task_id, canonical_url, domain; jobs: task_id, candidate_url_id, mode, status; attempts: fetch_job_id, error_code; snapshots: fetch_attempt_id; documents: task_id, content_snapshot_id; chunks:
    source_document_id; claims: task_id, verification_status). Each table is read once and joined on its own key."""
    job = jobs.select(F.col("id").alias("job_id"), "task_id", "candidate_url_id")
    attempt = attempts.select(F.col("id").alias("attempt_id"), F.col("fetch_job_id").alias("job_id"), "error_code").join(job, "job_id")
    document_of = documents.select(F.col("content_snapshot_id").alias("snapshot_id")).distinct().withColumn("parsed", F.lit(True))
    snapshot = snapshots.select(F.col("id").alias("snapshot_id"), F.col("fetch_attempt_id").alias("attempt_id")).join(attempt, "attempt_id").join(document_of, "snapshot_id", "left")
    chunk = chunks.groupBy(F.col("source_document_id").alias("document_id")).agg(F.count("*").alias("n"))
    document = documents.select(F.col("id").alias("document_id"), "task_id").join(chunk, "document_id", "left")
    # Candidates with a job are counted by candidate first, so a candidate with many jobs counts once without a distinct over the task.
    fetched = jobs.groupBy("task_id", "candidate_url_id").agg(F.count("*").alias("jobs"))
    seen = snapshot.groupBy("task_id", "candidate_url_id").agg(F.count("*").alias("snapshots"), F.count("parsed").alias("parsed"))
    one = lambda df, *aggs: df.where("task_id is not null").groupBy("task_id").agg(*aggs)
    parts = [
        one(queries, F.count("*").alias("search_query")), one(candidates, F.count("*").alias("candidate_url")), one(jobs, F.count("*").alias("fetch_job"), F.count_if(F.col("status") == "SUCCEEDED").alias("successful_fetch_job")),
        one(fetched, F.count("*").alias("candidates_with_any_fetch_job")), one(attempt, F.count("*").alias("fetch_attempt"), F.count_if(F.col("error_code").isNotNull()).alias("failed_attempt"), F.count_if(F.col("error_code") == "body_too_large").alias("body_too_large")),
        one(seen, F.sum("snapshots").alias("content_snapshot"), F.count("*").alias("candidates_with_snapshot"), F.sum("parsed").alias("snapshots_with_source_document")),
        one(document, F.count("*").alias("source_document"), F.coalesce(F.sum("n"), F.lit(0)).alias("source_chunk"), F.count("n").alias("documents_with_chunks")),
        one(claims, F.count("*").alias("claim"), F.count_if(F.col("verification_status") == "supported").alias("supported_claim")), one(artifacts, F.count("*").alias("report_artifact")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "task_id", "full")
    out = out.na.fill(0, [c for c in out.columns if c != "task_id"])
    return out.withColumns({
        "candidates_without_fetch_job": F.greatest(F.lit(0), F.col("candidate_url") - F.col("candidates_with_any_fetch_job")), "unparsed_snapshots": F.col("content_snapshot") - F.col("snapshots_with_source_document"),
        "candidate_url_to_snapshot_rate": rate(F.col("candidates_with_snapshot"), F.col("candidate_url")), "snapshot_to_document_rate": rate(F.col("snapshots_with_source_document"), F.col("content_snapshot")),
        "document_to_chunk_rate": rate(F.col("documents_with_chunks"), F.col("source_document")),
    })
