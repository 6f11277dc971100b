"""The ledger's tables: explicit schemas, readers and writers, and data-quality predicates.

Tables are Parquet; raw content comes through Spark's binaryFile source or as text columns. JSON payloads stay strings and are read
by path. Writers append, or upsert by key: the newest row of a key (by an order column) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "research_task": "id string, query string, user_id string, status string, priority int, constraints_json string, revision_no int, last_event_sequence_no int, started_at timestamp, ended_at timestamp, created_at timestamp, updated_at timestamp",
    "research_run": "id string, task_id string, round_no int, current_state string, checkpoint_json string, started_at timestamp, ended_at timestamp",
    "task_event": "id string, task_id string, run_id string, event_type string, sequence_no long, payload_json string, created_at timestamp",
    "search_query": "id string, task_id string, run_id string, query_text string, provider string, round_no int, issued_at timestamp, raw_response_json string",
    "candidate_url": "id string, task_id string, search_query_id string, original_url string, canonical_url string, domain string, title string, rank int, selected boolean, metadata_json string",
    "fetch_job": "id string, task_id string, candidate_url_id string, mode string, status string, scheduled_at timestamp, lease_until timestamp, worker_id string",
    "fetch_attempt": "id string, fetch_job_id string, attempt_no int, http_status int, error_code string, started_at timestamp, finished_at timestamp, trace_json string",
    "content_snapshot": "id string, fetch_attempt_id string, storage_bucket string, storage_key string, content_hash string, mime_type string, bytes long, extracted_title string, fetched_at timestamp",
    "source_document": "id string, task_id string, content_snapshot_id string, canonical_url string, domain string, title string, source_type string, published_at timestamp, fetched_at timestamp, authority_score double, freshness_score double, originality_score double, consistency_score double, safety_score double, final_source_score double",
    "source_chunk": "id string, source_document_id string, chunk_no int, text string, token_count int, metadata_json string",
    "citation_span": "id string, source_chunk_id string, start_offset int, end_offset int, excerpt string, normalized_excerpt_hash string",
    "claim": "id string, task_id string, statement string, claim_type string, confidence double, verification_status string, notes_json string",
    "claim_evidence": "id string, claim_id string, citation_span_id string, relation_type string, score double",
    "report_artifact": "id string, task_id string, version int, storage_bucket string, storage_key string, format string, content_hash string, manifest_json string, created_at timestamp",
}
KEYS = {
    "research_run": ("task_id", "round_no"),
    "task_event": ("task_id", "sequence_no"),
    "candidate_url": ("search_query_id", "canonical_url"),
    "fetch_job": ("candidate_url_id", "mode"),
    "fetch_attempt": ("fetch_job_id", "attempt_no"),
    "content_snapshot": ("fetch_attempt_id",),
    "source_document": ("task_id", "canonical_url"),
    "source_chunk": ("source_document_id", "chunk_no"),
    "citation_span": ("source_chunk_id", "start_offset", "end_offset"),
    "claim_evidence": ("claim_id", "citation_span_id", "relation_type"),
    "report_artifact": ("task_id", "version", "format"),
}
CHECKS = {
    "research_task": ("trim(query) <> ''", "priority >= 0", "revision_no > 0", "last_event_sequence_no >= 0"),
    "task_event": ("event_type <> ''", "sequence_no > 0"),
    "candidate_url": ("original_url <> ''", "canonical_url <> ''", "domain <> ''", "rank >= 0"),
    "fetch_attempt": ("attempt_no > 0", "http_status is null or http_status between 100 and 599"),
    "content_snapshot": ("bytes >= 0",),
    "source_chunk": ("chunk_no >= 0", "trim(text) <> ''", "token_count >= 0"),
    "citation_span": ("start_offset >= 0", "end_offset > start_offset", "excerpt <> ''"),
    "claim": ("confidence is null or confidence between 0 and 1",),
    "claim_evidence": ("score is null or score between 0 and 1",),
    "report_artifact": ("version > 0",),
}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A ledger table under root."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_content(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Stored objects: path, modificationTime, length, content and the sha256 of the content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.withColumn("content_hash", F.sha2("content", 256))


def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root}/{name}")


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows that break a check, with the broken checks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(c)) for c in CHECKS.get(name, ())] or [F.lit(None).cast("string")]))
    return df.withColumn("violations", broken).where(F.size("violations") > 0)


def duplicates(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def newest(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """One row per key, the first in this order. The order should be total."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")
