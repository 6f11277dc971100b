"""Where documents come from and what they yield."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import lineage as L
from sparkloom.sources.tables import table

QUERIES, SQL = {}, {}

# A page is a candidate for the document that its path names; a label stands for its fetch job (good ones succeed, toxic ones are blocked), tried twice; the second try of all but German texts gives a page.
# Texts of more than 200 characters have a chunk; lengths say what evidence and claims come of it.
LEDGER = r"""candidates AS (SELECT page_id AS id, try_cast(nullif(regexp_extract(url, '/(\d{1,18})(?:[./?#]|$)', 1), '') AS BIGINT) AS doc FROM pages), c AS (SELECT id, 'doc/' || doc AS url, doc FROM candidates),
  fetches AS (SELECT c.id AS candidate_id, max(quality) = 1 AS fetched, max(toxic) = 1 AS blocked, max(CASE lang WHEN 'de' THEN 'application/pdf' ELSE 'text/html' END) AS mime_type FROM c JOIN labels l ON l.doc_id = c.doc LEFT JOIN documents d ON d.doc_id = c.doc GROUP BY c.id),
  docs AS (SELECT doc_id AS document_id, 'doc/' || doc_id AS url, CASE WHEN n_chars > 200 THEN 1 ELSE 0 END AS chunks, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS eligible_chunks, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS candidates,
    CASE WHEN n_chars > 300 AND n_chars % 3 = 0 THEN 1 ELSE 0 END AS accepted, CASE WHEN n_chars > 300 AND n_chars % 3 = 1 THEN 1 ELSE 0 END AS rejected, CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS claims FROM documents WHERE n_chars >= 100)"""
SQL["source_lineage"] = f"""WITH {LEDGER},
  led AS (SELECT c.id AS candidate_id, d.document_id AS document_id, c.url AS url, CASE WHEN d.document_id IS NULL THEN 'candidate' ELSE 'both' END AS origin, f.candidate_id IS NOT NULL AS attempted, coalesce(f.fetched, false) AS fetched, coalesce(f.blocked, false) AS blocked, f.mime_type AS mime_type FROM c LEFT JOIN docs d ON d.url = c.url LEFT JOIN fetches f ON f.candidate_id = c.id),
  rows_ AS (SELECT * FROM led UNION ALL SELECT NULL, document_id, url, 'document', true, true, false, NULL FROM docs WHERE url NOT IN (SELECT url FROM c WHERE url IS NOT NULL)),
  y AS (SELECT r.*, r.document_id IS NOT NULL AS parsed, coalesce(chunks, 0) AS chunks, coalesce(eligible_chunks, 0) AS eligible_chunks, coalesce(candidates, 0) AS candidates, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, coalesce(claims, 0) AS claims FROM rows_ r LEFT JOIN docs d ON d.document_id = r.document_id)
  SELECT 0 AS task_id, candidate_id, document_id, url, origin, attempted, fetched, parsed, chunks > 0 AS indexed, chunks, eligible_chunks, candidates, accepted, rejected, claims,
    CASE WHEN NOT attempted THEN 'not_selected_low_priority' WHEN NOT fetched THEN CASE WHEN blocked THEN 'blocked_by_policy' ELSE 'fetch_failed' END WHEN NOT parsed THEN CASE WHEN mime_type NOT IN ('text/html', 'text/plain') THEN 'unsupported_content_type' ELSE 'parse_failed' END
      WHEN chunks = 0 THEN 'parse_failed' WHEN eligible_chunks = 0 THEN 'low_chunk_quality' WHEN candidates = 0 THEN 'no_evidence_candidates' WHEN accepted + claims = 0 THEN CASE WHEN rejected > 0 THEN 'evidence_rejected' ELSE 'off_intent' END END AS dropped_reason,
    CASE WHEN greatest(accepted, claims) >= 3 THEN 'high' WHEN greatest(accepted, claims) >= 1 THEN 'medium' WHEN candidates > 0 THEN 'low' ELSE 'none' END AS contribution FROM y"""


def source_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Each page as a candidate, each document that no page leads to, and what became of them."""
    doc = F.regexp_extract("url", r"/(\d{1,18})(?:[./?#]|$)", 1)
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(doc != "", doc.cast("long")).alias("doc")).withColumn("task_id", F.lit(0))
    texts = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    jobs = pages.join(table(spark, d, "labels"), F.col("doc") == F.col("doc_id")).select("id", F.col("id").alias("candidate_url_id"), F.when(F.col("quality") == 1, "SUCCEEDED").otherwise("FAILED").alias("status"), "toxic", "doc")
    attempts = jobs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select((F.col("id") * 2 + F.col("n")).alias("id"), F.col("id").alias("fetch_job_id"), "toxic", "doc")
    attempts = attempts.select("id", "fetch_job_id", (F.col("id") % 2 + 1).alias("attempt_no"), (F.col("toxic") == 1).alias("blocked"), "doc")
    mime = F.when(F.col("lang") == "de", "application/pdf").otherwise("text/html")
    snapshots = attempts.where("attempt_no = 2").join(texts.withColumnRenamed("doc_id", "doc"), "doc", "left").select(F.col("id").alias("fetch_attempt_id"), mime.alias("mime_type"))
    kept = texts.where("n_chars >= 100").withColumn("source_document_id", F.col("doc_id"))  # shorter texts were never parsed
    chunks = kept.where("n_chars > 200").select("source_document_id", (F.col("n_chars") >= 400).alias("eligible"))
    evidence = kept.where("n_chars > 300").select("source_document_id", (F.col("n_chars") % 3 == 0).alias("accepted"), (F.col("n_chars") % 3 == 1).alias("rejected"))
    yields = L.document_yield(chunks, evidence, kept.where("n_chars % 5 = 0").select("source_document_id"))
    url = lambda c: F.concat(F.lit("doc/"), F.col(c).cast("string")).alias("canonical_url")
    documents = kept.select(F.col("doc_id").alias("id"), F.lit(0).alias("task_id"), url("doc_id"))
    return L.lineage(pages.select("id", "task_id", url("doc")), L.latest_fetch(jobs, attempts, snapshots), documents, yields)


QUERIES["source_lineage"] = source_lineage
