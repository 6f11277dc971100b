"""Queries of budgeted scans and resumable rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import rounds as R
from sparkloom.operators.containment import token_shares
from sparkloom.operators.spans import sentence_rows
from sparkloom.operators.verification import spread
from sparkloom.session import scratch
from sparkloom.sources.tables import table

QUERIES, SQL = {}, {}
FETCHES, SUCCESSES, AUTHORITATIVE = 50, 30, 3
BATCH, BATCHES, DOCUMENTS = 20, 4, 60


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fetch_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A source's documents in order of id: those with a label were fetched before, those with enough text succeed, English ones are authoritative."""
    labelled = table(spark, d, "labels").select("doc_id").distinct().withColumn("existing", F.lit(True))
    docs = table(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") >= 400).alias("success"), (F.col("lang") == "en").alias("authoritative"))
    return docs.join(labelled, "doc_id", "left").na.fill(False, ["existing"])


@query(f"""WITH c AS (SELECT source, d.doc_id AS doc_id, l.doc_id IS NOT NULL AS existing, coalesce(n_chars >= 400, false) AS success, coalesce(lang = 'en', false) AS authoritative FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
  s AS (SELECT *, count(*) FILTER (NOT existing) OVER w AS cb, count(*) FILTER (success) OVER w AS sb, count(*) FILTER (success AND authoritative) OVER w AS asb, count(*) FILTER (authoritative) OVER w AS ab, count(*) FILTER (authoritative) OVER (PARTITION BY source) AS all_
    FROM c WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT *, cb < {FETCHES} AND (sb < {SUCCESSES} OR (asb < {AUTHORITATIVE} AND ab < all_)) AS taken FROM s),
  g AS (SELECT source, count(*) FILTER (taken AND NOT existing) AS created, count(*) FILTER (taken AND existing) AS skipped_existing, count(*) FILTER (taken AND NOT existing AND success) AS succeeded,
    count(*) FILTER (taken AND NOT existing AND NOT success) AS failed, count(*) FILTER (taken AND success) AS successes, count(*) FILTER (NOT taken) AS unattempted, count(*) FILTER (taken AND sb >= {SUCCESSES}) AS continued FROM t GROUP BY source)
  SELECT *, CASE WHEN unattempted = 0 THEN 'no_unattempted_candidates' WHEN created >= {FETCHES} THEN 'fetch_budget_exhausted' WHEN successes >= {SUCCESSES} THEN 'success_target_met' ELSE 'unknown_early_exit' END AS stop_reason FROM g""")
def budgeted_fetch(spark: SparkSession, d: str) -> DataFrame:
    """What each source's scan fetches within a budget and a target, and why it stops."""
    scanned = R.budgeted(fetch_candidates(spark, d), ["source"], ["doc_id"], FETCHES, SUCCESSES, AUTHORITATIVE)
    return R.budget_summary(scanned, ["source"], FETCHES, SUCCESSES)


@query(f"""WITH c AS (SELECT source, d.doc_id AS doc_id, l.doc_id IS NOT NULL AS existing, coalesce(n_chars >= 400, false) AS success, coalesce(lang = 'en', false) AS authoritative FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
  s AS (SELECT *, count(*) FILTER (NOT existing) OVER w AS created_before, count(*) FILTER (success) OVER w AS successes_before, count(*) FILTER (success AND authoritative) OVER w AS asb, count(*) FILTER (authoritative) OVER w AS ab, count(*) FILTER (authoritative) OVER (PARTITION BY source) AS all_
    FROM c WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT source, doc_id, existing, success, authoritative, created_before, successes_before, created_before < {FETCHES} AND (successes_before < {SUCCESSES} OR (asb < {AUTHORITATIVE} AND ab < all_)) AS taken FROM s""")
def fetch_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every document of each source's scan: what was fetched before it, and whether the scan takes it."""
    out = R.budgeted(fetch_candidates(spark, d), ["source"], ["doc_id"], FETCHES, SUCCESSES, AUTHORITATIVE)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("source", "doc_id", "existing", flag("success"), flag("authoritative"), "created_before", "successes_before", "taken")


@query(f"""WITH c AS (SELECT coalesce(source, '') AS task_id, coalesce(n_chars >= 400, false) AS ok, (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1) // {BATCH} + 1 AS b FROM documents),
  n AS (SELECT task_id, b, count(*) AS rows_, count(*) FILTER (ok) AS new FROM c GROUP BY 1, 2),
  s AS (SELECT *, sum(new) OVER w AS created, sum(rows_) OVER w AS worked, sum(rows_) OVER (PARTITION BY task_id) AS all_, max(b) OVER (PARTITION BY task_id) AS last FROM n WINDOW w AS (PARTITION BY task_id ORDER BY b)),
  r AS (SELECT *, CASE WHEN last <= b THEN 'fully_drained' WHEN b >= {BATCHES} THEN 'max_batches' WHEN created >= {DOCUMENTS} THEN 'target_documents' WHEN new = 0 THEN 'no_progress' END AS reason FROM s)
  SELECT task_id, min(b)::INTEGER AS batches, arg_min(created, b)::BIGINT AS created, arg_min(all_ - worked, b)::BIGINT AS "left", arg_min(reason, b) AS stop_reason FROM r WHERE reason IS NOT NULL GROUP BY task_id""")
def parse_drain(spark: SparkSession, d: str) -> DataFrame:
    """Each source's documents parsed in batches until there are enough, nothing comes of a batch, or all are done."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("task_id"), "doc_id", "n_chars")
    work = lambda batch: batch.select("task_id", "doc_id", F.coalesce(F.col("n_chars") >= 400, F.lit(False)).alias("created"))
    ledger = R.Ledger(spark, scratch(spark, "drain"))
    return R.drain(ledger, docs, ["doc_id"], work, BATCH, BATCHES, DOCUMENTS)[1]


#: The least share of a statement's tokens that a document must have, by round.
SHARES = (0.8, 0.6, 0.45)


def research(spark: SparkSession, d: str, ledger: R.Ledger) -> tuple[DataFrame, DataFrame]:
    """Items of the benchmark as tasks, their sentences as slots. Each round asks for documents with a smaller share of a sentence's tokens."""
    said = sentence_rows(table(spark, d, "benchmark").select("item_id", "text"), "item_id")
    path = scratch(spark, "slots")
    said.select(F.col("item_id").alias("task_id"), F.col("span_no").alias("slot_id"), (F.col("span_no") < 4).alias("required"), F.lower("excerpt").alias("said")).write.parquet(path)
    slots = spark.read.parquet(path)
    docs = spread(table(spark, d, "documents").select("doc_id", F.lower("text").alias("low")))
    number = F.col("task_id") * 100_000 + F.col("slot_id")

    # The documents are read once, at the last round's share; each round looks at what its own share admits. What says a whole statement is known from there too.
    wanted = slots.select("task_id", "slot_id", number.alias("query"), T.token_set(F.col("said")).alias("tokens"), "said")

    def scan(pending: DataFrame) -> DataFrame:
        own = wanted.join(pending, "task_id", "left_semi")
        found = token_shares(own, docs, ["doc_id"], "low", SHARES[-1], phrase_col="said")
        return found.join(own.select("query", "task_id", "slot_id"), "query").select("task_id", "slot_id", F.col("doc_id").alias("source_id"), "share", "whole")

    scanned = ledger.run("scan", 0, slots.select("task_id"), scan)

    def search(r: int, asked: DataFrame) -> DataFrame:
        found = scanned.where(F.col("share") >= SHARES[r - 1]).join(asked, ["task_id", "slot_id"], "left_semi")
        return found.select("task_id", "slot_id", "source_id", F.round("share", 4).alias("rank"))

    def read(r: int, chosen: DataFrame) -> DataFrame:
        known = chosen.join(scanned.select("task_id", "slot_id", "source_id", "whole"), ["task_id", "slot_id", "source_id"])
        return known.select("task_id", "slot_id", "source_id", F.when(F.col("whole"), "support").when(F.col("rank") >= 0.7, "weak_support").otherwise("none").alias("relation"))

    return R.gap_rounds(ledger, slots.select("task_id", "slot_id", "required"), search, read, len(SHARES), 5, 3)


@query()
def gap_rounds(spark: SparkSession, d: str) -> DataFrame:
    """How many rounds each task needs until its required statements are covered, and why it stops."""
    coverage, tasks = research(spark, d, R.Ledger(spark, scratch(spark, "research")))
    counted = coverage.groupBy("task_id").agg(F.count("*").alias("slots"), F.count_if(F.col("status") == "covered").alias("covered"), F.count_if(F.col("status") == "weak").alias("weak"), F.count_if(F.col("status") == "missing").alias("missing"))
    return tasks.join(counted, "task_id")
