"""Queries of event-log metrics and of the whole funnel."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import eventlog as E
from sparkloom.sources.tables import table

QUERIES, SQL = {}, {}
SCANNED = (30, 8, 12)  # events, batch summaries and fallbacks scanned, so that the limits take effect on the supplied events


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# What an event of each kind carries: parse decisions, batch summaries, fallbacks, and payloads that are no object or have fields of another type.
LOG = """SELECT user_id AS task_id, event_id AS sequence_no, CASE event_type WHEN 'view' THEN 'parsing.stage_completed' WHEN 'click' THEN 'acquisition.fetch_batch_summary' WHEN 'error' THEN 'acquisition.browser_fallback' ELSE event_type END AS event_type,
  CASE event_type WHEN 'view' THEN concat('{"result":{"parse_decisions":[{"decision":"', CASE k % 3 WHEN 0 THEN 'parsed' WHEN 1 THEN 'rejected' ELSE '' END, '","status":"', CASE WHEN k % 2 = 0 THEN 'SKIPPED' ELSE 'OK' END, '","reason":"r', k % 4, '"},{"decision":"parsed","reason":"x"}]},"details":',
      CASE WHEN k % 5 = 0 THEN '{"parse_decisions":[{"decision":"d","status":"FAILED","reason":"late"}]}' ELSE '"none"' END, '}')
    WHEN 'click' THEN concat('{"stop_reason":"', CASE k % 4 WHEN 0 THEN 'fetch_budget_exhausted' WHEN 1 THEN 'success_target_met' WHEN 2 THEN '' ELSE 'unknown_early_exit' END, '","unattempted_candidate_ids":["c', k % 7, '","c', k % 5, '"],"success_target_continue_count":', k % 3 - 1, '}')
    WHEN 'error' THEN concat('{"browser_fallback_considered":', CASE WHEN k % 3 > 0 THEN 'true' ELSE 'false' END, ',"browser_fallback_attempted":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'null' END, ',"browser_fallback_result":"', CASE k % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'none' END, '"}')
    WHEN 'signup' THEN 'not json' ELSE '{}' END AS payload_json FROM ({events})"""
ALL, BATCHES, FALLBACKS = SCANNED
SHOWN = "coalesce((SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM {0} h WHERE h.task_id = c.task_id), '')"


@query(f"""WITH log AS ({LOG.replace("{events}", "SELECT *, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events")}),
  j AS (SELECT *, CASE WHEN json_valid(payload_json) THEN payload_json::JSON ELSE '{{}}'::JSON END AS p, row_number() OVER (PARTITION BY task_id ORDER BY sequence_no DESC) AS nr, row_number() OVER (PARTITION BY task_id, event_type ORDER BY sequence_no DESC) AS tr, row_number() OVER (PARTITION BY task_id, event_type ORDER BY sequence_no) AS ar FROM log),
  b AS (SELECT * FROM j WHERE event_type = 'acquisition.fetch_batch_summary' AND tr <= {BATCHES}), f AS (SELECT *, p->>'browser_fallback_considered' = 'true' AS co, coalesce(p->>'browser_fallback_attempted' = 'true', false) AS att, p->>'browser_fallback_result' AS res FROM j WHERE event_type = 'acquisition.browser_fallback' AND tr <= {FALLBACKS}),
  d AS (SELECT task_id, unnest(list_concat(from_json(p->'result'->'parse_decisions', '[{{"decision":"VARCHAR","status":"VARCHAR","reason":"VARCHAR"}}]'), from_json(CASE WHEN json_type(p->'details') = 'OBJECT' THEN p->'details'->'parse_decisions' END, '[{{"decision":"VARCHAR","status":"VARCHAR","reason":"VARCHAR"}}]'))) AS d FROM j WHERE nr <= {ALL}),
  hd AS (SELECT task_id, d.decision AS v, count(*) AS n FROM d WHERE d.decision <> '' GROUP BY ALL), hr AS (SELECT task_id, d.reason AS v, count(*) AS n FROM d WHERE d.reason <> '' AND (d.status IN ('SKIPPED', 'FAILED') OR d.decision <> 'parsed') GROUP BY ALL),
  hs AS (SELECT task_id, p->>'stop_reason' AS v, count(*) AS n FROM b WHERE p->>'stop_reason' <> '' GROUP BY ALL),
  cs AS (SELECT task_id, sequence_no, p->>'stop_reason' AS s, unnest(from_json(p->'unattempted_candidate_ids', '["VARCHAR"]')) AS c FROM j WHERE event_type = 'acquisition.fetch_batch_summary' AND ar <= {BATCHES}),
  hc AS (SELECT task_id, s AS v, count(*) AS n FROM (SELECT task_id, c, arg_max(s, sequence_no) AS s FROM cs GROUP BY ALL) WHERE s <> '' GROUP BY ALL),
  c AS (SELECT task_id, count(*) AS events FROM j GROUP BY task_id),
  bb AS (SELECT task_id, count(*) AS n, sum(greatest(0, (p->>'success_target_continue_count')::BIGINT)) AS k FROM b GROUP BY task_id),
  ff AS (SELECT task_id, count(*) AS n, count(*) FILTER (co) AS co, count(*) FILTER (att) AS att, count(*) FILTER (res = 'succeeded') AS ok, count(*) FILTER (res = 'failed') AS bad, count(*) FILTER (co AND NOT att) AS sk FROM f GROUP BY task_id)
  SELECT c.task_id AS task_id, events, coalesce(bb.n, 0) AS batch_summaries, coalesce(bb.k, 0)::BIGINT AS success_target_continued, coalesce(ff.n, 0) AS fallback_events, coalesce(co, 0) AS fallback_considered, coalesce(att, 0) AS fallback_attempted, coalesce(ok, 0) AS fallback_succeeded,
    coalesce(bad, 0) AS fallback_failed, coalesce(sk, 0) AS fallback_skipped, {SHOWN.format('hs')} AS stop_reasons, {SHOWN.format('hd')} AS parser_decisions, {SHOWN.format('hr')} AS parser_rejections, {SHOWN.format('hc')} AS unattempted_candidates FROM c LEFT JOIN bb USING (task_id) LEFT JOIN ff USING (task_id)""")
def event_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What each user's newest events say of parsing, fetch batches and fallbacks, with histograms as texts."""
    events = table(spark, d, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)))
    view = f"events_{uuid.uuid4().hex}"
    events.createOrReplaceTempView(view)
    log = spark.sql(LOG.replace("{events}", f"SELECT * FROM {view}"))
    spark.catalog.dropTempView(view)
    found = E.metrics(log, *SCANNED)
    shown = {c: F.concat_ws(",", F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))) for c in ("stop_reasons", "parser_decisions", "parser_rejections", "unattempted_candidates")}
    return found.withColumns(shown)


# A nation's customers are candidates, their orders jobs, lines attempts; shipped lines have snapshots, every third line's has a document.
FUNNEL = """candidates AS (SELECT c_custkey AS id, c_nationkey AS task_id FROM customer), jobs AS (SELECT o_orderkey AS id, c_nationkey AS task_id, o_custkey AS candidate_url_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM orders JOIN customer ON c_custkey = o_custkey),
  attempts AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS fetch_job_id, CASE l_returnflag WHEN 'R' THEN 'body_too_large' WHEN 'A' THEN 'timeout' END AS error_code, l_linenumber, l_linestatus, l_quantity FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)),
  snapshots AS (SELECT id, id AS fetch_attempt_id FROM attempts WHERE l_linestatus = 'F'),
  documents AS (SELECT a.id AS id, task_id, a.id AS content_snapshot_id, l_quantity FROM attempts a JOIN jobs j ON j.id = fetch_job_id WHERE l_linestatus = 'F' AND l_linenumber % 3 = 0),
  chunks AS (SELECT d.id AS source_document_id FROM documents d JOIN (VALUES (1), (2), (3)) v(i) ON l_quantity > 12 * i)"""


@query(f"""WITH {FUNNEL}, s AS (SELECT s.id AS id, task_id, candidate_url_id FROM snapshots s JOIN attempts a ON a.id = s.fetch_attempt_id JOIN jobs j ON j.id = a.fetch_job_id),
  n AS (SELECT task_id, (SELECT count(*) FROM supplier WHERE s_nationkey = task_id) AS search_query, (SELECT count(*) FROM candidates c WHERE c.task_id = t.task_id) AS candidate_url, (SELECT count(*) FROM jobs j WHERE j.task_id = t.task_id) AS fetch_job,
    (SELECT count(*) FROM jobs j WHERE j.task_id = t.task_id AND status = 'SUCCEEDED') AS successful_fetch_job, (SELECT count(DISTINCT candidate_url_id) FROM jobs j WHERE j.task_id = t.task_id) AS candidates_with_any_fetch_job,
    (SELECT count(*) FROM attempts a JOIN jobs j ON j.id = fetch_job_id WHERE j.task_id = t.task_id) AS fetch_attempt, (SELECT count(error_code) FROM attempts a JOIN jobs j ON j.id = fetch_job_id WHERE j.task_id = t.task_id) AS failed_attempt,
    (SELECT count(*) FROM attempts a JOIN jobs j ON j.id = fetch_job_id WHERE j.task_id = t.task_id AND error_code = 'body_too_large') AS body_too_large, (SELECT count(*) FROM s WHERE s.task_id = t.task_id) AS content_snapshot,
    (SELECT count(DISTINCT candidate_url_id) FROM s WHERE s.task_id = t.task_id) AS candidates_with_snapshot, (SELECT count(*) FROM s JOIN documents d ON d.content_snapshot_id = s.id WHERE s.task_id = t.task_id) AS snapshots_with_source_document,
    (SELECT count(*) FROM documents d WHERE d.task_id = t.task_id) AS source_document, (SELECT count(*) FROM chunks JOIN documents d ON d.id = source_document_id WHERE d.task_id = t.task_id) AS source_chunk,
    (SELECT count(DISTINCT source_document_id) FROM chunks JOIN documents d ON d.id = source_document_id WHERE d.task_id = t.task_id) AS documents_with_chunks, (SELECT count(*) FROM part WHERE p_size % 25 = task_id) AS claim,
    (SELECT count(*) FROM part WHERE p_size % 25 = task_id AND p_retailprice > 1400) AS supported_claim, (SELECT count(*) FROM customer WHERE c_nationkey = task_id AND c_acctbal > 9000) AS report_artifact FROM (SELECT n_nationkey AS task_id FROM nation) t)
  SELECT *, greatest(0, candidate_url - candidates_with_any_fetch_job) AS candidates_without_fetch_job, content_snapshot - snapshots_with_source_document AS unparsed_snapshots, CASE WHEN candidate_url > 0 THEN round(candidates_with_snapshot / candidate_url, 6) END AS candidate_url_to_snapshot_rate,
    CASE WHEN content_snapshot > 0 THEN round(snapshots_with_source_document / content_snapshot, 6) END AS snapshot_to_document_rate, CASE WHEN source_document > 0 THEN round(documents_with_chunks / source_document, 6) END AS document_to_chunk_rate
  FROM n WHERE search_query + candidate_url + claim + report_artifact > 0""")
def acquisition_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's way from queries to reports."""
    t = lambda name: table(spark, d, name)
    candidates = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("task_id"))
    jobs = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("task_id"), F.col("o_custkey").alias("candidate_url_id"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"))
    code = F.when(F.col("l_returnflag") == "R", "body_too_large").when(F.col("l_returnflag") == "A", "timeout")
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity")])  # a number may stand twice in an order
    attempts = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("fetch_job_id"), code.alias("error_code"), "l_linenumber", "l_linestatus", "l_quantity")
    shipped = attempts.where("l_linestatus = 'F'")
    snapshots = shipped.select("id", F.col("id").alias("fetch_attempt_id"))
    documents = shipped.where("l_linenumber % 3 = 0").join(jobs.select(F.col("id").alias("fetch_job_id"), "task_id"), "fetch_job_id").select("id", "task_id", F.col("id").alias("content_snapshot_id"), "l_quantity")
    chunks = documents.select(F.col("id").alias("source_document_id"), F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.col("l_quantity") > i * 12)).alias("i"))
    claims = t("part").select((F.col("p_size") % 25).alias("task_id"), F.when(F.col("p_retailprice") > 1400, "supported").otherwise("unsupported").alias("verification_status"))
    artifacts = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("task_id"))
    return E.funnel(t("supplier").select(F.col("s_nationkey").alias("task_id")), candidates, jobs, attempts, snapshots, documents, chunks, claims, artifacts)
