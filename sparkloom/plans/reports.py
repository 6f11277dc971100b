"""Funnel, yield, gap, score and report queries, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.operators import coverage as C
from sparkloom.operators import reporting as R
from sparkloom.operators import verification as V
from sparkloom.plans import evidence
from sparkloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FUNNEL = """SELECT 'candidates' AS step, count(*) AS n FROM customer UNION ALL SELECT 'candidates_with_job', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'jobs', count(*) FROM orders
  UNION ALL SELECT 'attempts', count(*) FROM lineitem UNION ALL SELECT 'succeeded', count(*) FROM lineitem WHERE l_returnflag <> 'R'"""


@query(FUNNEL)
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    steps = {"candidates": table(spark, d, "customer"), "candidates_with_job": orders.select("o_custkey").distinct(), "jobs": orders, "attempts": items, "succeeded": items.where("l_returnflag <> 'R'")}
    return R.funnel(steps)


@query(f"""WITH f AS ({FUNNEL}), v AS (SELECT max(n) FILTER (step = 'candidates') AS c, max(n) FILTER (step = 'candidates_with_job') AS j, max(n) FILTER (step = 'attempts') AS a, max(n) FILTER (step = 'succeeded') AS s FROM f)
  SELECT round(j / c, 6) AS job_rate, round(s / a, 6) AS success_rate FROM v""")
def funnel_rates(spark: SparkSession, d: str) -> DataFrame:
    return R.rates(funnel_counts(spark, d), {"job_rate": ("candidates_with_job", "candidates"), "success_rate": ("succeeded", "attempts")})


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'budget_exhausted' WHEN c_mktsegment = 'MACHINERY' THEN 'low_priority' ELSE 'not_selected' END AS reason, count(*) AS n
  FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') GROUP BY 1""")
def not_fetched_reasons(spark: SparkSession, d: str) -> DataFrame:
    tried = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    left = table(spark, d, "customer").join(tried, "c_custkey", "left_anti")
    reason = R.first_that_holds((F.col("c_acctbal") < 0, "budget_exhausted"), (F.col("c_mktsegment") == "MACHINERY", "low_priority"), rest="not_selected")
    return left.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH y AS (SELECT s_suppkey, count(l_orderkey) AS candidates, count(*) FILTER (l_returnflag = 'N') AS accepted, count(*) FILTER (l_returnflag = 'R') AS rejected, count(DISTINCT l_partkey) AS claims
    FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)
  SELECT *, CASE WHEN candidates = 0 THEN 'no_candidates' WHEN accepted = 0 AND rejected = candidates THEN 'all_rejected' WHEN accepted = 0 THEN 'none_selected' END AS dropped_reason,
    CASE WHEN greatest(accepted, claims) >= 3 THEN 'high' WHEN greatest(accepted, claims) >= 1 THEN 'medium' WHEN candidates > 0 THEN 'low' ELSE 'none' END AS contribution FROM y""")
def source_yield(spark: SparkSession, d: str) -> DataFrame:
    """Pairs are counted by (supplier, part) first, so a busy supplier is combined before its shuffle."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    per = items.groupBy("s_suppkey").agg(F.sum("n").alias("candidates"), F.sum("a").alias("accepted"), F.sum("r").alias("rejected"), F.count("*").alias("claims"))
    out = table(spark, d, "supplier").select("s_suppkey").join(per, "s_suppkey", "left").na.fill(0)
    none = F.col("accepted") == 0
    reason = R.first_that_holds((F.col("candidates") == 0, "no_candidates"), (none & (F.col("rejected") == F.col("candidates")), "all_rejected"), (none, "none_selected"))
    return out.withColumns({"dropped_reason": reason, "contribution": C.contribution(F.col("accepted"), F.col("claims"), F.col("candidates"))})


ASKED = "which places of the document say this"


@query(f"""WITH q AS (SELECT list_distinct({evidence.TOKENS.format(f"'{ASKED}'")}) AS q) SELECT item_id, round(least(0.95::DOUBLE, greatest(0.35::DOUBLE,
    0.45::DOUBLE + (len(list_intersect(q, list_distinct({evidence.TOKENS.format('text')}))) / len(q)) * 0.3::DOUBLE + (least(length(text), 240) / 240) * 0.15::DOUBLE)), 6) AS confidence FROM benchmark, q""")
def claim_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.round(scores.confidence(F.lit(ASKED), F.col("text"), F.lit(None).cast("double")), 6).alias("confidence"))


@query("""SELECT CASE WHEN age <= 90 THEN 0.95 WHEN age <= 365 THEN 0.75 WHEN age <= 1095 THEN 0.45 ELSE 0.25 END::DOUBLE AS freshness, count(*) AS n
  FROM (SELECT date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS age FROM orders) GROUP BY 1""")
def freshness_histogram(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("1998-12-31").cast("date")
    return table(spark, d, "orders").groupBy(scores.freshness(F.col("o_orderdate"), as_of).alias("freshness")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT CASE l_returnflag WHEN 'R' THEN 403 WHEN 'A' THEN 429 ELSE CASE WHEN l_tax > 0.07 THEN 500 ELSE 200 END END AS status, CASE WHEN l_linestatus = 'F' THEN 'Image/PNG; x=1' END AS mime, l_linenumber - 1 AS body FROM lineitem)
  SELECT coalesce(CASE WHEN status = 200 THEN CASE WHEN body = 0 THEN 'empty_response' WHEN mime IS NOT NULL THEN 'unsupported_mime' END WHEN status = 403 THEN 'status_403' WHEN status = 429 THEN 'status_429' ELSE 'http_error_status' END, 'ok') AS code, count(*) AS n FROM r GROUP BY 1""")
def http_outcomes(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", 403).when(F.col("l_returnflag") == "A", 429).when(F.col("l_tax") > 0.07, 500).otherwise(200)
    code = scores.http_outcome(status, F.when(F.col("l_linestatus") == "F", "Image/PNG; x=1"), F.col("l_linenumber") - 1)
    return table(spark, d, "lineitem").groupBy(F.coalesce(code, F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


@query(r"""WITH e AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]+/.*\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)
  SELECT page_id, CASE WHEN e IN ('html', 'htm') THEN 'text/html' WHEN e = 'md' THEN 'text/markdown' WHEN e = 'txt' THEN 'text/plain' WHEN e = 'pdf' THEN 'application/pdf' WHEN e = 'json' THEN 'application/json' ELSE 'application/octet-stream' END AS mime FROM e""")
def page_mime(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", scores.mime_of(F.col("url"), F.lit(None).cast("string")).alias("mime"))


@query("""WITH m AS (SELECT event_id, json_merge_patch(props, '{"source":"replay"}') AS j FROM events) SELECT event_id, json_extract_string(j, '$.k') AS k, json_extract_string(j, '$.source') AS source FROM m""")
def payload_merge(spark: SparkSession, d: str) -> DataFrame:
    j = scores.merged(F.col("props"), F.lit('{"source":"replay"}'))
    return table(spark, d, "events").select("event_id", j.alias("j")).select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.source").alias("source"))


@query("""SELECT item_id, position::INTEGER AS position, kind, query FROM (SELECT item_id, unnest([0, 1, 2]) AS position, unnest(['base', 'site', 'site']) AS kind, unnest([trim(text), 'site:example.org ' || trim(text), 'site:example.com ' || trim(text)]) AS query FROM benchmark WHERE trim(text) <> '')""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return R.expand_queries(table(spark, d, "benchmark"), "item_id", "text", ["example.org", " Example.com ", "example.org", ""], 3)


SLOTS = """SELECT source AS slot_id, true AS required, CASE WHEN count(quality) FILTER (quality = 1) > 0 AND count(*) FILTER (toxic = 1) = 0 THEN 'covered' WHEN count(quality) > 0 THEN 'weak' ELSE 'missing' END AS status
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""


@query(f"""WITH s AS ({SLOTS}), v AS (SELECT slot_id, status, unnest([0, 1]) AS pos, slot_id || ' ' || unnest(['overview', 'evidence']) AS query FROM s WHERE status <> 'covered')
  SELECT slot_id, status, query FROM v WHERE query NOT IN (SELECT DISTINCT source || ' overview' FROM documents WHERE lang = 'en') ORDER BY status = 'weak', pos, slot_id LIMIT 4""")
def gap_queries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    counted = docs.join(table(spark, d, "labels"), "doc_id", "left").groupBy(F.col("source").alias("slot_id")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count("quality").alias("known"), F.count_if(F.col("toxic") == 1).alias("bad"))
    status = F.when((F.col("good") > 0) & (F.col("bad") == 0), "covered").when(F.col("known") > 0, "weak").otherwise("missing")
    slots = counted.select("slot_id", F.lit(True).alias("required"), status.alias("status"))
    asked = docs.where("lang = 'en'").select(F.concat("source", F.lit(" overview")).alias("query")).distinct()
    return R.supplemental(slots, ["overview", "evidence"], asked, 4)


@query(f"SELECT status, count(*) AS n, sum(support)::BIGINT AS support, sum(weak_support)::BIGINT AS weak_support, sum(contradict)::BIGINT AS contradict FROM ({evidence.SQL['verification_status']}) GROUP BY status")
def verification_totals(spark: SparkSession, d: str) -> DataFrame:
    found = evidence.QUERIES["verification_status"](spark, d)
    return found.groupBy("status").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("support", "weak_support", "contradict")])


@query("""WITH b AS (SELECT o_orderpriority, o_orderkey // 1000 AS block, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1, 2),
  h AS (SELECT *, 'sha256:' || sha256(ids) AS block_hash FROM b),
  u AS (SELECT o_orderpriority, block // 1000 AS u, sum(n) AS n, 'sha256:' || sha256(string_agg(block_hash, ',' ORDER BY block)) AS upper_hash FROM h GROUP BY 1, 2),
  w AS (SELECT o_orderpriority, sum(n)::BIGINT AS claims, 'sha256:' || sha256(string_agg(upper_hash, ',' ORDER BY u)) AS content_hash FROM u GROUP BY 1)
  SELECT o_orderpriority, block, n, ids, block_hash, claims, content_hash FROM h JOIN w USING (o_orderpriority)""")
def report_manifest(spark: SparkSession, d: str) -> DataFrame:
    return R.manifest(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2),
  l AS (SELECT l_orderkey AS k, arg_max(l_returnflag, l_linenumber) AS h, max(l_linenumber) AS v FROM a GROUP BY 1)
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE 'R' END AS content_hash, (CASE WHEN h = CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE 'R' END THEN v ELSE coalesce(v, 0) + 1 END)::BIGINT AS version,
    coalesce(h = CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE 'R' END, false) AS reused FROM orders LEFT JOIN l ON k = o_orderkey""")
def artifact_versions(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers stand for versions; they can repeat in an order, so one row of each is kept."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("version")).agg(F.max("l_returnflag").alias("content_hash"))
    new = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "N").otherwise("R").alias("content_hash"))
    return R.next_version(items, new, ["o_orderkey"])


@query(f"""WITH c AS (SELECT status, item_id, span_no, text FROM ({evidence.SQL['verification_status']}) JOIN benchmark USING (item_id)), n AS (SELECT status, count(*) AS n FROM c GROUP BY 1)
  SELECT '' AS section, 0 AS part, 0::BIGINT AS position, '# Statements and their evidence' AS line UNION ALL SELECT status, 0, 0, '## ' || status FROM n UNION ALL SELECT status, 1, 0, n || ' claims' FROM n
  UNION ALL SELECT status, 2, item_id, '- ' || regexp_replace(text, '\\s+', ' ', 'g') || ' [' || item_id || ']' FROM c""")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    found = V.written(evidence.QUERIES["verification_status"](spark, d), "status")  # a row a statement, read three times
    claims = found.join(table(spark, d, "benchmark"), "item_id")
    return R.markdown("Statements and their evidence", claims, "status", "text", "item_id")


@query("""WITH b AS (SELECT event_type, value, time_bucket(INTERVAL '30 minutes', ts) AS b FROM events)
  SELECT start, event_type, count(*) AS n FROM (SELECT event_type, b AS start FROM b UNION ALL SELECT event_type, b - INTERVAL '30 minutes' FROM b) GROUP BY 1, 2""")
def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
