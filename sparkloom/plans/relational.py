"""Queries over the ledger-like tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import relational as R
from sparkloom.operators import selection as S
from sparkloom.sources.tables import duplicates, table, upsert

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(table(spark, d, "orders"), F.col("o_orderstatus"), "status")


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'ok') AS code, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def error_code_distribution_ok_null(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return R.histogram(joined, F.coalesce(F.col("quality").cast("string"), F.lit("ok")), "code")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_recent_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.recent(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 50)


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 100")
def status_in_oldest_first(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return R.recent(orders, [F.col("o_orderdate"), F.col("o_orderkey")], 100, F.col("o_orderstatus").isin("O", "P"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], 100, 20)


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, max_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_turn_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn")


NUMBERED = "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_no FROM events"


@query(NUMBERED)
def event_dense_sequence(spark: SparkSession, d: str) -> DataFrame:
    numbered = R.numbered(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], F.col("ts"), F.col("event_id"))
    return numbered.drop("ts")


@query(f"SELECT * FROM ({NUMBERED}) WHERE sequence_no > 3")
def event_cursor_after(spark: SparkSession, d: str) -> DataFrame:
    return R.after(event_dense_sequence(spark, d), 3)


@query(f"SELECT user_id, max(sequence_no) AS last_event_sequence_no, count(*) AS events FROM ({NUMBERED}) GROUP BY user_id")
def event_sequence_backfill(spark: SparkSession, d: str) -> DataFrame:
    return event_dense_sequence(spark, d).groupBy("user_id").agg(F.max("sequence_no").alias("last_event_sequence_no"), F.count("*").alias("events"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_guard_having(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(table(spark, d, "lineitem"), ("l_orderkey", "l_partkey"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(*) AS items
  FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name""")
def distinct_over_chain_join(spark: SparkSession, d: str) -> DataFrame:
    """Items are summed by order before the joins, so the widest table is shuffled once, as counts."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    per_customer = orders.join(items, "o_orderkey").groupBy("c_custkey").agg(F.count("*").alias("orders"), F.sum("items").alias("items"))
    customers = per_customer.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    by_nation = customers.groupBy("n_nationkey").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"), F.sum("items").alias("items"))
    return by_nation.join(table(spark, d, "nation"), "n_nationkey").select("n_name", "customers", "orders", "items")


@query("""SELECT r_name, coalesce(o_orderpriority, 'unknown') AS priority, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY n DESC, r_name, priority LIMIT 60""")
def left_join_coalesce_topk(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = customers.select("c_custkey", "r_name").join(table(spark, d, "orders").select("o_custkey", "o_orderpriority"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return R.top_groups(joined, [F.col("r_name"), F.coalesce("o_orderpriority", F.lit("unknown"))], ["r_name", "priority"], 60)


@query("SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source ORDER BY n DESC, source LIMIT 40")
def anti_unparsed(spark: SparkSession, d: str) -> DataFrame:
    open_ = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return R.top_groups(open_, [F.col("source")], ["source"], 40)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_attempted(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_semi")


IDS = [7, 3, 11, 3, 999_999_999, 42, 7, 100]


@query("""SELECT o_orderkey, o_orderstatus, position::BIGINT AS position FROM orders JOIN (VALUES (7, 0), (3, 1), (11, 2), (42, 4), (100, 5), (999999999, 3)) v(k, position) ON k = o_orderkey""")
def ordered_id_selection(spark: SparkSession, d: str) -> DataFrame:
    return R.ordered_selection(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", IDS)


@query("SELECT 999999999::BIGINT AS o_orderkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 999999999)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_ids(table(spark, d, "orders"), "o_orderkey", [x for x in IDS if x > 1000])


@query("""SELECT l_suppkey, l_returnflag, max(l_discount) AS score FROM lineitem GROUP BY 1, 2""")
def evidence_upsert_max(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_best(table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_discount").alias("score")), ["l_suppkey", "l_returnflag"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status FROM orders""")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return upsert(old, old.where("status = 'P'").withColumn("status", F.lit("X")), ("o_orderkey",))


@query("""SELECT event_type AS value, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1 ORDER BY n DESC, first_at LIMIT 8""")
def most_common_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return R.most_common(table(spark, d, "events").select(F.col("event_type").alias("value"), "event_id"), "value", "event_id", 8)


@query("""SELECT doc_id, source, rank_in_group FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank_in_group FROM documents) WHERE rank_in_group <= 3""")
def per_source_cap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return S.per_group(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).drop("n_chars")


@query("""WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer),
  b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first FROM a)
  SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY turn, first) AS position FROM b""")
def round_robin_interleave(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return S.round_robin(customers, ["c_nationkey"], "c_mktsegment", [F.desc("c_acctbal"), F.col("c_custkey")]).drop("c_acctbal")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority LIKE '1%' AS must FROM orders),
  b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, must ORDER BY o_orderdate, o_orderkey) AS n FROM a)
  SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN must AND n <= 2 THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS position FROM b""")
def must_fetch_front(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    out = S.front(orders, ["o_custkey"], F.col("o_orderpriority").startswith("1"), [F.col("o_orderdate"), F.col("o_orderkey")], 2)
    return out.select("o_orderkey", "o_custkey", "position")


@query("""SELECT try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def json_payload_histogram(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").groupBy(k.alias("k"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) FILTER (WHERE value > 0) AS last_positive, count(*) AS events,
  count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY user_id""")
def observability_fold(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.max_by("event_type", at).alias("last_type"), F.max_by("value", F.when(F.col("value") > 0, at)).alias("last_positive"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "click").alias("clicks")
    )


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    by_hour = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return by_hour.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""")
def session_window(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


STATES = [("queued", "view", "running"), ("running", "click", "paused"), ("paused", "view", "running"), ("running", "purchase", "done"), ("paused", "purchase", "done")]


@query("""WITH t AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT coalesce(before, 'start') AS from_type, event_type AS to_type, count(*) AS n FROM t GROUP BY 1, 2""")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moved = table(spark, d, "events").select(F.coalesce(F.lag("event_type").over(w), F.lit("start")).alias("from_type"), F.col("event_type").alias("to_type"))
    return moved.groupBy("from_type", "to_type").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM orders GROUP BY 1""")
def precision_distribution(spark: SparkSession, d: str) -> DataFrame:
    high = F.when(F.col("o_totalprice") > 100000, 1.0).otherwise(0.0)
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.round(F.avg(high), 6).alias("rate"))


@query("""SELECT a.o_orderstatus AS left_status, b.o_orderstatus AS right_status, a.n - b.n AS delta FROM
  (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) a, (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) b WHERE a.o_orderstatus < b.o_orderstatus""")
def pairwise_deltas(spark: SparkSession, d: str) -> DataFrame:
    counts = status_distribution(spark, d)
    left, right = (counts.withColumnsRenamed({"status": f"{s}_status", "n": f"{s}_n"}) for s in ("left", "right"))
    return left.join(F.broadcast(right), F.col("left_status") < F.col("right_status")).select("left_status", "right_status", (F.col("left_n") - F.col("right_n")).alias("delta"))  # a row per status
