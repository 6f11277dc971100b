"""Queries over documents, pages and statements, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import web
from sparkloom.functions.scores import evidence_rank
from sparkloom.operators import coverage as C
from sparkloom.operators import diversify as D
from sparkloom.operators import reuse as R
from sparkloom.operators import selection as S
from sparkloom.operators import spans
from sparkloom.operators import verification as V
from sparkloom.operators.containment import token_shares
from sparkloom.sources.tables import table

QUERIES, SQL = {}, {}
GENERIC = ", ".join(f"'{t}'" for t in T.GENERIC_TOKENS)
SCOPE = ", ".join(f"'{t}'" for t in T.SCOPE_TERMS)
Q_NEGATION = T.NEGATION.replace("'", "''")
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda t: lower(t))"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def sentences(table_name: str, id_col: str) -> str:
    found = f"list_filter(list_transform(regexp_extract_all(text, '[^\\n.!?。！？]+(?:[.!?。！？]+)?'), lambda s: trim(s)), lambda s: s <> '')"
    return f"(SELECT {id_col}, unnest(range(len(f))) AS span_no, unnest(f) AS excerpt FROM (SELECT {id_col}, {found} AS f FROM {table_name}))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, span_no, excerpt FROM {sentences('documents', 'doc_id')}")
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.sentence_rows(table(spark, d, "documents"), "doc_id")


@query(f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(list_filter(list_distinct(t), lambda x: length(x) > 2 AND x NOT IN ({GENERIC}))) AS n_meaningful,
  greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS token_estimate FROM (SELECT doc_id, text, {TOKENS.format('text')} AS t FROM documents)""")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("t"))
    size = lambda c: F.size(c).cast("long")
    return t.select("doc_id", size("t").alias("n_tokens"), size(F.array_distinct("t")).alias("n_distinct"), size(T.meaningful(F.array_distinct("t"))).alias("n_meaningful"), T.token_estimate(F.col("text")).alias("token_estimate"))


@query(f"SELECT sha256(lower({SQUEEZE.format('excerpt')})) AS excerpt_hash, count(*) AS n, min(doc_id) AS first_doc FROM {sentences('documents', 'doc_id')} GROUP BY 1")
def excerpt_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sentence_spans(spark, d).groupBy(T.excerpt_hash(F.col("excerpt")).alias("excerpt_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT identity, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, regexp_replace(lower(excerpt), '[^0-9a-zA-Z一-鿿]+', '', 'g') AS identity FROM {sentences('documents', 'doc_id')}) GROUP BY 1")
def claim_identity_dedup(spark: SparkSession, d: str) -> DataFrame:
    return spans.sentence_identities(table(spark, d, "documents"), "doc_id").groupBy("identity").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT doc_id, span_no, 'ec_' || substr(sha256(doc_id || ':' || span_no || ':' || excerpt), 1, 24) AS candidate_id FROM {sentences('documents', 'doc_id')}")
def candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    return sentence_spans(spark, d).select("doc_id", "span_no", T.candidate_id(F.col("doc_id"), F.col("span_no"), F.col("excerpt")).alias("candidate_id"))


@query(f"""SELECT item_id, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS overlap FROM
  (SELECT item_id, list_distinct({TOKENS.format('text')}) AS a, list_distinct({TOKENS.format("lag(text, 1, '') OVER (ORDER BY item_id)")}) AS b FROM benchmark)""")
def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each item against the one before it; a table of statements, ordered whole."""
    before = F.lag("text", 1, "").over(Window.orderBy("item_id"))
    pairs = table(spark, d, "benchmark").select("item_id", T.token_set(F.col("text")).alias("a"), before.alias("before"))
    return pairs.select("item_id", F.round(T.overlap_ratio(F.col("a"), T.token_set(F.col("before"))), 6).alias("overlap"))


HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"


@query(f"""SELECT page_id, domain, (domain = 'example.com' OR domain LIKE '%.example.com' OR domain = 'example.org' OR domain LIKE '%.example.org') AND NOT
  (domain = 'ads-track.example.com' OR domain LIKE '%.ads-track.example.com') AS allowed FROM (SELECT page_id, {HOST} AS domain FROM pages)""")
def domain_allow_deny(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", web.host(F.col("url")).alias("domain"))
    return pages.withColumn("allowed", web.domain_allowed(F.col("domain"), ["example.com", "example.org"], ["ads-track.example.com"]))


@query()
def url_canonical_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each canonical URL, and how many there are."""
    pages = table(spark, d, "pages").select("page_id", web.canonical_url("url").alias("c"))
    return pages.groupBy("c.canonical_url", "c.domain").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


SCRIPT_SQL, STYLE_SQL = "(?is)<script\\b[^>]*>.*?</script>", "(?is)<style\\b[^>]*>.*?</style>"


@query(f"""WITH a AS (SELECT page_id, html, lower(html) AS low, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{SCRIPT_SQL}', ' ', 'g'), '{STYLE_SQL}', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages),
  b AS (SELECT *, length(t) AS v, list_sum(list_transform(regexp_extract_all(html, '{SCRIPT_SQL}'), lambda s: length(s))) AS sl, len(regexp_extract_all(html, '(?i)<a\\b')) AS links,
    greatest(1, len(list_filter(string_split(t, ' '), lambda w: w <> ''))) AS words FROM a)
  SELECT page_id, v AS visible_text_length, len(regexp_extract_all(html, '(?i)<p\\b')) AS paragraph_count, round(coalesce(sl, 0) / greatest(length(html), 1), 6) AS script_to_text_ratio, round(links / words, 6) AS link_density,
  v < 220 AND (contains(low, 'id="app"') OR contains(low, 'id=''app''') OR contains(low, '__next_data__') OR ((contains(low, 'reactdom') OR contains(low, 'data-reactroot')) AND coalesce(sl, 0) / greatest(length(html), 1) > 0.02)) AS likely_spa_shell,
  v < 320 AND ((contains(low, '<noscript') AND contains(low, 'javascript')) OR regexp_matches(low, '{web.JAVASCRIPT_PHRASES}')) AS likely_javascript_required,
  v < 260 AND regexp_matches(low, '{web.COOKIE_PHRASES}') AS likely_cookie_wall, v < 900 AND regexp_matches(low, '{web.BOT_PHRASES}') AS likely_bot_check FROM b""")
def html_quality_signals(spark: SparkSession, d: str) -> DataFrame:
    q = web.html_quality(F.col("html"))
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in q.items()])


@query(f"""SELECT page_id, CASE WHEN likely_bot_check THEN 'bot_check' WHEN likely_cookie_wall THEN 'cookie_wall' WHEN likely_javascript_required AND visible_text_length < 200 THEN 'javascript_required'
  WHEN likely_spa_shell AND visible_text_length < 180 THEN 'spa_shell' END AS soft_error FROM ({SQL['html_quality_signals'].replace('FROM pages)', "FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substring(html, 1, 150) || '<noscript>we use cookies, enable javascript</noscript>' WHEN page_id % 7 = 0 THEN 'captcha' ELSE html END AS html FROM pages))")})""")
def soft_errors(spark: SparkSession, d: str) -> DataFrame:
    """The outcome of each page; every third one is cut to a shell and every seventh is a bot check, as the table has none."""
    page, html = F.col("page_id"), F.col("html")
    shell = F.concat(F.substring(html, 1, 150), F.lit("<noscript>we use cookies, enable javascript</noscript>"))
    pages = table(spark, d, "pages").select("page_id", F.when(page % 3 == 0, shell).when(page % 7 == 0, "captcha").otherwise(html).alias("html"))
    signals = pages.select("page_id", *[c.alias(n) for n, c in web.html_quality(F.col("html")).items()])
    return signals.select("page_id", web.soft_error_code({c: F.col(c) for c in signals.columns}).alias("soft_error"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return spans.chunks(table(spark, d, "documents"))


@query()
def chunk_validation(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the reason they may not be stored for ('ok' if they may)."""
    reason = F.coalesce(spans.validity(F.col("text")), F.lit("ok"))
    return spans.chunks(table(spark, d, "documents")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
  o AS (SELECT doc_id, line_no, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start FROM l),
  w AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 1200)) AS w_start, length(text) AS total FROM documents)
  SELECT w.doc_id AS doc_id, w_start // 1200 AS window_no, line_no FROM w JOIN o ON o.doc_id = w.doc_id AND o.start + o.n >= w_start AND o.start <= least(w_start + 1200, total)""")
def interval_overlap_locators(spark: SparkSession, d: str) -> DataFrame:
    """Which lines touch each stretch of 1200 characters."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no")) - F.length("line") - 1
    lines = lines.select("doc_id", "line_no", before.alias("start"), F.length("line").alias("n")).select("doc_id", "line_no", "start", (F.col("start") + F.col("n")).alias("stop"))
    total = F.length("text")
    windows = docs.select("doc_id", total.alias("total"), F.explode(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(1200))).alias("start"))
    windows = windows.select("doc_id", F.floor(F.col("start") / 1200).alias("window_no"), "start", F.least(F.col("start") + 1200, "total").alias("stop"))
    return spans.overlaps(windows, lines, "doc_id").select("doc_id", F.col("l.window_no").alias("window_no"), F.col("r.line_no").cast("long").alias("line_no"))


@query(f"""WITH q AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS t FROM benchmark WHERE item_id % 100 = 0),
  m AS (SELECT item_id, doc_id, source, len(list_filter(t, lambda x: contains(lower(text), x))) / len(t) AS s FROM q, documents WHERE len(t) > 0)
  SELECT item_id, doc_id, source, round(s, 4) AS score FROM m WHERE s >= 0.5""")
def local_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least half of a query's tokens as substrings. Queries: every item whose id is divisible by 100, against all documents."""
    q = table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query"), T.token_set(F.col("text")).alias("tokens"))
    docs = V.spread(table(spark, d, "documents").select("doc_id", "source", F.lower("text").alias("low")))
    hits = token_shares(q, docs, ["doc_id", "source"], "low", 0.5)
    return hits.select(F.col("query").alias("item_id"), "doc_id", "source", F.round("share", 4).alias("score"))


@query(f"""WITH r AS ({{local}}), p AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) - 1 AS prior_same_domain FROM r)
  SELECT item_id, doc_id, source, score, prior_same_domain, row_number() OVER (PARTITION BY item_id ORDER BY round(0.48 * score - least(0.18, 0.06 * prior_same_domain), 6) DESC, score DESC, doc_id) AS position FROM p""")
def rerank_diversity(spark: SparkSession, d: str) -> DataFrame:
    hits = S.domain_penalty(local_retrieve(spark, d), ["item_id"], "source", [F.desc("score"), F.col("doc_id")])
    order = Window.partitionBy("item_id").orderBy(F.round(0.48 * F.col("score") - F.col("penalty"), 6).desc(), F.desc("score"), "doc_id")
    return hits.withColumn("position", F.row_number().over(order).cast("long")).drop("penalty")


SQL["rerank_diversity"] = SQL["rerank_diversity"].replace("{local}", SQL["local_retrieve"])


def _evidence(alias: str, text: str) -> str:
    toks = f"list_distinct({TOKENS.format(text)})"
    plain = f"regexp_replace({text}, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC]', 'x', 'g')"  # its word boundaries know ASCII letters only
    nums = f"list_sort(list_distinct(list_concat(regexp_extract_all({plain}, '{T.NUMBER}'), regexp_extract_all({plain}, '{T.DATE}'))))"
    return (
        f"lower({SQUEEZE.format(text)}) AS {alias}_norm, {toks} AS {alias}_tokens, list_filter({toks}, lambda x: length(x) > 2 AND x NOT IN ({GENERIC})) AS {alias}_meaningful, "
        f"regexp_matches({plain}, '{Q_NEGATION}') OR regexp_matches({text}, '{T.CJK_NEGATION}') AS {alias}_negated, {nums} AS {alias}_numbers, list_sort(list_filter({toks}, lambda x: x IN ({SCOPE}))) AS {alias}_scope"
    )




def _excerpts(table_name: str, id_col: str) -> str:
    """Sentences and pairs of neighbours up to 520 characters."""
    found = "list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\n.!?。！？]+(?:[.!?。！？]+)?'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: s <> '')"
    rows = f"(SELECT {id_col}, f, unnest(range(len(f))) AS k FROM (SELECT {id_col}, {found} AS f FROM {table_name}))"
    both = f"SELECT {id_col}, k AS span_no, false AS pair, f[k + 1] AS x FROM {rows} UNION ALL SELECT {id_col}, k, true, f[k + 1] || ' ' || f[k + 2] FROM {rows} WHERE k + 2 <= len(f) AND length(f[k + 1] || ' ' || f[k + 2]) <= 520"
    return f"(SELECT {id_col}, span_no, pair, {SQUEEZE.format('x')} AS excerpt FROM ({both}))"


# All pairs that share enough tokens, and all pairs of distinct texts of which one contains the other: no candidate keys.
EVIDENCE = f"""WITH said AS (SELECT item_id, span_no, excerpt AS statement, {_evidence('s', 'excerpt')} FROM {_excerpts('benchmark', 'item_id')} WHERE NOT pair),
  found AS (SELECT doc_id, span_no AS excerpt_no, pair, excerpt, {_evidence('e', 'excerpt')} FROM {_excerpts('documents', 'doc_id')}),
  shared AS (SELECT item_id, span_no, doc_id, excerpt_no, pair FROM (SELECT item_id, span_no, len(s_meaningful) AS m, unnest(s_meaningful) AS token FROM said) JOIN (SELECT doc_id, excerpt_no, pair, unnest(e_meaningful) AS token FROM found) USING (token) GROUP BY item_id, span_no, doc_id, excerpt_no, pair HAVING count(*) >= 0.4 * any_value(m)),
  inside AS (SELECT a.s_norm, b.e_norm FROM (SELECT DISTINCT s_norm FROM said) a JOIN (SELECT DISTINCT e_norm FROM found) b ON contains(a.s_norm, b.e_norm) OR contains(b.e_norm, a.s_norm)),
  pairs AS (SELECT * FROM shared UNION SELECT item_id, span_no, doc_id, excerpt_no, pair FROM inside JOIN said USING (s_norm) JOIN found USING (e_norm)),
  both_ AS (SELECT * FROM pairs JOIN found USING (doc_id, excerpt_no, pair) JOIN said USING (item_id, span_no)),
  r AS (SELECT *, CASE WHEN len(s_tokens) > 0 THEN len(list_intersect(s_tokens, e_tokens)) / len(s_tokens) ELSE 0.0 END AS o, CASE WHEN len(s_meaningful) > 0 THEN len(list_intersect(s_meaningful, e_meaningful)) / len(s_meaningful) ELSE 0.0 END AS w,
    s_negated <> e_negated AS neg, len(s_numbers) > 0 AND len(e_numbers) > 0 AND s_numbers <> e_numbers AS num, len(s_scope) > 0 AND len(e_scope) > 0 AND s_scope <> e_scope AS sc, contains(e_norm, s_norm) OR contains(s_norm, e_norm) AS ex FROM both_),
  k AS (SELECT *, CASE WHEN ex AND NOT neg AND NOT num THEN 1 WHEN o >= 0.55 AND w >= 0.45 AND neg THEN 2 WHEN num OR sc OR (o >= 0.45 AND w < 0.35) THEN 0 WHEN o >= 0.72 AND w >= 0.6 AND NOT neg THEN 3 WHEN o >= 0.5 AND w >= 0.4 AND NOT neg THEN 4 ELSE 0 END AS kind FROM r),
  v AS (SELECT item_id, span_no, doc_id, excerpt_no, pair, excerpt, CASE kind WHEN 2 THEN 'contradict' WHEN 4 THEN 'weak_support' ELSE 'support' END AS relation, CASE kind WHEN 2 THEN 'contradiction' WHEN 4 THEN 'weak_support' ELSE 'strong_support' END AS detail,
    CASE kind WHEN 1 THEN 0.95 WHEN 2 THEN round(least(0.95, 0.55 + o * 0.35), 2) WHEN 3 THEN round(least(0.9, 0.5 + o * 0.3), 2) ELSE round(least(0.68, 0.35 + w * 0.35), 2) END::DOUBLE AS score,
    CASE WHEN kind = 1 THEN 1.0 ELSE o END::DOUBLE AS overlap, CASE WHEN kind = 1 THEN CASE WHEN len(s_meaningful) > 0 THEN 1.0 ELSE 0.0 END ELSE w END::DOUBLE AS meaningful_overlap FROM k WHERE kind > 0),
  evidence AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY item_id, span_no, doc_id ORDER BY score DESC, meaningful_overlap DESC, overlap DESC, pair, excerpt_no) AS rn FROM v) WHERE rn = 1)"""


@query(f"{EVIDENCE} SELECT * FROM evidence")
def verify_statements(spark: SparkSession, d: str) -> DataFrame:
    """For each statement of the benchmark and each document that bears on it, the best excerpt and its relation."""
    return V.verify(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"))


STATUS = """SELECT item_id, span_no, count(*) FILTER (relation = 'support') AS support, count(*) FILTER (relation = 'weak_support') AS weak_support, count(*) FILTER (relation = 'contradict') AS contradict FROM evidence GROUP BY 1, 2"""
STATUS_CASE = "CASE WHEN support > 0 AND contradict = 0 THEN 'supported' WHEN contradict > 0 AND (support > 0 OR weak_support > 0) THEN 'mixed' WHEN contradict > 0 THEN 'contradicted' ELSE 'unsupported' END"


@query(f"{EVIDENCE} SELECT *, {STATUS_CASE} AS status FROM ({STATUS})")
def verification_status(spark: SparkSession, d: str) -> DataFrame:
    return V.statuses(verify_statements(spark, d))


@query(f"""{EVIDENCE}, st AS (SELECT *, {STATUS_CASE} AS status FROM ({STATUS}))
  SELECT item_id, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'mixed') AS mixed, count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (status = 'unsupported') AS unsupported
  FROM benchmark LEFT JOIN st USING (item_id) GROUP BY item_id""")
def claim_summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled numbers of statements by status for every item."""
    names = ["supported", "mixed", "contradicted", "unsupported"]
    counted = verification_status(spark, d).groupBy("item_id").pivot("status", names).agg(F.count("span_no"))
    return table(spark, d, "benchmark").select("item_id").join(counted, "item_id", "left").na.fill(0, names)


def evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    """(source, relation, accepted, n): the evidence of each source. It is counted by document in the tasks that find it, so what is joined with the documents is some rows of each."""
    found = verify_statements(spark, d).groupBy("doc_id", "relation", (F.col("score") >= 0.9).alias("accepted")).agg(F.count("*").alias("n"))
    return found.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "relation", "accepted").agg(F.sum("n").alias("n"))


@query(f"""{EVIDENCE} SELECT source, count(*) AS total, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'unselected') AS unselected
  FROM (SELECT coalesce(nullif(source, ''), 'unknown') AS source, CASE WHEN score >= 0.9 THEN 'accepted' WHEN relation = 'contradict' THEN 'rejected' ELSE 'unselected' END AS state FROM evidence JOIN documents USING (doc_id)) GROUP BY 1""")
def evidence_yield(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("relation") == "contradict", F.lit("contradicts"))))
    found = evidence_counts(spark, d).select("source", "n", C.candidate_state(F.col("accepted"), reasons).alias("state"))
    return C.evidence_yield(found, F.col("source"), "source", "unknown", F.col("n"))


SLOTS = [("src0", True), ("src1", True), ("src2", False), ("none", True)]


@query(f"""{EVIDENCE}, c AS (SELECT source AS slot_id, source, relation, score FROM evidence JOIN documents USING (doc_id)),
  s AS (SELECT * FROM (VALUES ('src0', true), ('src1', true), ('src2', false), ('none', true)) v(slot_id, required)),
  x AS (SELECT s.slot_id AS slot_id, required, count(relation) AS candidates, count(*) FILTER (score >= 0.9) AS accepted_evidence, count(*) FILTER (relation = 'support') AS supported_claims, count(*) FILTER (relation = 'weak_support') AS weak_claims, count(DISTINCT source) AS sources FROM s LEFT JOIN c ON s.slot_id = c.slot_id GROUP BY 1, 2)
  SELECT *, CASE WHEN supported_claims > 0 THEN 'covered' WHEN weak_claims > 0 OR accepted_evidence > 0 THEN 'weak' WHEN required THEN 'missing' ELSE 'weak' END AS status FROM x""")
def slot_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = V.written(evidence_counts(spark, d), "evidence-counts").withColumn("slot_id", F.col("source"))  # a few rows a source, read twice
    slots = spark.createDataFrame(SLOTS, "slot_id string, required boolean")
    candidates = found.select("slot_id", "source", "n", F.when(F.col("accepted"), "accepted").otherwise("unselected").alias("state"))
    claims = found.select("slot_id", "source", "n", F.when(F.col("relation") == "support", "supported").when(F.col("relation") == "weak_support", "weak").otherwise("other").alias("status"))
    return C.slot_coverage(slots, candidates, claims, F.col("n"))


@query()
def coverage_evaluation(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "documents").select(F.col("source").alias("domain"), F.col("lang").alias("role"), (F.col("lang") == "en").alias("authoritative"), F.lit(True).alias("used"))
    return C.evaluate(slot_coverage(spark, d), sources)


@query("""WITH h AS (SELECT source, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents)
  SELECT source, count(*) AS n, count(DISTINCT h) AS distinct_texts, round(1 - count(DISTINCT h) / count(*), 6) AS duplicate_rate FROM h GROUP BY source""")
def duplicate_rates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts by source through a grouped hash, not a distinct aggregate per source, so a large source is spread out."""
    hashes = table(spark, d, "documents").groupBy("source", T.excerpt_hash(F.col("text")).alias("h")).agg(F.count("*").alias("k"))
    by_source = hashes.groupBy("source").agg(F.sum("k").alias("n"), F.count("*").alias("distinct_texts"))
    return by_source.withColumn("duplicate_rate", F.round(C.duplicate_rate(F.col("distinct_texts"), F.col("n")), 6))


@query("SELECT l_partkey, count(*) - 1 AS reused, count(DISTINCT l_suppkey) AS users FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY reused DESC, users DESC, l_partkey LIMIT 5")
def reuse_topk(spark: SparkSession, d: str) -> DataFrame:
    return C.reuse(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


#: What a sentence may say, in the order of the slots.
SENTENCE_SLOTS = ("number", "negation", "question", "detail")


def claim_candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sentences of conversations as candidates, best first (denser ones, then earlier ones), and each conversation's terms."""
    said, text = table(spark, d, "conversations"), F.col("excerpt")
    rows = said.select("conv_id", "turn", "role", F.posexplode(T.sentences(F.col("text"))).alias("n", "excerpt"))
    # Each of these is used several times, so it is a column of its own.
    rows = rows.withColumns({"identity": T.claim_identity(text), "_tokens": T.tokens(text)}).withColumns({"_n": F.size("_tokens"), "_distinct": F.size(F.array_distinct("_tokens"))})
    rows = rows.withColumn("density", F.round(T.density_of(text, F.col("_n"), F.col("_distinct")), 4))
    density, identity = F.col("density"), F.col("identity")
    says = (F.size(T.numbers(text)) > 0, T.has_negation(text), F.contains(text, F.lit("?")), F.col("_n") >= 12)
    slots = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in zip(SENTENCE_SLOTS, says, strict=True)]))
    # Unique in a conversation of up to 2 ** 19 turns of as many sentences, and ordered by score, turn and place.
    position = (F.lit(10_000) - F.round(density * 10_000)).cast("long") * (1 << 38) + F.col("turn").cast("long") * (1 << 19) + F.col("n")
    none = F.array().cast("array<int>")
    found = rows.select(
        F.col("conv_id").alias("task_id"), position.alias("position"), F.concat(F.coalesce("role", F.lit("")), F.lit(":"), identity).alias("semantic_key"), identity.alias("identity"),
        F.floor(F.col("n") / 4).alias("paragraph"), F.col("turn").alias("document"), F.col("role").alias("category"), "role", slots.alias("slots"), none.alias("markers"), none.alias("exact_markers"), F.lit(False).alias("code"),
        (density >= 0.5).alias("relevant"), (density >= 0.5).alias("role_allowed"), F.lit(False).alias("normalized"), F.lit(0.5).alias("source_quality"), density.alias("answer_score"), density.alias("final_score"), "excerpt",
    )
    strings = lambda *x: F.array(*map(F.lit, x))
    # Conversations with a sentence; whether there is one is told without cutting the text.
    tasks = said.where(F.col("text").rlike(T.HAS_SENTENCE)).select(F.col("conv_id").alias("task_id")).distinct().select(
        "task_id", F.when(F.col("task_id") % 2 == 0, "technical").otherwise("deployment").alias("kind"), strings(*SENTENCE_SLOTS).alias("slots"), F.lit(0).alias("n_markers"), strings("assistant").alias("roles"), strings("assistant", "user").alias("categories"), F.lit(True).alias("balanced"),
    )
    return found, tasks


@query()
def diversified_claims(spark: SparkSession, d: str) -> DataFrame:
    """The best and most varied sentences of each conversation: open slots, the assistant's, one of each turn, both sides, then the densest."""
    found, tasks = claim_candidates(spark, d)
    chosen, near = D.choose(found, tasks, 8)
    return chosen.join(near, "task_id").select("task_id", "position", F.col("choice").cast("long").alias("choice"), "near_duplicates")


def evidence_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What documents say about the benchmark's statements, ranked for the choice of evidence; fifty items are a task."""
    found = V.verify(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text", "source"), kept=("source",))
    # Each of these is used twice, so it is a column of its own; white space of excerpts is squeezed already.
    density = F.round(T.density_of(F.col("excerpt"), F.col("n_tokens"), F.col("n_distinct")), 4)
    found = found.withColumns({"density": density, "hash": F.sha2(F.lower("excerpt"), 256)})
    density = F.col("density")
    claim_no = F.col("item_id") * 100_000 + F.col("span_no")
    span = F.concat_ws(":", "doc_id", "excerpt_no", "pair")
    return found.select(
        F.floor(F.col("item_id") / 50).cast("long").alias("task_id"), claim_no.alias("claim_no"), span.alias("candidate_id"), "relation", evidence_rank(F.col("score"), density=density).alias("rank_score"),
        F.col("doc_id").cast("string").alias("chunk_id"), span.alias("span_key"), F.col("hash").alias("content_key"), F.col("source").alias("domain"), F.col("hash").alias("content_hash"),
        F.lit(0.5).alias("source_quality"), density.alias("content_quality"), F.col("excerpt_no").cast("int").alias("chunk_no"), F.lit(0).alias("start_offset"), F.col("doc_id").alias("source_id"),
    )


@query()
def evidence_selection(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each statement: at most a support, a contradiction and a weak support, where excerpts that earlier statements use count less."""
    chosen = R.select_evidence(V.written(evidence_candidates(spark, d), "candidates"))
    return chosen.select("task_id", "claim_no", "relation", "candidate_id", "rank_score", "adjusted_score", "reuse_penalty", "chunk_before", "span_before", "content_before", "selection_rank")


@query()
def evidence_diversity(spark: SparkSession, d: str) -> DataFrame:
    """For each statement that documents bear on, how varied its evidence is."""
    found = V.written(evidence_candidates(spark, d), "candidates")
    return R.diversity(R.select_evidence(found), found.select("task_id", "claim_no"))


@query()
def verification_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with offsets, and pairs of neighbours."""
    return spans.with_neighbours(spans.sentence_spans(table(spark, d, "documents"), "doc_id"), "doc_id")
