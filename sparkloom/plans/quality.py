"""Queries over the quality of sources and chunks, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import quality as Q
from sparkloom.functions import text as T
from sparkloom.sources.tables import table

QUERIES, SQL = {}, {}

#: What the chunks are held against.
QUESTION = "How does the reading of the river work, and is the docker install in the document with heather?"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _hits(x: str, values: list[str]) -> str:
    return f"len(list_filter({_list(values)}, lambda phrase: contains({x}, phrase)))"


def _any(x: str, values: list[str]) -> str:
    return f"({_hits(x, values)} > 0)"


def _toks(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda t: lower(t))"


def _cjk(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]')"


def _bigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || {x}[i + 1]))"


LINKISH_SQL = " + ".join(f"(length(l) - length(replace(l, '{t}', ''))) / {len(t)}" for t in Q.LINKISH)
R2 = "floor(({}) * 100 + 0.5) / 100.0"
STOP = _list(Q.STOPWORDS)
EXPLAIN = f"list_has_any(lt, {_list(Q.EXPLANATORY)})"

# s: squeezed text, l: lower, t and lt: tokens of s and l, c: ideographs, q: the question's tokens without stop words.
SIGNALS = f"""WITH a AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS s FROM documents),
  b AS (SELECT *, lower(s) AS l, {_toks('s')} AS t, {_toks('lower(s)')} AS lt, {_cjk('s')} AS c, list_filter(list_distinct({_toks("'" + QUESTION + "'")}), lambda x: NOT list_contains({STOP}, x)) AS q,
    list_filter({_toks("'" + QUESTION + "'")}, lambda x: length(x) >= 4 AND NOT list_contains({STOP}, x)) AS ql, list_filter({_toks("coalesce(source, '')")}, lambda x: length(x) >= 4 AND NOT list_contains({STOP}, x)) AS tl, trim(coalesce(source, '')) AS title FROM a),
  d AS (SELECT *, greatest(1, len(lt)) AS n, {LINKISH_SQL} AS linkish, {EXPLAIN} AS explains, length(s) >= 80 AND {_any('s', ['.', '。', '!', '！'])} AS prose, len(t) >= 24 AND len(list_distinct(t)) / len(t) < 0.32 AS repeats,
    len(list_intersect(q, t)) / len(q) AS relevance, {_hits('l', Q.NAVIGATION)} AS nav_hits, {_hits('l', Q.REFERENCE)} AS ref_hits, {_hits('l', Q.POINTER)} AS pointer_hits, {_hits('l', Q.LEADING_UI)} AS ui_hits,
    length(s) >= 20 AND {_any('s', ['.', '。', '!', '！'])} AND ((len(t) >= 6 AND ({EXPLAIN} OR len(list_filter(t, lambda x: x LIKE '%ed' OR x LIKE '%es' OR x LIKE '%ing')) > 0)) OR (len(c) >= 10 AND {_any('s', Q.CJK_VERBS)})) AS substantive FROM b),
  e AS (SELECT *, CASE WHEN l = '' THEN 1.0 ELSE least(1.0, 0.18 * nav_hits + 0.16 * ref_hits + least(0.45, linkish / n)) END AS boiler,
    l IN ('references', 'bibliography', 'external links') OR l LIKE 'references %' OR l LIKE 'bibliography %' OR l LIKE 'external links %' OR ({_any('l', Q.STRONG_REFERENCE)} AND NOT explains) OR (ref_hits >= 2 AND ref_hits / n >= 0.08) AS reference,
    nav_hits >= 2 OR (n <= 80 AND linkish / n >= 0.12) AS nav, pointer_hits > 0 AND NOT explains AND (n <= 90 OR pointer_hits / n >= 0.04) AS pointer, {_any('l', Q.DIAGRAM)} AND NOT {_any('l', Q.DEPLOYMENT)} AS diagram, {_any('l', Q.DEPLOYMENT)} AS deployment,
    length(l) <= 500 AND {_any('l', Q.STUB)} AS stub,
    relevance >= 0.25 OR len(list_filter(ql, lambda x: contains(l, x))) > 0 OR (title <> '' AND ((length(title) >= 8 AND (contains(lower(title), l) OR contains(l, lower(title)))) OR len(list_filter(tl, lambda x: contains(l, x))) > 0)) AS about,
    CASE WHEN len(t) > 0 THEN greatest(0.0, least(1.0, len(list_distinct(t)) / len(t) * 0.42 + least(len(t) / 90.0, 1.0) * 0.38 + CASE WHEN prose THEN 0.2 ELSE 0.0 END - CASE WHEN repeats THEN 0.25 ELSE 0.0 END))
      WHEN len(c) > 0 THEN greatest(0.0, least(1.0, len(list_distinct(c)) / len(c) * 0.42 + least(len(c) / 120.0, 1.0) * 0.38 + CASE WHEN prose THEN 0.2 ELSE 0.0 END)) ELSE 0.0 END AS density FROM d),
  f AS (SELECT *, length(s) < 48 AS short, length(s) < 48 AND (about OR substantive) AS protected,
    s <> '' AND length(s) <= 260 AND NOT about AND ui_hits >= 2 AND (ui_hits >= 4 OR (ui_hits / greatest(1.0, len(t) + len(c) / 2.0) >= 0.16 AND NOT substantive)) AS leads FROM e),
  g AS (SELECT *, CASE WHEN leads THEN greatest(boiler, 0.72) ELSE boiler END AS boiler2 FROM f),
  h AS (SELECT *, 0.22 + 0.55 * 0.32 + relevance * 0.22 + density * 0.1 + CASE WHEN explains THEN 0.16 ELSE 0.0 END + CASE WHEN prose OR protected THEN 0.08 ELSE 0.0 END - boiler2 * 0.46 - CASE WHEN short AND NOT protected THEN 0.22 ELSE 0.0 END - CASE WHEN repeats THEN 0.12 ELSE 0.0 END AS s0 FROM g),
  i AS (SELECT *, least(s0, CASE WHEN stub THEN 0.12 ELSE 9.0 END, CASE WHEN reference OR nav OR pointer THEN 0.24 ELSE 9.0 END, CASE WHEN leads THEN 0.3 ELSE 9.0 END, CASE WHEN diagram THEN 0.18 ELSE 9.0 END) AS s1 FROM h),
  j AS (SELECT *, {R2.format("least(1.0, greatest(0.0, CASE WHEN deployment THEN greatest(s1, 0.58) ELSE s1 END))")} AS score, stub OR reference OR nav OR pointer OR leads OR diagram AS noise FROM i),
  k AS (SELECT *, score >= 0.35 AND NOT noise AND (NOT short OR deployment OR protected) AS eligible FROM j)"""


@query(f"""{SIGNALS} SELECT doc_id, score AS content_quality_score, {R2.format('relevance')} AS query_relevance_score, {R2.format('boiler2')} AS boilerplate_score, {R2.format('density')} AS information_density_score, eligible AS eligible_for_claims,
  leads AS is_boilerplate_like, nav OR pointer AS is_navigation_noise, reference AS is_reference_section, diagram AS is_diagram_or_config_section, CASE WHEN NOT eligible THEN 'low' WHEN score >= 0.72 THEN 'high' ELSE 'medium' END AS content_quality,
  concat_ws(',', CASE WHEN stub THEN 'redirect_stub' END, CASE WHEN reference THEN 'reference_section' END, CASE WHEN pointer THEN 'pointer_or_project_meta_noise' END, CASE WHEN nav AND NOT pointer THEN 'navigation_noise' END, CASE WHEN diagram THEN 'diagram_or_config_section' END,
    CASE WHEN deployment THEN 'deployment_code_or_config' END, CASE WHEN leads THEN 'leading_boilerplate_like' END, CASE WHEN protected THEN 'short_meaningful_content' END, CASE WHEN short AND NOT protected THEN 'very_short' END, CASE WHEN repeats THEN 'high_repetition' END,
    CASE WHEN eligible AND NOT (noise OR deployment OR short OR repeats) THEN 'informative_prose' END, CASE WHEN density < 0.35 THEN 'low_information_density' WHEN density >= 0.72 THEN 'dense_informative_text' END) AS reasons FROM k""")
def chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    """Every document as its source's first chunk, against QUESTION."""
    docs = table(spark, d, "documents")
    return Q.chunk_quality(docs, F.col("text"), F.lit(QUESTION), F.lit(0.55), F.lit(0), F.col("source")).drop("text", "lang", "source", "n_chars")


@query(f"""{SIGNALS} SELECT source, count(*) AS chunks, count(*) FILTER (eligible) AS eligible, count(*) FILTER (nav OR pointer) AS navigation, count(*) FILTER (reference) AS reference_sections, count(*) FILTER (score >= 0.72 AND eligible) AS high, min(score) AS least, max(score) AS most FROM k GROUP BY source""")
def source_chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the chunks of each source are worth."""
    n = lambda c: F.count_if(c)
    rows = chunk_quality(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(
        F.count("*").alias("chunks"), n("eligible_for_claims").alias("eligible"), n("is_navigation_noise").alias("navigation"), n("is_reference_section").alias("reference_sections"),
        n(F.col("content_quality") == "high").alias("high"), F.min("content_quality_score").alias("least"), F.max("content_quality_score").alias("most"),
    )


EVIDENCE_HITS = " + ".join(f"len(regexp_extract_all(l, '{p}'))" for p in Q.EVIDENCE_SIGNALS)
DENSITY = """CASE WHEN trim(coalesce({0}, '')) = '' THEN 0.45 ELSE least(1.0, greatest(0.05, 0.18 + least(1.0, (signals + least(quotes, 4)) / 12) * 0.62 + least(1.0, stops / 16) * 0.2)) END"""


def _dense(column: str, rows: str) -> str:
    return f"""SELECT *, {EVIDENCE_HITS} AS signals, floor(len(regexp_extract_all(l, '"')) / 2) + len(regexp_extract_all(l, '“')) AS quotes, greatest(1, len(regexp_extract_all(l, '[.!?。！？]'))) AS stops
      FROM (SELECT *, lower(trim(regexp_replace({column}, '\\s+', ' ', 'g'))) AS l FROM {rows})"""


@query(f"SELECT doc_id, {DENSITY.format('text')} AS evidence_density FROM ({_dense('text', 'documents')})")
def evidence_density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", Q.evidence_density(F.col("text")).alias("evidence_density"))


CATEGORY_LIST = _list(["", *Q.CATEGORIES])
_case = lambda place, other: "CASE " + " ".join(f"WHEN c = '{k}' THEN {v[place] if place < 2 else repr(v[place])}" for k, v in Q.CATEGORIES.items() if v[place] is not None) + f" ELSE {other} END"
_starts = lambda hosts: "(" + " OR ".join(f"d LIKE '{h}%'" for h in hosts) + ")"
_under = lambda domains: "(" + " OR ".join(f"d = '{x}' OR d LIKE '%.{x}'" for x in domains) + ")"
_LADDER = [("open_docs", 0.95, "official_docs"), ("vendor AND trusted", 0.92, "official_docs"), ("vendor", 0.75, "official_vendor_domain"), ("d LIKE '%wikipedia.org'", 0.78, "wikipedia_article"),
           ("d <> '' AND regexp_replace(p, '/+$', '') = ''", 0.72, "project_homepage"), ("d = 'github.com'", 0.45, "github_repository_landing_page"), ("social", 0.2, "social_video_or_forum")]
SOURCES = f"""WITH a AS (SELECT page_id, url, html, {CATEGORY_LIST}[(page_id % 10 + 1)::BIGINT] AS c, page_id % 17 = 0 AS stub, page_id % 5 = 0 AS fallback, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '') AS d, lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages),
  b AS (SELECT *, {_any('p', Q.DOCS_PATHS)} AS docs, {_under(Q.VENDOR_DOMAINS)} AS vendor, {_under(Q.SOCIAL_DOMAINS)} AS social, length(html) AS n FROM ({_dense('html', 'a')})),
  e AS (SELECT *, {_starts([*Q.DOCS_HOSTS, 'blog.', 'news.'])} OR docs AS open_docs, {_any('p', Q.BLOG_AND_NEWS_PATHS)} OR docs OR (d LIKE 'support.%' AND d LIKE '%.claude.com' AND (contains(p, '/articles') OR contains(p, '/hc/') OR p LIKE '/en/%')) OR (d LIKE 'code.%' AND d LIKE '%.claude.com' AND {_any('p', ['/docs', '/reference', '/api'])}) AS trusted FROM b),
  f AS (SELECT *, {_case(0, 'CASE ' + ' '.join(f'WHEN {w} THEN {x}' for w, x, _ in _LADDER) + ' ELSE 0.55 END')}::DOUBLE AS authority, {_case(2, 'CASE ' + ' '.join(f"WHEN {w} THEN '{x}'" for w, _, x in _LADDER) + " ELSE 'generic_web_page' END")} AS why,
    {_case(1, f"CASE WHEN {_starts(Q.DOCS_HOSTS)} OR docs THEN 0.88 WHEN d LIKE '%wikipedia.org' THEN 0.7 WHEN d = 'github.com' THEN 0.5 WHEN social THEN 0.35 ELSE 0.52 END")}::DOUBLE AS relevance,
    (CASE WHEN n >= 4000 THEN 0.88 WHEN n >= 1200 THEN 0.74 WHEN n >= 300 THEN 0.55 WHEN n > 0 THEN 0.28 ELSE 0.5 END)::DOUBLE AS information, (CASE WHEN n <= 0 THEN 0.2 WHEN fallback THEN 0.62 ELSE 0.86 END)::DOUBLE AS crawlability, ({DENSITY.format('html')})::DOUBLE AS evidence,
    (CASE WHEN c = 'low_quality_or_blocked' THEN 0.22 WHEN social THEN 0.42 ELSE 0.84 END)::DOUBLE AS safety FROM e),
  g AS (SELECT *, authority * 0.24::DOUBLE + relevance * 0.28::DOUBLE + information * 0.22::DOUBLE + crawlability * 0.12::DOUBLE + evidence * 0.08::DOUBLE + 0.5::DOUBLE * 0.04::DOUBLE + safety * 0.02::DOUBLE AS s0 FROM f),
  h AS (SELECT *, CASE WHEN why = 'official_docs' THEN greatest(s0, 0.9::DOUBLE) WHEN why IN ('project_homepage', 'official_github_repository') THEN greatest(s0, 0.66::DOUBLE) ELSE s0 END AS s1 FROM g)
  SELECT page_id, {', '.join(f"CASE WHEN stub THEN {v}::DOUBLE ELSE {R2.format(k)} END AS {k}_score" for k, v in {'authority': 0.1, 'relevance': 0.1, 'information': 0.1, 'crawlability': 0.1, 'evidence': 0.0, 'safety': 0.2}.items())},
    CASE WHEN stub THEN 0.1::DOUBLE ELSE {R2.format('least(0.98::DOUBLE, greatest(0.05::DOUBLE, s1))')} END AS score, CASE WHEN stub THEN 'redirect_stub' ELSE why END AS reason FROM h"""


@query(SOURCES)
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a source; categories, stubs and fallbacks are dealt out by page_id, as the tables have none."""
    page = F.col("page_id")
    category = F.get(F.array(*[F.lit(c) for c in ["", *Q.CATEGORIES]]), (page % 10).cast("int"))
    host = F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1)
    found = Q.source_quality(table(spark, d, "pages"), F.col("url"), host, category, F.col("html"), F.lit("main"), page % 5 == 0, page % 17 == 0, F.lit(None).cast("double"))
    return found.drop("url", "html")


LINES_SQL = """SELECT doc_id, regexp_replace(chr(13) || chr(10) || '  ' || replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(9) || ' ' || chr(10) || chr(10) || '  '), '\\r\\n?', chr(10), 'g') AS n FROM documents"""


@query(f"""SELECT doc_id, plain, structured, nullif(substring(regexp_extract(plain, '^[^\\n]*'), 1, 200), '') AS title FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '[ \\t\\f\\v]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS plain,
    regexp_replace(regexp_replace(n, '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), '^\\n+|\\n+$', '', 'g') AS structured FROM ({LINES_SQL}))""")
def text_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Plain and structured forms and titles of the documents, whose sentences are put on lines with odd ends first."""
    text = F.concat(F.lit("\r\n  "), F.replace("text", F.lit(". "), F.lit(".  \r\n\t \n\n  ")))
    rows = table(spark, d, "documents").select("doc_id", T.plain_text(text).alias("plain"), T.structured_text(text).alias("structured"))
    return rows.withColumn("title", T.first_line_title(F.col("plain")))
