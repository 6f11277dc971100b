"""Queries of pages' main content and of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import content as C
from sparkloom.operators.verification import spread
from sparkloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def main_content(spark: SparkSession, d: str) -> DataFrame:
    """Each page's title, main text and how it was found."""
    return C.main_content(spread(table(spark, d, "pages"))).select("page_id", "title", "text", "strategy", "fallback_used", "removed_boilerplate", "link_texts", "dropped_fragments", "reason", "followup_url")


# Stubs are rare, so each page's first words stand after what servers say when they redirect.
STUB = "'Redirecting to ' || CASE WHEN page_id % 2 = 0 THEN url ELSE 'the page' END || '. ' || substr({0}, 1, 300 + (page_id % 5) * 60)"


@query(f"""WITH s AS (SELECT page_id, html, trim(regexp_replace({STUB.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS t FROM pages),
  r AS (SELECT page_id, t, length(t) <= 500 AS stub, regexp_replace(regexp_extract(t, '(?i)(https?://[^\\s<>''")]+)', 1), '[.,;]+$', '') AS named, regexp_replace(replace(regexp_extract(html, '(?i)(https?://[^\\s<>''")]+)', 1), '&amp;', '&'), '[.,;]+$', '') AS linked,
    regexp_replace(replace(regexp_extract(html, '(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>', 1), '&amp;', '&'), '[.,;]+$', '') AS first_link FROM s)
  SELECT page_id, CASE WHEN stub THEN 'redirect_stub' END AS reason, CASE WHEN stub THEN coalesce(nullif(replace(named, '&amp;', '&'), ''), nullif(linked, ''), CASE WHEN regexp_matches(first_link, '^https?://') THEN first_link END) END AS followup_url FROM r""")
def redirect_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Which texts only send their reader on, and where to."""
    bare = F.regexp_replace("html", "<[^>]*>", " ")
    said = F.concat(F.lit("Redirecting to "), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("the page"), F.lit(". "), F.substring(bare, F.lit(1), (300 + (F.col("page_id") % 5) * 60).cast("int")))
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in C.redirect_stub(said, F.col("html")).items()])


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n{2,}'), lambda s: regexp_replace(regexp_replace(trim(regexp_replace(s, '[\\t\\v\\f\\r \\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+', ' ', 'g')), ' ?\\n ?', chr(10), 'g'), '^\\n+|\\n+$', '', 'g')), lambda s: s <> '') AS ps FROM documents),
  u AS (SELECT doc_id, unnest(ps) AS segment, unnest(range(len(ps))) AS segment_no FROM p)
  SELECT doc_id, segment_no, coalesce(sum(length(segment) + 2) OVER w, 0)::BIGINT AS start, (coalesce(sum(length(segment) + 2) OVER w, 0) + length(segment))::BIGINT AS stop, segment FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY segment_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def text_segments(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents with running offsets."""
    return C.segments(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
