"""Lineage on a small ledger whose every way is known."""

from sparkloom.operators import lineage as L


def test_each_way_and_each_orphan(spark):
    make = spark.createDataFrame
    candidates = make([(i, 1, f"u{i}") for i in range(1, 9)] + [(9, 1, "u8"), (10, 2, "u8"), (11, 1, None)], "id int, task_id int, canonical_url string")
    jobs = make([(20, 2, "FAILED"), (21, 2, "SUCCEEDED"), (30, 3, "FAILED"), (40, 4, "FAILED"), (50, 5, "SUCCEEDED"), (60, 6, "SUCCEEDED"), (70, 7, "SUCCEEDED"), (80, 8, "SUCCEEDED")], "id int, candidate_url_id int, status string")
    attempts = make([(1, 30, 1, False), (2, 30, 2, True), (3, 40, 2, False), (4, 40, 1, True), (5, 50, 1, False), (6, 60, 1, None), (7, 70, 1, False)], "id int, fetch_job_id int, attempt_no int, blocked boolean")
    snapshots = make([(5, "application/pdf"), (6, "text/html"), (7, "text/html")], "fetch_attempt_id int, mime_type string")
    documents = make([(102, 1, "u2"), (107, 1, "u7"), (108, 1, "u8"), (200, 1, "nobody"), (201, 2, "u2"), (202, 1, None)], "id int, task_id int, canonical_url string")
    chunks = make([(102, True), (102, False), (107, False), (108, True), (200, True), (201, True)], "source_document_id int, eligible boolean")
    evidence = make([(102, True, False)] * 3 + [(108, False, True), (200, False, False)], "source_document_id int, accepted boolean, rejected boolean")
    claims = make([(102,)], "source_document_id int")
    out = L.lineage(candidates, L.latest_fetch(jobs, attempts, snapshots), documents, L.document_yield(chunks, evidence, claims)).collect()
    got = {(r["candidate_id"], r["document_id"]): (r["origin"], r["dropped_reason"], r["contribution"]) for r in out}
    assert len(out) == len(got) and got == {
        (1, None): ("candidate", "not_selected_low_priority", "none"), (2, 102): ("both", None, "high"), (3, None): ("candidate", "blocked_by_policy", "none"), (4, None): ("candidate", "fetch_failed", "none"),
        (5, None): ("candidate", "unsupported_content_type", "none"), (6, None): ("candidate", "parse_failed", "none"), (7, 107): ("both", "low_chunk_quality", "none"), (8, 108): ("both", "evidence_rejected", "low"),
        (9, 108): ("both", "not_selected_low_priority", "low"), (10, None): ("candidate", "not_selected_low_priority", "none"), (11, None): ("candidate", "not_selected_low_priority", "none"),
        (None, 200): ("document", "off_intent", "low"), (None, 201): ("document", "no_evidence_candidates", "none"), (None, 202): ("document", "parse_failed", "none"),
    }


def test_low_yield_ladder(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 0, 900, 1, 1), (1, 1, 1, 70, 1, 1), (1, 0, 1, 90, 1, 1), (1, 1, 0, 90, 1, 1), (1, 1, 1, 90, 0, 1), (1, 1, 1, 90, 1, 0), (1, 1, 1, 90, 1, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, chunks int, eligible_chunks int, candidates int, n int, relevant int, categories int")
    got = [r["why"] for r in df.select("i", L.low_yield(F.col("n"), F.col("relevant"), F.col("categories")).alias("why")).orderBy("i").collect()]
    assert got == ["no_chunks", "very_short_extracted_text", "no_eligible_chunks", "no_candidate_sentences", "no_answer_relevant_candidates", "no_answer_category_coverage", None]
