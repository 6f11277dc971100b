"""Queries that choose evidence and claims, on the supplied tables, against the plain rules; containment against Python's `in`."""

import random

from sparkloom.operators import containment, diversify, reuse
from sparkloom.plans import evidence
from tests.oracle import SF_DIR
from tests.test_diversify import plain
from tests.test_reuse import selected, sequential


def test_evidence_selection_is_the_sequential_choice(spark):
    found = evidence.V.written(evidence.evidence_candidates(spark, SF_DIR), "candidates")
    rows = [r.asDict() for r in found.collect()]
    want = sequential(rows)
    assert selected(found) == want and len(want) > 100 and any(v[2] > 0 for v in want.values())
    diversity = reuse.diversity(reuse.select_evidence(found), found.select("task_id", "claim_no")).collect()
    assert sum(r["evidence_count"] for r in diversity) == len(want) and len(diversity) == len({(r["task_id"], r["claim_no"]) for r in rows})


def test_diversified_claims_are_the_plain_ladders(spark):
    found, tasks = evidence.claim_candidates(spark, SF_DIR)
    rows, terms = [r.asDict() for r in found.collect()], [t.asDict() for t in tasks.collect()]
    by_task = {}
    for r in rows:
        by_task.setdefault(r["task_id"], []).append(r)
    chosen, near = diversify.choose(found, tasks, 8)
    got = {}
    for r in sorted(chosen.collect(), key=lambda r: r["choice"]):
        got.setdefault(r["task_id"], []).append(r["position"])
    want = {t["task_id"]: plain(by_task[t["task_id"]], t, 8) for t in terms}
    assert got == {t: p for t, (p, _) in want.items()} and len(got) > 10
    assert {r["task_id"]: r["near_duplicates"] for r in near.collect()} == {t: n for t, (_, n) in want.items()}


def strings(rng, n, most, letters="abé漢 "):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, most))) for _ in range(n)]


def test_containment_equals_python(spark):
    rng = random.Random(4)
    short, long = [*strings(rng, 60, 5), "", None], [*strings(rng, 90, 40), "", None, "a" * 50_000]
    frame = lambda x: spark.createDataFrame([(s,) for s in x], "s string").repartition(3)
    want = sorted({(p, t) for p in short for t in long if p and t is not None and p in t})
    for block in (containment.BLOCK_BYTES, 100):
        for patterns, texts, expected in ((short, long, want), (long, short, sorted({(p, t) for p in long for t in short if p and t is not None and p in t}))):
            got = containment.contained(frame(patterns), frame(texts), block_bytes=block).collect()
            assert sorted((r["pattern"], r["text"]) for r in got) == expected
    assert containment.contained(frame([]), frame(long)).count() == 0 == containment.contained(frame(short), frame([])).count()


def test_token_shares_equal_python(spark):
    rng = random.Random(5)
    queries = [(i, sorted(set(filter(None, strings(rng, 6, 4))))) for i in range(12)] + [(99, [])]
    texts = [(i, s) for i, s in enumerate([*strings(rng, 50, 30), "", None])]
    frame = spark.createDataFrame(queries, "query long, tokens array<string>")
    for block in (containment.BLOCK_BYTES, 30):
        got = containment.token_shares(frame, spark.createDataFrame(texts, "id long, text string").repartition(2), ["id"], "text", 0.5, block_bytes=block).collect()
        want = {(i, q): sum(t in s for t in ts) / len(ts) for i, s in texts if s is not None for q, ts in queries if ts}
        assert {(r["id"], r["query"]): r["share"] for r in got} == {k: v for k, v in want.items() if v >= 0.5} and len(got) > 20


def test_candidates_are_found_once_for_all_rounds(spark, monkeypatch):
    from tests.oracle import SF_DIR

    from sparkloom.plans import evidence

    seen = []
    columns = "task_id long, claim_no long, relation string, candidate_id string, rank_score double, adjusted_score double, reuse_penalty double, chunk_before long, span_before long, content_before long, selection_rank long"
    monkeypatch.setattr(evidence.R, "select_evidence", lambda df: seen.append(df) or spark.createDataFrame([], columns))
    evidence.evidence_selection(spark, SF_DIR)
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().optimizedPlan().toString() and seen[0].count() > 0


def test_evidence_is_found_once_and_counted_by_document(spark, monkeypatch):
    """Slots read the counts of evidence twice, but no document; counts stand for as many rows."""

    from sparkloom.plans import evidence, reports
    from tests.oracle import SF_DIR

    ids = [r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").orderBy("doc_id").limit(40).collect()]
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source").collect()}
    rows = [(i % 7, 0, doc, i, ("support", "weak_support", "contradict")[i % 3], 0.95 if i % 5 == 0 else 0.5) for doc in ids for i in range(doc % 6)]
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    schema = "item_id long, span_no long, doc_id long, excerpt_no long, relation string, score double"
    found = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    monkeypatch.setattr(evidence, "verify_statements", lambda spark, d: found)
    got = {r["slot_id"]: r.asDict() for r in evidence.QUERIES["slot_coverage"](spark, SF_DIR).collect()}
    assert met.value == len(rows)
    for slot, required in evidence.SLOTS:
        own = [r for r in rows if sources[r[2]] == slot]
        n = {k: sum(r[4] == k for r in own) for k in ("support", "weak_support")}
        accepted = sum(r[5] >= 0.9 for r in own)
        status = "covered" if n["support"] else "weak" if n["weak_support"] or accepted or not required else "missing"
        assert got[slot] == {"slot_id": slot, "required": required, "candidates": len(own), "accepted_evidence": accepted, "supported_claims": n["support"], "weak_claims": n["weak_support"], "sources": int(bool(own)), "status": status}
    by_source = {r["source"]: (r["total"], r["accepted"], r["rejected"], r["unselected"]) for r in evidence.QUERIES["evidence_yield"](spark, SF_DIR).collect()}
    for source in {sources[r[2]] for r in rows}:
        own = [r for r in rows if sources[r[2]] == source]
        accepted, rejected = sum(r[5] >= 0.9 for r in own), sum(r[5] < 0.9 and r[4] == "contradict" for r in own)
        assert by_source[source] == (len(own), accepted, rejected, len(own) - accepted - rejected)
    before = met.value
    assert reports.QUERIES["markdown_report"](spark, SF_DIR).count() > 0
    assert met.value - before == len(rows)


def test_conversations_with_a_sentence_are_told_without_cutting(spark):
    """They were cut into sentences again each time that the list of tasks was read."""
    from pyspark.sql import functions as F

    from sparkloom.functions import text as T

    texts = [None, "", " ", "\n", ".", "...", " .", ". ", " \n.", "\t", "a", ".a", " a ", "!?。", " 。", "\n \n", "x. y", "你好。", " ", ". . ", ".\n ", "  ?\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("n", F.size(T.tokens(F.col("text")))).withColumn("u", F.size(F.array_distinct(T.tokens(F.col("text")))))
    text = F.col("text")
    got = rows.select("text", (F.size(T.sentences(text)) > 0).alias("cut"), text.rlike(T.HAS_SENTENCE).alias("told"), T.information_density(text).alias("a"), T.density_of(text, F.col("n"), F.col("u")).alias("b")).collect()
    assert all(bool(r["told"]) == (r["text"] is not None and r["cut"]) and r["a"] == r["b"] for r in got) and sum(bool(r["told"]) for r in got) > 8
