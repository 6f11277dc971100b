"""Choice of evidence with reuse costs against the sequential rule."""

import random

import pytest

from sparkloom.operators import reuse

COLUMNS = "task_id int, claim_no long, candidate_id string, relation string, rank_score double, chunk_id string, span_key string, content_key string, domain string, content_hash string, source_quality double, content_quality double, chunk_no int, start_offset int, source_id int, note string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def sequential(rows):
    """Task by task, claim by claim, with running counters."""
    out, tasks = {}, sorted({r["task_id"] for r in rows})
    for task in tasks:
        counts = {"chunk_id": {}, "span_key": {}, "content_key": {}}
        claims = sorted({r["claim_no"] for r in rows if r["task_id"] == task})
        for claim in claims:
            own = [r for r in rows if r["task_id"] == task and r["claim_no"] == claim]

            def before(r, kind, counts=counts):
                return counts[kind].get(r[kind], 0) if r[kind] is not None else 0

            def ranked(relation, own=own, before=before):
                found = []
                for r in own:
                    if r["relation"] != relation or r["rank_score"] is None:
                        continue
                    cost = min(0.14, min(0.08, before(r, "chunk_id") * 0.04) + min(0.10, before(r, "span_key") * 0.05) + min(0.06, before(r, "content_key") * 0.03))
                    low = lambda x: -1.0 if x is None else x
                    first = lambda x: (x is not None, x)
                    adjusted = round(max(0.0, r["rank_score"] - cost), 4)
                    found.append(((-adjusted, -r["rank_score"], -low(r["source_quality"]), -low(r["content_quality"]), first(r["domain"]), first(r["chunk_no"]), first(r["start_offset"]), r["candidate_id"]), adjusted, round(cost, 4), r))
                return sorted(found, key=lambda x: x[0])

            support, contradict, weak = ranked("support")[:1], ranked("contradict")[:1], []
            if not support or contradict:
                used = {(x[3]["domain"], x[3]["content_hash"]) for x in support + contradict}
                all_ = ranked("weak_support")
                weak = ([x for x in all_ if (x[3]["domain"], x[3]["content_hash"]) not in used] or all_)[:1]
            for i, (_, adjusted, cost, r) in enumerate(support + contradict + weak):
                out[task, claim, r["relation"], r["candidate_id"]] = (i + 1, adjusted, cost, *(before(r, k) for k in counts))
            for _, _, _, r in support + contradict + weak:
                for kind, n in counts.items():
                    if r[kind] is not None:
                        n[r[kind]] = n.get(r[kind], 0) + 1
    return out


def selected(df):
    return {(r["task_id"], r["claim_no"], r["relation"], r["candidate_id"]): (r["selection_rank"], r["adjusted_score"], r["reuse_penalty"], r["chunk_before"], r["span_before"], r["content_before"]) for r in reuse.select_evidence(df).collect()}


def candidates(seed, tasks, claims, most, chunks, spread):
    rng, rows = random.Random(seed), []
    for task in range(tasks):
        for claim in range(claims if task else claims * 2):
            for k in range(rng.randrange(0, most)):
                chunk = f"c{rng.randrange(chunks)}"
                span = f"{chunk}:{rng.randrange(3)}"
                null = rng.random() < 0.05
                rows.append(dict(zip(NAMES, (
                    task, claim * 10, f"{k:03d}", rng.choice(("support", "contradict", "weak_support", "weak_support", "insufficient")), round(0.5 + rng.randrange(0, spread) / 100, 4),
                    None if null else chunk, None if null else span, f"h{rng.randrange(chunks // 2 + 1)}", rng.choice(("a.org", "b.org", None)), rng.choice(("x", "y", None)), rng.choice((0.5, 0.7, None)), 0.5, rng.randrange(3), rng.randrange(4), task, "n",
                ), strict=True)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], COLUMNS)


@pytest.mark.parametrize("seed,tasks,claims,most,chunks,spread", [(1, 4, 8, 9, 4, 12), (2, 2, 14, 12, 3, 30), (3, 6, 5, 5, 2, 3)])
def test_choice_equals_the_sequential_rule(spark, seed, tasks, claims, most, chunks, spread):
    rows = candidates(seed, tasks, claims, most, chunks, spread)
    got, want = selected(frame(spark, rows)), sequential(rows)
    assert got == want and any(v[2] > 0 for v in want.values())


def test_one_hot_task_and_a_chain(spark):
    # All claims of one task want the same few spans, so each choice moves the next claims on.
    rows = [dict(zip(NAMES, (1, n, f"{k}", "support", 0.9 - k / 100, f"c{k}", f"s{k}", f"h{k}", "a.org", "x", 0.5, 0.5, k, 0, 1, ""), strict=True)) for n in range(60) for k in range(5)]
    got = selected(frame(spark, rows))
    assert got == sequential(rows) and max(v[3] for v in got.values()) > 5


def test_few_candidates_are_left_of_many(spark):
    rows = [dict(zip(NAMES, (1, 1, f"{k:04d}", "weak_support", round(0.2 + k / 1000, 4), f"c{k}", f"s{k}", f"h{k}", f"d{k % 5}", "x", 0.5, 0.5, k, 0, 1, ""), strict=True)) for k in range(700)]
    assert 140 <= reuse.contenders(frame(spark, rows)).count() <= 150
    assert selected(frame(spark, rows)) == sequential(rows)


def test_diversity_and_defined_cases(spark):
    rows = candidates(9, 2, 6, 6, 3, 10)
    df = frame(spark, rows)
    out = reuse.select_evidence(df)
    assert set(NAMES) < set(out.columns)
    claims = spark.createDataFrame([(t, n * 10) for t in range(2) for n in range(12)], "task_id int, claim_no long")
    found = {(r["task_id"], r["claim_no"]): r.asDict() for r in reuse.diversity(out, claims).collect()}
    assert len(found) == 24
    chosen = {}
    for (task, claim, relation, _), v in sequential(rows).items():
        chosen.setdefault((task, claim), []).append((relation, v))
    for key, r in found.items():
        own = chosen.get(key, [])
        assert r["evidence_count"] == len(own) and r["relation_types"] == sorted(x for x, _ in own)
        assert r["max_reuse_penalty"] == max((v[2] for _, v in own), default=0.0)
        assert abs(r["mean_reuse_penalty"] - sum(v[2] for _, v in own) / max(1, len(own))) <= 0.00005
        assert r["unique_chunk_count"] + r["duplicate_chunk_count"] <= len(own)
    assert reuse.select_evidence(df.limit(0)).count() == 0
    doubled = frame(spark, rows + rows)
    assert selected(doubled) == sequential(rows)
