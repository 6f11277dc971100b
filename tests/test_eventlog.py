"""Event-log metrics against plain counting."""

import json
import random

import pytest

from sparkloom.operators import eventlog

LOG = "task_id int, sequence_no long, event_type string, payload_json string"


@pytest.mark.parametrize("n,newest", [(1, True), (7, True), (1500, True), (7, False), (10_000, True)])
def test_thresholds_are_the_nth_number(spark, n, newest):
    rng = random.Random(n)
    numbers = {1: rng.sample(range(100_000), 4000), 2: list(range(3)), 3: [5 * 1024 + i for i in range(2000)], 4: [0]}
    log = spark.createDataFrame([(t, s, "x", None) for t, own in numbers.items() for s in own], LOG).repartition(3)
    got = {r["task_id"]: r["least"] for r in eventlog.thresholds(log, ["task_id"], n, newest).collect()}
    assert got == {t: sorted(own, reverse=newest)[n - 1] for t, own in numbers.items() if len(own) >= n}


def test_metrics_equal_plain_counting(spark):
    rng, rows = random.Random(1), []
    for task in range(5):
        for s in range(400 if task == 1 else rng.randrange(1, 60)):
            kind = rng.choice((eventlog.BATCH_SUMMARY, eventlog.BROWSER_FALLBACK, "parsing.stage_completed", "other"))
            payload = {
                "stop_reason": rng.choice(("a", "b", "", None)), "unattempted_candidate_ids": rng.sample("uvwxyz", 2), "success_target_continue_count": rng.choice((-3, 0, 2)),
                "browser_fallback_considered": rng.choice((True, False)), "browser_fallback_attempted": rng.choice((True, None)), "browser_fallback_result": rng.choice(("succeeded", "failed", "x")),
                "result": {"parse_decisions": [{"decision": rng.choice(("parsed", "skip", None)), "status": rng.choice(("OK", "FAILED", None)), "reason": rng.choice(("r1", "r2", ""))} for _ in range(rng.randrange(3))]},
                "details": rng.choice(("text", {"parse_decisions": [{"decision": "late", "reason": "r3"}]}, None)),
            }
            rows.append((task, s * 700, kind, rng.choice((json.dumps(payload), json.dumps(payload), "[1]", "no json", None))))
    got = {r["task_id"]: r.asDict() for r in eventlog.metrics(spark.createDataFrame(rows, LOG).repartition(4), 20, 6, 9).collect()}

    def read(s):
        try:
            found = json.loads(s or "")
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    for task in range(5):
        own = sorted((s, k, read(p)) for t, s, k, p in rows if t == task)
        batches, falls = [p for _, k, p in own if k == eventlog.BATCH_SUMMARY], [p for _, k, p in own if k == eventlog.BROWSER_FALLBACK][-9:]
        said = [d for _, _, p in own[-20:] for c in ("result", "details") if isinstance(p.get(c), dict) for d in p[c]["parse_decisions"]]
        count = lambda values: {v: values.count(v) for v in sorted(set(filter(None, values)))}
        stops = {}
        for p in batches[:6]:
            if p.get("stop_reason") is not None:
                stops |= dict.fromkeys(p["unattempted_candidate_ids"], p["stop_reason"])
        considered, attempted = [bool(p.get("browser_fallback_considered")) for p in falls], [bool(p.get("browser_fallback_attempted")) for p in falls]
        want = {
            "task_id": task, "events": len(own), "batch_summaries": len(batches[-6:]), "success_target_continued": sum(max(0, p.get("success_target_continue_count", 0)) for p in batches[-6:]), "fallback_events": len(falls),
            "fallback_considered": sum(considered), "fallback_attempted": sum(attempted), "fallback_succeeded": sum(p.get("browser_fallback_result") == "succeeded" for p in falls),
            "fallback_failed": sum(p.get("browser_fallback_result") == "failed" for p in falls), "fallback_skipped": sum(c and not a for c, a in zip(considered, attempted, strict=True)),
            "stop_reasons": count([p.get("stop_reason") for p in batches[-6:]]), "parser_decisions": count([d["decision"] for d in said]), "unattempted_candidates": count(list(stops.values())),
            "parser_rejections": count([d["reason"] for d in said if d.get("status") in ("SKIPPED", "FAILED") or d["decision"] not in ("parsed", None)]),
        }
        assert got[task] == want and list(got[task]["parser_decisions"]) == sorted(got[task]["parser_decisions"])
    assert eventlog.metrics(spark.createDataFrame([], LOG)).count() == 0
