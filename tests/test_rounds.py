"""Budgeted scans, drained batches and rounds against plain loops, and runs that are cut off at each stage."""

import random

import pytest

from sparkloom.operators import rounds
from sparkloom.plans.rounds import SHARES, research
from sparkloom.sources.tables import table
from tests.oracle import SF_DIR


def scan(rows, limit, target, least):
    """Row by row: those taken, and why the scan ends."""
    taken, created, successes, authoritative = [], 0, 0, 0
    for i, r in enumerate(rows):
        if created >= limit:
            break
        if target is not None and successes >= target and not (authoritative < least and any(x["authoritative"] for x in rows[i:])):
            break
        taken.append(r["n"])
        created += not r["existing"]
        successes += bool(r["success"])
        authoritative += bool(r["success"] and r["authoritative"])
    left = len(rows) - len(taken)
    reason = "no_unattempted_candidates" if not left else "fetch_budget_exhausted" if created >= limit else "success_target_met" if target is not None and successes >= target else "unknown_early_exit"
    return taken, created, successes, left, reason


@pytest.mark.parametrize("limit,target,least,parts", [(5, 3, 0, None), (4, 2, 1, 3), (100, None, 0, 7), (1000, 6, 2, 11)])
def test_budgeted_scan_equals_the_loop(spark, limit, target, least, parts):
    rng = random.Random(limit)
    rows = [{"task": None if t == 3 else t, "n": n, "existing": rng.random() < 0.3, "success": rng.choice((True, False, None)), "authoritative": rng.random() < 0.1} for t in range(6) for n in rng.sample(range(1000), 200 if t == 1 else rng.randrange(1, 15))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "task int, n int, existing boolean, success boolean, authoritative boolean").repartition(5)
    out = rounds.budgeted(df, ["task"], ["n"], limit, target, least)
    got, summary = {}, {r["task"]: r for r in rounds.budget_summary(out, ["task"], limit, target).collect()}
    for r in out.where("taken").collect():
        got.setdefault(r["task"], set()).add(r["n"])
    assert out.count() == len(rows)
    for task in {r["task"] for r in rows}:
        taken, created, successes, left, reason = scan(sorted((r for r in rows if r["task"] == task), key=lambda r: r["n"]), limit, target, least)
        s = summary[task]
        assert got.get(task, set()) == set(taken) and (s["created"], s["successes"], s["unattempted"], s["stop_reason"]) == (created, successes, left, reason)


def test_prefix_sums_of_a_hot_key(spark):
    rows = [("a", i, i % 7) for i in range(3000)] + [("b", i, None) for i in range(5)]
    out = rounds.prefix_sums(spark.createDataFrame(rows, "k string, i int, v int").repartition(4), ["k"], ["i"], {"v": __import__("pyspark").sql.functions.col("v")}, parts=9)
    got = {(r["k"], r["i"]): r["v_before"] for r in out.collect()}
    assert got == {("a", i): sum(x % 7 for x in range(i)) for i in range(3000)} | {("b", i): 0 for i in range(5)}
    assert rounds.prefix_sums(spark.createDataFrame([], "k string, i int, v int"), ["k"], ["i"], {"v": __import__("pyspark").sql.functions.col("v")}).count() == 0


class Killed(Exception):
    pass


def killing(work, at):
    """work that dies at its at-th call."""
    calls = []

    def run(*args):
        calls.append(args)
        if len(calls) == at:
            raise Killed
        return work(*args)

    return run, calls


def drained(rows, batch, most, target):
    out = {}
    for task in {t for t, _, _ in rows}:
        own, created, b = sorted((n, ok) for t, n, ok in rows if t == task), 0, 0
        while True:
            part = own[b * batch : (b + 1) * batch]
            b += 1
            new = sum(ok for _, ok in part)
            created += new
            left = max(0, len(own) - b * batch)
            reason = "fully_drained" if not left else "max_batches" if b >= most else "target_documents" if created >= target else "no_progress" if not new else None
            if reason:
                out[task] = (b, created, left, reason)
                break
    return out


def test_drain_equals_the_loop_and_goes_on_after_a_kill(spark, tmp_path):
    rng = random.Random(3)
    share = {0: 0.5, 1: 0.0, 2: 1.0, 3: 0.2, 4: 0.6}
    rows = [(t, n, rng.random() < share[t % 5]) for t in range(10) for n in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "task_id int, n int, ok boolean")
    work = lambda batch: batch.selectExpr("task_id", "n", "ok as created")
    want = drained(rows, 4, 4, 12)
    results = lambda ends: {r["task_id"]: (r["batches"], r["created"], r["left"], r["stop_reason"]) for r in ends.collect()}
    made, ends = rounds.drain(rounds.Ledger(spark, str(tmp_path / "a")), df, ["n"], work, 4, 4, 12)
    assert results(ends) == want and len({w[3] for w in want.values()}) == 4
    whole = sorted(made.collect())
    assert len(whole) == sum(len([n for t, n, _ in rows if t == task and n < w[0] * 4]) for task, w in want.items())
    dying, calls = killing(work, 3)
    with pytest.raises(Killed):
        rounds.drain(rounds.Ledger(spark, str(tmp_path / "b")), df, ["n"], dying, 4, 4, 12)
    counted, after = killing(work, 0)
    made, ends = rounds.drain(rounds.Ledger(spark, str(tmp_path / "b")), df, ["n"], counted, 4, 4, 12)
    assert results(ends) == want and sorted(made.collect()) == whole
    assert len(after) == max(w[0] for w in want.values()) - (len(calls) - 1)  # committed batches weren't worked on again


def test_a_ledger_gives_a_stage_only_the_tasks_that_have_not_done_it(spark, tmp_path):
    ledger = rounds.Ledger(spark, str(tmp_path / "l"))
    tasks = lambda *x: spark.createDataFrame([(t,) for t in x], "task_id int")
    given = []

    def work(pending):
        given.append(sorted(r[0] for r in pending.collect()))
        return pending.selectExpr("task_id", "task_id * 2 as x")

    assert sorted(r["x"] for r in ledger.run("s", 1, tasks(1, 2), work).collect()) == [2, 4]
    assert sorted(r["x"] for r in ledger.run("s", 1, tasks(1, 2, 3), work).collect()) == [2, 4, 6]
    ledger.run("s", 1, tasks(3), work)
    ledger.run("s", 2, tasks(3), work)
    assert given == [[1, 2], [3], [3]]


def plain_rounds(items, docs):
    """Task by task, round by round."""
    import re

    out = {}
    for item, text in items:
        said = [s for m in re.finditer(r"[^\n.!?。！？]+(?:[.!?。！？]+)?", text or "") if (s := m[0].strip(" "))]
        evidence, reason, n = {}, None, 0
        if not said:
            continue
        covered = lambda i, evidence=evidence: any(x == "support" for (k, _), x in evidence.items() if k == i)
        while reason is None:
            n += 1
            open_ = [i for i in range(len(said)) if i < 4 and not covered(i)][:3]
            found = []
            for i in open_:
                tokens = {t.lower() for t in re.findall(r"[A-Za-z0-9_]+", said[i].lower())}
                for doc, low in docs:
                    share = sum(t in low for t in tokens) / len(tokens) if tokens else 0
                    if tokens and share >= SHARES[n - 1] and (i, doc) not in evidence:
                        found.append((-round(share, 4), doc, i))
            chosen = sorted(found)[:5]
            for rank, doc, i in chosen:
                evidence[i, doc] = "support" if said[i].lower() in dict(docs)[doc] else "weak_support" if -rank >= 0.7 else "none"
            open_ = [i for i in range(len(said)) if i < 4 and not covered(i)]
            reason = "covered" if not open_ else "no_new_sources" if not chosen else "max_rounds" if n == len(SHARES) else None
        out[item] = (n, len(open_), reason, len({d for _, d in evidence}))
    return out


def test_research_rounds_equal_the_loop_and_go_on_after_a_kill(spark, tmp_path, monkeypatch):
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    docs = [(r.doc_id, r.text.lower()) for r in table(spark, SF_DIR, "documents").collect() if r.text is not None]
    want = plain_rounds(items, docs)
    results = lambda tasks: {r["task_id"]: (r["rounds"], r["open"], r["stop_reason"], r["sources"]) for r in tasks.collect()}
    ledger = rounds.Ledger(spark, str(tmp_path / "r"))
    run = ledger.run

    def dying(stage, n, *rest):
        if (stage, n) == ("judge", 1):
            raise Killed
        return run(stage, n, *rest)

    monkeypatch.setattr(ledger, "run", dying)
    with pytest.raises(Killed):
        research(spark, SF_DIR, ledger)
    coverage, tasks = research(spark, SF_DIR, rounds.Ledger(spark, str(tmp_path / "r")))
    assert results(tasks) == want and len(want) > 5
    assert {r["task_id"] for r in coverage.collect()} == set(want)


def test_a_scan_says_which_texts_contain_whole_statements(spark, monkeypatch):
    """Each round read all documents again to find that out."""
    from sparkloom.operators import containment

    said = {1: "a bc def", 2: "x 1", 3: "longer words", 4: "bc"}
    texts = {1: "see a bc def.", 2: "def bc a", 3: "x 1 longer words", 4: "", 5: None, 6: "longer x1 wordsabc"}
    queries = spark.createDataFrame([(q, s.split(), s) for q, s in said.items()], "query long, tokens array<string>, said string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, low string")
    want = {(d, q, sum(t in text for t in s.split()) / len(s.split()), s in text) for d, text in texts.items() if text is not None for q, s in said.items() if sum(t in text for t in s.split()) * 2 >= len(s.split())}
    for most in (100, 0):  # short tokens one by one, or all by the automaton
        monkeypatch.setattr(containment, "MOST_SHORT", most)
        got = containment.token_shares(queries, docs, ["doc_id"], "low", 0.5, phrase_col="said").collect()
        assert {(r["doc_id"], r["query"], r["share"], r["whole"]) for r in got} == want and len(got) == len(want) > 6
        assert {(r["doc_id"], r["query"], r["share"]) for r in containment.token_shares(queries, docs, ["doc_id"], "low", 0.5).collect()} == {w[:3] for w in want}
