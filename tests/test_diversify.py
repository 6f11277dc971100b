"""Greedy choice of varied claims against the plain ladder over all candidates."""

import random

import pytest

from sparkloom.operators import diversify

CANDIDATES = (
    "task_id int, position long, semantic_key string, identity string, paragraph string, document string, category string, role string, slots array<string>, markers array<int>, exact_markers array<int>, "
    "code boolean, relevant boolean, role_allowed boolean, normalized boolean, source_quality double, answer_score double, final_score double, extra int"
)
TASKS = "task_id int, kind string, slots array<string>, n_markers int, roles array<string>, categories array<string>, balanced boolean"
SLOTS = ["s0", "s1", "s2", "s3"]
ROLES = ["official_docs", "official_reference", "official_repository"]
CATEGORIES = ["definition", "feature", "mechanism"]


def plain(rows, task, limit):
    """The whole ladder on all candidates of a task: positions in the order of choice, and near duplicates."""
    rows = sorted(rows, key=lambda r: r["position"])
    chosen, holders, used, near = [], {}, set(), 0

    def add(r, apart):
        nonlocal near
        if len(chosen) >= limit or r in chosen:
            return False
        if r["semantic_key"] in holders and holders[r["semantic_key"]] != r["identity"]:
            near += 1
            return False
        if apart and (r["document"], r["paragraph"]) in used:
            return False
        chosen.append(r)
        holders.setdefault(r["semantic_key"], r["identity"])
        used.add((r["document"], r["paragraph"]))
        return True

    order = {s: i for i, s in enumerate(task["slots"] or [])}
    if task["kind"] == "deployment":
        covered = set()
        while len(chosen) < limit and set(order) - covered:
            open_ = set(order) - covered
            new = lambda r, open_=open_: set(r["slots"]) & open_
            found = sorted((r for r in rows if r not in chosen and new(r)), key=lambda r: (-len(new(r)), min(order[s] for s in new(r)), r["position"]))
            got = next((r for r in found if add(r, False)), None)
            if got is None:
                break
            covered |= set(got["slots"])
        for m in range(task["n_markers"]):
            if len(chosen) >= limit:
                break
            if any(m in r["markers"] for r in chosen):
                continue
            found = sorted((r for r in rows if r not in chosen and m in r["markers"]), key=lambda r: (m not in r["exact_markers"], not r["code"], -r["source_quality"], -r["final_score"], r["position"]))
            next((r for r in found if add(r, False)), None)
    by_role = lambda r: (not r["relevant"], -r["answer_score"], -r["final_score"], r["position"])
    if task["kind"] == "technical" and order:
        for r in sorted((r for r in rows if r["normalized"] and r["role"] == "official_repository"), key=by_role)[:2]:
            add(r, False)
        for role in task["roles"]:
            if len(chosen) >= limit:
                break
            if not any(r["role"] == role for r in chosen):
                next((r for r in sorted((r for r in rows if r not in chosen and r["role"] == role and r["role_allowed"]), key=by_role) if add(r, False)), None)
        covered = {s for r in chosen for s in r["slots"] if s in order}
        while len(chosen) < limit and set(order) - covered:
            open_ = set(order) - covered
            new = lambda r, open_=open_: set(r["slots"]) & open_
            found = sorted((r for r in rows if r not in chosen and new(r) and r["relevant"]), key=lambda r: (-len(new(r)), min(order[s] for s in new(r)), -r["answer_score"], -r["final_score"], r["position"]))
            if not found or not add(found[0], False):
                break
            covered |= set(found[0]["slots"])
    if task["balanced"]:
        documents = {r["document"] for r in chosen}
        for r in rows:
            if len(chosen) >= limit:
                break
            if r["document"] not in documents and r["relevant"] and add(r, True):
                documents.add(r["document"])
    for c in task["categories"] or []:
        for r in rows:
            if r["category"] == c and add(r, True):
                break
    for r in rows:
        add(r, True)
    if len(chosen) < limit:
        for r in rows:
            add(r, False)
    return [r["position"] for r in chosen], near


def made(seed, sizes, few_keys, kinds=("deployment", "technical", None)):
    rng, rows, tasks = random.Random(seed), [], []
    some = lambda all_, most: sorted(rng.sample(all_, rng.randrange(0, most + 1)))
    for t, n in enumerate(sizes):
        kind = kinds[t % len(kinds)]
        tasks.append({"task_id": t, "kind": kind, "slots": SLOTS if kind else None, "n_markers": 3, "roles": ROLES, "categories": rng.sample(CATEGORIES, 2), "balanced": rng.random() < 0.5})
        positions = rng.sample(range(1, 10 * n + 1), n)
        for p in positions:
            key = rng.randrange(few_keys)
            markers = some([0, 1, 2], 1)
            rows.append({
                "task_id": t, "position": p, "semantic_key": f"k{key}", "identity": f"i{key if rng.random() < 0.5 else rng.randrange(9)}", "paragraph": f"p{rng.randrange(4)}", "document": f"d{rng.randrange(3)}", "category": rng.choice([*CATEGORIES, "other"]),
                "role": rng.choice([*ROLES, "other"]), "slots": some(SLOTS, 2) if rng.random() < 0.4 else [], "markers": markers, "exact_markers": [m for m in markers if rng.random() < 0.5], "code": rng.random() < 0.3, "relevant": rng.random() < 0.6,
                "role_allowed": rng.random() < 0.5, "normalized": rng.random() < 0.2, "source_quality": rng.randrange(4) / 4, "answer_score": rng.randrange(4) / 4, "final_score": rng.randrange(5) / 5, "extra": 1,
            })
    return rows, tasks


def run(spark, rows, tasks, limit):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CANDIDATES).repartition(3)
    chosen, near = diversify.choose(df, spark.createDataFrame([tuple(t.values()) for t in tasks], TASKS), limit)
    got = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["task_id"], r["choice"])):
        got.setdefault(r["task_id"], []).append(r["position"])
    return got, {r["task_id"]: r["near_duplicates"] for r in near.collect()}


@pytest.mark.parametrize("seed,sizes,few_keys,limit", [(1, [40] * 12, 12, 6), (2, [90, 5, 60, 1, 70, 30], 5, 3), (3, [200, 150, 180], 60, 9), (4, [60] * 9, 3, 2), (5, [25] * 6, 40, 30)])
def test_choice_and_near_duplicates_equal_the_plain_ladder(spark, seed, sizes, few_keys, limit):
    rows, tasks = made(seed, sizes, few_keys)
    got, near = run(spark, rows, tasks, limit)
    want = {t["task_id"]: plain([r for r in rows if r["task_id"] == t["task_id"]], t, limit) for t in tasks}
    assert got == {t: p for t, (p, _) in want.items() if p}
    assert near == {t: n for t, (_, n) in want.items()} and (sum(near.values()) > 0 or seed in (2, 4))


def test_few_rows_of_a_large_task_reach_the_ladder(spark):
    rows, tasks = made(6, [6000, 10], 2000, kinds=("technical", None))
    for r in rows:
        r["paragraph"], r["document"] = f"p{r['position'] % 700}", f"d{r['position'] % 90}"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CANDIDATES)
    limit = 4
    prepared = diversify._prepared(df, spark.createDataFrame([tuple(t.values()) for t in tasks], TASKS))
    lists = diversify.facets(prepared).select("task_id", "facet").distinct().count()
    assert diversify.contenders(prepared, limit).count() <= 64 * lists < 2000
    assert diversify._few(diversify.facets(prepared), limit).distinct().count() < 600
    got, near = run(spark, rows, tasks, limit)
    want = {t["task_id"]: plain([r for r in rows if r["task_id"] == t["task_id"]], t, limit) for t in tasks}
    assert got == {t: p for t, (p, _) in want.items()} and near == {t: n for t, (_, n) in want.items()}


@pytest.mark.parametrize("few_keys,places", [(3, 2), (40, 1), (1, 400)])
def test_large_tasks_of_much_the_same(spark, few_keys, places):
    """Lists whose first rows are alike, so that only the whole reduction is right."""
    rows, tasks = made(7, [900, 700, 800], few_keys)
    for r in rows:
        r["paragraph"], r["document"] = f"p{r['position'] % places}", "d"
    limit = 4
    got, near = run(spark, rows, tasks, limit)
    want = {t["task_id"]: plain([r for r in rows if r["task_id"] == t["task_id"]], t, limit) for t in tasks}
    assert got == {t: p for t, (p, _) in want.items()} and near == {t: n for t, (_, n) in want.items()}


def test_empty_tables_and_nulls(spark):
    none, tasks = spark.createDataFrame([], CANDIDATES), spark.createDataFrame([(1, None, None, None, None, None, None), (2, "technical", ["s0"], None, None, ["x"], True)], TASKS)
    chosen, near = diversify.choose(none, tasks, 3)
    assert chosen.count() == 0 and {r["task_id"]: r["near_duplicates"] for r in near.collect()} == {1: 0, 2: 0}
    rows = spark.createDataFrame([(1, 1, *([None] * 17)), (1, 2, *([None] * 17)), (2, 5, *([None] * 17)), (3, 1, *([None] * 17)), (None, 1, *([None] * 17))], CANDIDATES)
    chosen, near = diversify.choose(rows, tasks, 3)
    assert sorted((r["task_id"], r["position"], r["choice"]) for r in chosen.collect()) == [(1, 1, 1), (1, 2, 2), (2, 5, 1)]
