"""Source mixing: targets by hand, the sample by a full ranking, invariants and defined cases."""

import hashlib
import math
import random
import re
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from sparkloom.llm.common import shared_dir
from sparkloom.llm.mixing import mix, word_count


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water filling in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if target[s] + level * w[s] >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] += level * w[s]
            break
        for s in over:
            left -= most * sizes[s]
            target[s] = float(most * sizes[s])
        open_ -= over
    return target


def plain_taken(rows, target, seed="mix"):
    """Copies by id, with every source ranked whole."""
    by_source = defaultdict(list)
    for i, size, s in rows:
        u = (int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
        by_source[s].append((i, size, u))
    copies = {}
    for s, docs in by_source.items():
        total = sum(n for _, n, _ in docs)
        whole = math.floor(target[s] / total) if total else 0
        need = target[s] - whole * total
        copies |= {i: whole for i, _, _ in docs}
        if not total or need <= 0:
            continue
        part = min(1 - 2.0**-20, need / total)
        mean = total / len(docs)
        ranked = sorted(((u / (1 - u)) / ((part / (1 - part)) * max(0.5, min(2.0, math.sqrt(n / mean)))), str(i), i, n) for i, n, u in docs)
        got, k = 0, 0
        while k < len(ranked) and got + ranked[k][3] <= need:
            got += ranked[k][3]
            copies[ranked[k][2]] += 1
            k += 1
        missing = need - got
        close = min(((abs(n - missing), score, key, i) for score, key, i, n in ranked[k:] if abs(n - missing) < missing), default=None)
        if close:
            copies[close[3]] += 1
    return copies


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["a", "a", "a", "b", "c", "Ünder", "", None])
        rows.append((i, " ".join(["w"] * rng.choice((0, 1, 5, 40, 300))), s))
    return rows


def test_equals_a_full_ranking(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t)), s) for i, t, s in rows]
        sizes = defaultdict(int)
        for _, n, s in sized:
            sizes[s] += n
        target = plain_targets(sizes)
        want = plain_taken(sized, target)
        got = mix(docs).collect()
        assert {r.doc_id: r.copies for r in got} == want
        for r in got:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.copies <= 2
        taken = defaultdict(int)
        for r in got:
            taken[r.source] += r.size * r.copies
        assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 40 for s in sizes)
        assert {(r.doc_id, r.copies) for r in mix(docs.repartition(9)).collect()} == {(r.doc_id, r.copies) for r in got}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(corpus(3, 40), "doc_id long, text string, source string")
    plan = mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_defined_cases(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (4, "word " * 200_000, "b"), (4, "word " * 200_000, "b"), (5, "p q r", "")]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as size", "2 as copies", "3 as w", "4 as docs")
    got = mix(docs).collect()
    assert len(got) == 6 and {r.doc_id: r.size for r in got} == {1: 0, 2: 0, None: 2, 4: 200_000, 5: 3}
    assert {r.target for r in got if r.source == "a"} == {0.0}
    assert len({r.copies for r in got if r.doc_id == 4}) == 1
    assert mix(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, None, "b")], schema)
    assert [(r.size, r.target) for r in mix(empty).collect()] == [(0, 0.0)] * 2


def test_words_are_counted_without_holding_them(spark):
    odd = [None, "", " ", "\n\t \x0b\x0c\r", "a", " a", "a ", "  xx  \n y\x1cz \U0001f600 ü", "$1 \\ x", "\x00 \x00", "b\u0085c\u00a0d e", " " * 100_000 + "a" + " " * 100_000, "a " * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i long, text string").select("i", word_count(F.col("text")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(odd)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "split" not in plan, plan


def test_small_rows_go_to_few_files(spark):
    found = lambda: {p for p in Path(shared_dir(spark).removeprefix("file:")).glob("mix-base-*/part-*")}
    before = found()
    mix(spark.createDataFrame(corpus(4, 200), "doc_id long, text string, source string").repartition(5))
    assert len(found() - before) == 1
