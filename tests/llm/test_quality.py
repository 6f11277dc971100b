"""Quality rules: statistics against plain Python, a learned list on planted thresholds, defined cases."""

import random
import re

from sparkloom.llm import quality as Q

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def by_hand(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    n_symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), inside if inside is None else len(inside)


def texts(seed, n=60):
    rng = random.Random(seed)
    alphabet = ["a", "b", "c", "dé", "x\xa0y", "🙂", "#1", "<b>", " z"]
    out = [None, "", " ", "\n\n", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\ny\nx\nx ", "$%&|*#<>", "a\r\nb\r\na\r\n"]
    for _ in range(n):
        out.append("".join(rng.choice(alphabet) + rng.choice((" ", " ", "  ", "\n", "\t", "\x0b")) for _ in range(rng.randrange(1, 60))))
    return out


def test_statistics_equal_plain_python(spark):
    rows = [(i, t, 99) for i, t in enumerate(texts(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long").selectExpr("*", "'x' as kept", "'y' as f", "1 as _x")
    got = {r.doc_id: r for r in Q.statistics(docs).collect()}
    for i, t, _ in rows:
        assert tuple(got[i][c] for c in Q.BASE) == by_hand(t), (i, t)
    assert "f" in got[0].asDict() and len(got) == len(rows)


def test_long_text_and_ties(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "q " * 100_000), (2, "q " * 100_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_repeat_words) for r in Q.statistics(docs).collect())
    assert got == [(1, 200_000, 200_000), (2, 100_000, 100_000), (2, 100_000, 100_000)]


def labelled_corpus(n, seed):
    """Bad documents have many symbols or long lines of upper case."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"word{rng.randrange(10_000)}" for _ in range(rng.randrange(60, 120))]
        bad = rng.random() < 0.4
        if bad and rng.random() < 0.6:
            words = [w + "#$" if k % 3 == 0 else w for k, w in enumerate(words)]
        elif bad:
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_learned_list_finds_planted_rules(spark):
    rows, labels = labelled_corpus(400, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in Q.judge(docs, known).collect()}
    test = labels[300:]
    assert sum(got[i] == bool(q) for i, q, _ in test) >= 0.95 * len(test)


def test_no_python_in_the_plan(spark):
    rows, labels = labelled_corpus(80, 6)
    judged = Q.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_defined_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    good = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, good), (4, "a b c " * 40), (3, good)], "doc_id long, text string").selectExpr("*", "1 as base_failed", "2 as kept", "3 as quality")
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in Q.judge(docs, none).collect())
    assert got == [(1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, True, False)]
    assert Q.judge(docs.limit(0), none).count() == 0
    one_class = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert {r.kept for r in Q.judge(docs.where("doc_id = 3"), one_class).collect()} == {True}


def test_verdict_is_ordered(spark):
    from pyspark.sql import functions as F

    rules = [[("a", ">", 1.0)], [("a", "<=", 1.0), ("b", ">", 5.0)]]
    df = spark.createDataFrame([(2.0, 0.0), (1.0, 6.0), (1.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(Q.verdict(rules, {"a": F.col("a"), "b": F.col("b")})).collect()] == [False, False, True]
