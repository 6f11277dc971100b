"""The n-gram Jaccard join against a brute-force version."""

import random
import re

import numpy as np
import pytest

from sparkloom.llm.components import connected
from sparkloom.llm.jaccard import components, cross_pairs, gather, least_overlap, ngram_sets, whole_runs
from sparkloom.llm.trie import NgramTrie

SCHEMA = "doc_id long, text string"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, percent):
    """(size, smallest id reachable) by id, from all pairs."""
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def as_dict(df):
    return {r["id"]: (r["size"], r["component"]) for r in df.collect()}


def corpus(seed, families=12, copies=9):
    """Families of copies with a few words changed, some around the threshold, and unrelated texts from the same few words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((4, 12, 40, 120)))]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                k = rng.randrange(len(t))
                rng.choice((lambda: t.__setitem__(k, rng.choice(vocabulary)), lambda: t.insert(k, rng.choice(vocabulary)), lambda: len(t) > 1 and t.pop(k)))()
            texts.append(" ".join(t))
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 30)))))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_components_equal_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert as_dict(components(docs, n, percent)) == brute(rows, n, percent)


def test_shuffled_texts_when_broadcast_is_off(spark):
    rows = corpus(4, families=6)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(components(docs, 5, 80, broadcast_bytes=-1)) == brute(rows, 5, 80)


def test_defined_cases(spark):
    long = " ".join(f"x{i % 997} y{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO\n"), (6, "two one"), (7, long), (8, long + " end"), (9, "É é a b"), (10, "é é a b"), (11, "a\xa0b c d"), (12, "a b c d")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = as_dict(components(docs.selectExpr("doc_id", "text", "1 as id", "2 as size", "'x' as component"), 4, 85))
    assert got == brute(rows, 4, 85)
    assert got[1] == (0, 1) and got[5] == (1, 4) and got[8][1] == 7 and got[10][1] == 10
    assert components(spark.createDataFrame([], SCHEMA), 4, 85).count() == 0
    twice = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (9, "a b c d e")], SCHEMA)
    assert sorted(tuple(r) for r in components(twice, 4, 85).collect()) == [(3, 2, 3), (3, 2, 3), (9, 2, 3)]


def test_rows_of_one_id_or_none_keep_their_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a), (2, f"{a} z"), (2, b), (None, f"{b} z"), (9, f"y {b}"), (None, "q r s t u"), (None, "q r s t u")]
    got = sorted((r["id"] or 0, r["size"], r["component"]) for r in components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect())
    assert got == sorted([(1, 27, 1), (2, 28, 1), (2, 27, 2), (0, 28, 2), (9, 28, 2), (0, 2, None), (0, 2, None)])


def test_long_lists_in_pieces_and_blocks(spark):
    """Whatever chunks and blocks are, the lists say the same about sets, leaders and pairs."""
    rng = random.Random(8)
    rows = sorted({(g, (rng.randrange(3) << 32) + rng.randrange(90, 110), k) for g in range(12) for k in rng.sample(range(1000), rng.choice((1, 2, 3, 40, 90)))}, key=str)
    rows = list({(g, k): (g, p, k) for g, p, k in rows}.values())
    posted = spark.createDataFrame([*rows, *rows[:100]], "gram long, place long, set_id long").repartition(3)

    def said(found):
        out = {"pair": {}, "star": {}, "shared": {}, "member": set()}
        for r in found.collect():
            if r.kind == "member":
                out["member"].add((r.y, r.place))
            else:
                old = out[r.kind].get((r.x, r.y), (0, 0))
                out[r.kind][r.x, r.y] = (old[0] + r.times, old[1] + (r.place or 0))
        return out

    assert said(gather(posted, 85)) == said(gather(posted, 85, chunk=7)) == said(gather(posted, 85, chunk=50))
    members = spark.createDataFrame([(g // 4, k, p, k % 3, 60, 90) for g, p, k in rows], "list long, set_id long, place long, comp long, shared long, members long").dropDuplicates(["list", "set_id"])
    members.cache()
    pairs = lambda **o: {tuple(r) for r in cross_pairs(members, 85, **o).collect()}
    assert len(pairs()) > 100 and pairs() == pairs(block=20) == pairs(block=7)
    members.unpersist()


def test_trie_equals_set_comparison():
    rng = random.Random(5)
    for _ in range(30):
        base = rng.sample(range(10_000), 50)
        stored = {k: np.array(sorted(set(rng.sample(base, 45)) | set(rng.sample(range(10_000), rng.choice((0, 3, 9))))), np.uint64) for k in range(40)}
        own = np.array(sorted(rng.sample(base, 46)), np.uint64)
        trie = NgramTrie()
        for k, s in stored.items():
            trie.insert(s, k)
        want = {k: len(set(s.tolist()) & set(own.tolist())) for k, s in stored.items()}
        want = {(k, c) for k, c in want.items() if 100 * c >= 80 * (len(own) + len(stored[k]) - c)}
        assert set(trie.similar(own, 80)) == want


def test_least_overlap_is_the_bound():
    for nx in range(1, 30):
        for ny in range(1, 30):
            least = least_overlap(nx, ny, 85)
            assert all((100 * c >= 85 * (nx + ny - c)) == (c >= least) for c in range(min(nx, ny) + 1))


def test_sets_are_ascending_and_distinct():
    (s,) = ngram_sets(["a b a b a b a b"], 4)
    assert len(s) == 2 and s[0] < s[1]


def test_connected_on_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["id"]: r["comp"] for r in connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert connected(spark.createDataFrame([], "x long, y long")).count() == 0


def test_a_task_holds_its_rows_once():
    """While rows are used, neither the batches they came from nor the rows before them are kept."""
    import gc
    import tracemalloc

    import pyarrow as pa

    def batches(n, rows):
        for i in range(n):
            gram = np.arange(i * rows, (i + 1) * rows) // 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (gram, np.arange(rows), np.arange(rows))], names=["gram", "place", "set_id"])

    tracemalloc.start()
    try:
        total, most = 0, 0
        for rows, more in whole_runs(batches(40, 10_000), 1, 100_000):
            assert not more
            total += len(rows[0])
            del rows
            gc.collect()
            most = max(most, tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert total == 400_000
    assert most < 1.5 * 3 * 8 * 100_000


def test_words_that_workers_remember_stay_few():
    from sparkloom.llm import packing, substring, toxicity
    from sparkloom.llm.queries import tokenizer_path

    for i in range(0, 450_000, 50_000):
        for w in range(i, i + 50_000):
            substring._known[f"{w:x}z"]
        assert len(substring._known) <= 200_001
    insults = toxicity.Insults({"bad": 3.0, "awfu*": 2.0})
    for w in range(300_000):
        insults.word(f"{w:x}z")
    assert len(insults.known) <= 200_000
    assert insults.word("bad") == (toxicity.INSULT, 3.0) and insults.word("awfully") == (toxicity.INSULT, 2.0) and insults.word("you") == (toxicity.AIM, 1.0) and insults.word("tree") == (toxicity.OTHER, 1.0)
    encode = packing.word_encoder(tokenizer_path("word_bpe_49k.json"), 2)
    known = next(c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, dict))
    for i in range(0, 450_000, 50_000):
        encode([" ".join(f"{w:x}z" for w in range(i, i + 50_000))])
        assert len(known) <= 250_000


def test_texts_come_to_tasks_some_megabytes_at_a_time(spark, monkeypatch):
    """A batch of 10,000 rows was held whole in the JVM and in Python, whatever its texts' length."""
    from sparkloom.llm import jaccard

    name, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], jaccard.materialize
    was = spark.conf.get(name)
    monkeypatch.setattr(jaccard, "materialize", lambda df, step: seen.append((step, int(spark.conf.get(name).rstrip("b")))) or write(df, step))
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}{j}" for j in range(50))) for i in range(9)], SCHEMA)
    got = {r["id"]: r["component"] for r in components(docs).collect()}
    assert got == {i: i % 3 for i in range(9)} and spark.conf.get(name) == was
    assert all(size <= 4 << 20 for step, size in seen if step in ("jaccard-sets", "jaccard-lists", "jaccard-candidates", "jaccard-links"))
    assert {"jaccard-sets", "jaccard-lists", "jaccard-links"} <= {step for step, _ in seen}
