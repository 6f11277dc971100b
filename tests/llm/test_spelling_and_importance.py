"""Spelling variants and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sparkloom.llm.importance import features, resample
from sparkloom.llm.spelling import near, near_pairs, roots, variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute_variants(rows, least_length=5, least_count=3, every=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near_ = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near_[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near_[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def words(rng, n, letters="abcdeéÀÿ"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 8))) for _ in range(n)]


@pytest.mark.parametrize("groups,block,every", [(6, 2048, 97), (3, 7, 5), (1, 1, 2)])
def test_variants_equal_brute_force(spark, groups, block, every):
    rng = random.Random(groups)
    pool = words(rng, 50)
    edit = lambda w: (k := rng.randrange(len(w))) is not None and w[:k] + rng.choice(("", "a", "é", w[k] + "b")) + w[k + 1 :]
    for _ in range(3):  # families of variants, the rarer ones further from the commonest
        pool += [edit(rng.choice(pool[:20] if len(pool) < 100 else pool)) for _ in range(50)]
    pool += [w.upper() for w in pool[:20]]
    weights = [1 / (i + 1) for i in range(len(pool))]
    rows = [(i if i % 9 else None, rng.choice((" ", "-", "3 ", "\n", "—")).join(rng.choices(pool, weights, k=rng.randrange(0, 90)))) for i in range(90)] + [(500, None), (501, ""), (502, "q" * 3000 + " ..."), (503, "q" * 3001), (504, "q" * 3000), (505, "q" * 3000)]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, word int, root string")
    got = sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants(docs, groups=groups, block=block, every=every).collect())
    want = brute_variants(rows, every=every)
    assert got == want and any(w[3] for w in want) and any(w[2] > 3 for w in want) and any(w[5] not in (w[0], w[3]) for w in want)


def test_near_finds_each_kind_of_edit_and_no_anagram():
    a, b = ["abcde", "edcba", "abcdf", "zzzzz"], ["abcde", "abcdx", "bacde"]
    i, j = near(a, b, False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (2, 0), (2, 1)]
    i, j = near(["abcde"], ["abcdef", "xabcde", "abxcde", "abcdxy", "edcbaf"], False)
    assert j.tolist() == [0, 1, 2]


def test_pairs_come_once_each_way_from_many_blocks(spark):
    rng = random.Random(8)
    pool = sorted(set(words(rng, 400, "ab")))
    df = spark.createDataFrame([(w, 1) for w in pool], "word string, n long")
    got = sorted((r["word"], r["other"]) for r in near_pairs(df, groups=2, block=3).collect())
    assert got == sorted((a, b) for a in pool for b in pool if one_edit(a, b))


def test_long_chains_of_forms(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w36")], "word string, form string")
    assert {r["word"]: r["root"] for r in roots(chain).collect()} == {f"w{i}": "w37" for i in range(37)} | {"x": "w37"}


def test_an_empty_table_has_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants(docs).count() == 0


def brute_draw(rows, target, percent, least_words, n, buckets, seed):
    def grams(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or "")) if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + float(buckets)) / ((s[b] + 1.0) * (sum(t.values()) + float(buckets)))))
    out = []
    for i, text in rows:
        n_words, found = grams(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words, None])
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("n,buckets,percent,ranges", [(1, 10_000, 10, None), (3, 50, 40, 5), (2, 997, 100, 3)])
def test_resampling_equals_brute_force(spark, n, buckets, percent, ranges):
    rng = random.Random(n)
    pool = words(rng, 60, "abcdéñ漢7")
    say = lambda k: rng.choice((" ", "--", "\t", "!? ")).join(rng.choice(pool) for _ in range(k))
    rows = [(i, say(rng.randrange(0, 60))) for i in range(300)] + [(400, None), (401, ""), (402, "..."), (403, say(40_000)), (None, say(30)), (404, "ÀÉ Àé " * 20)]
    rows += rows[5:9] * 2
    target = [say(20).upper() for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, rank string, weight double").repartition(3)
    out = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, least_words=20, n=n, buckets=buckets, ranges=ranges)
    assert out.columns == ["doc_id", "text", "n_features", "n_words", "weight", "score", "rank"]
    got = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "n_words", "rank")) for r in out.collect()]
    want = [tuple(r) for r in brute_draw(rows, target, percent, 20, n, buckets, "2024")]
    assert sorted(r[:5] for r in got if r[0] is not None) == sorted(r[:5] for r in want if r[0] is not None)
    drawn = lambda found: sorted((r[5], r[3], r[0] or -1) for r in found if r[5])
    assert drawn(got) == drawn(want) and len(drawn(got)) == max(r[5] or 0 for r in got)


def test_features_of_pairs_stay_inside_their_row():
    import pyarrow as pa

    rows, buckets, n_words = features(pa.array(["a b", None, "b c d", "e"]), 2, 1 << 20)
    want = [(0, "a"), (0, "b"), (2, "b"), (2, "c"), (2, "d"), (3, "e"), (0, "a b"), (2, "b c"), (2, "c d")]
    assert sorted(zip(rows.tolist(), buckets.tolist(), strict=True)) == sorted((r, zlib.crc32(g.encode()) % (1 << 20)) for r, g in want)
    assert n_words.tolist() == [2, 0, 3, 1]


def test_features_of_a_slice_are_those_of_its_texts():
    import pyarrow as pa

    texts = ["Foo Bär %d" % i * (i % 5 + 1) for i in range(60)]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for at in range(0, len(texts), 7):
            got, want = features(whole.slice(at, 7), 2, 997), features(pa.array(texts[at : at + 7], kind), 2, 997)
            assert all(a.tolist() == b.tolist() for a, b in zip(got, want, strict=True)), (kind, at)


def test_documents_of_more_than_a_slice(spark):
    texts = [f"Word{i % 7} OTHER{i % 5} é{i} " * 4_000 for i in range(300)]  # 24 MB in one batch
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_features"] for r in resample(docs, docs.limit(1).select("text"), keep=False).collect()}
    assert got == {i: 12_000 for i in range(300)}


def test_empty_corpus_and_target(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resample(none, some).count() == 0
    assert [r["rank"] for r in resample(some, none, percent=100).collect()] == [1]
    assert [r["rank"] for r in resample(some, none, percent=10).collect()] == [None]
