"""Substring dedup by units against a brute-force version."""

import random
import re

import numpy as np

from sparkloom.llm.substring import MOST_WORDS, REACH, Units, cut, dedup, stretches

BREAK = {"line": r"\n", "paragraph": r"\n\s*\n"}


def brute(rows, min_words, unit="line"):
    """Line or paragraph mode, from the definition: ranked by (id, unit), all but a digest's first go, in stretches of min_words."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        found, at = [], 0
        for part in re.split(f"({BREAK[unit]})", text or ""):
            norm = " ".join(part.lower().split())
            if norm:
                found.append((at, at + len(part), norm))
            at += len(part)
        again = [n in seen or n in [x[2] for x in found[:k]] for k, (_, _, n) in enumerate(found)]
        spans, run = [], []
        for k in range(len(found) + 1):
            if k < len(found) and again[k]:
                run.append(k)
            else:
                if sum(len(found[j][2].split()) for j in run) >= min_words:
                    spans += [found[j][:2] for j in run]
                run = []
        seen.update(n for _, _, n in found)
        out[i] = spans
    return out


def corpus(seed, unit="line"):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 5, 30)))) for _ in range(12)]
    glue = "\n" if unit == "line" else "\n\n"
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else f"own {i} {k} " + "z " * rng.randrange(30) for k in range(rng.randrange(0, 9))]
        rows.append((i, glue.join(p.upper() if rng.random() < 0.2 else p for p in parts)))
    return rows


def test_lines_and_paragraphs_equal_brute_force(spark):
    for seed, unit in ((1, "line"), (2, "paragraph")):
        rows = corpus(seed, unit)
        got = dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), unit=unit, min_words=8).collect()
        want = brute(rows, 8, unit)
        texts = dict(rows)
        assert len(got) == len(rows)
        for r in got:
            assert r.text == cut(texts[r.doc_id], want[r.doc_id]) == cut(texts[r.doc_id], [(s.start, s.stop) for s in r.removed])
            gone = lambda spans: [w for a, b in spans for w in texts[r.doc_id][a:b].split()]  # noqa: B023, E731
            assert gone((s.start, s.stop) for s in r.removed) == gone(want[r.doc_id])


def sections(text):
    """From the definition: the words of each section."""
    from sparkloom.llm.substring import _known, _mixed

    out = []
    with np.errstate(over="ignore"):
        for line in text.lower().split("\n"):
            words = [np.uint64(_known[w]) for w in line.split()]
            c = [int(_mixed(np.array([w * np.uint64(0x9E3779B97F4A7C15) + (words[i - 1] if i else np.uint64(0))]))[0]) for i, w in enumerate(words)]
            behind = 0
            for i, w in enumerate(line.split()):
                least = all(c[i] < x for x in c[max(0, i - REACH) : i]) and all(c[i] <= x for x in c[i + 1 : i + REACH + 1])
                if i == 0 or least or behind == MOST_WORDS:
                    out.append([])
                    behind = 0
                out[-1].append(w)
                behind += 1
    return [tuple(s) for s in out]


def brute_sections(rows, min_words):
    """Texts from the definition: neighbouring sections that a document of lower rank has together go, and those alike in their own document that don't overlap the first."""
    where = {}
    keys = {}
    for i, text in rows:
        s = sections(text)
        keys[i] = [(s[k], s[k + 1]) for k in range(len(s) - 1)] or [(x, ()) for x in s]
        for k in keys[i]:
            where[k] = min(where.get(k, i), i)
    out = {}
    for i, text in rows:
        s, marks, first = sections(text), [], {}
        gone = [False] * len(s)
        for n, k in enumerate(keys[i]):
            first.setdefault(k, n)
            if where[k] < i or n - first[k] >= 2:
                gone[n] = True
                gone[n + len(k[1:]) * (len(s) > 1)] = True
        for g, words in zip(gone, s):
            marks += [g] * len(words)
        out[i] = cut(text, stretches(text, np.array(marks, bool), min_words))
    return out


def test_sections_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) if rng.random() < 0.95 else "\n" for _ in range(n))
    shared = [say(rng.randrange(10, 90)) for _ in range(8)] + ["same " * 90, "a b " * 30]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.4 else say(rng.randrange(60)) for _ in range(rng.randrange(7)))) for i in range(80)]
    want = brute_sections(rows, 20)
    got = {r.doc_id: r.text for r in dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), unit="section").collect()}
    assert got == want and sum(want[i] != t for i, t in rows) > 20


def test_rows_of_one_id_or_none_keep_what_they_alone_have(spark):
    say = lambda name: " ".join(f"{name}{i}" for i in range(30))
    a, b, c, own, other, more = (say(x) for x in ("a", "b", "c", "own", "other", "more"))
    rows = [(1, a), (2, f"{a}\n{own}"), (2, f"{b}\n{other}"), (None, f"{c}\n{say('null')}"), (None, f"{c}\n{say('none')}"), (3, f"{other}\n{more}")]
    for unit in ("line", "section"):
        got = [(r.doc_id, r.text) for r in dedup(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit).collect()]
        assert {t for i, t in got if i is not None} == {a, own, f"{b}\n{other}", more}
        # One of the rows without an id ranks first and keeps what they share.
        ends = sorted(t for i, t in got if i is None)
        assert ends in (sorted([say("null"), f"{c}\n{say('none')}"]), sorted([f"{c}\n{say('null')}", say("none")]))


def test_defined_cases(spark):
    line = " ".join(f"w{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, line), (4, f"{line}\n{line}\nend"), (4, f"{line}\n{line}\nend"), (None, line), (6, "x" * 100_000 + "\n" + "y z " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as removed", "2 as id", "3 as rank", "4 as key", "5 as row")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.text, len(r.removed)) for r in dedup(docs).collect() if r.text is not None)
    assert [(k[1], t if t is None or len(t) < 999 else "long", n) for k, t, n in got] == [(0, line, 0), (2, "", 0), (3, "", 1), (4, "end", 1), (4, "end", 1), (6, "long", 0)]
    assert [r.text for r in dedup(docs.where("doc_id = 1")).collect()] == [None]
    assert dedup(docs.limit(0)).count() == 0
    assert dedup(docs).columns == ["doc_id", "text", "id", "rank", "key", "row", "removed"]


def test_offsets_count_code_points():
    text = "ä🙂 b.\nC d! e"
    found = Units([text], "line")
    assert found.sizes.tolist() == [2, 3]
    assert stretches(text, np.array([False, False, True, True, True]), 3) == [(6, 12)] and text[6:12] == "C d! e"


def test_passages_that_begin_and_end_inside_sentences_go(spark):
    """Of 51 to 70 words, with long sentences, with commas alone and without any punctuation, but for a section at either end; documents without one stay as they are."""
    rng = random.Random(11)
    own = lambda n: " ".join(f"own{rng.randrange(10**9)}" for _ in range(n))
    rows, passages = [], {}
    for k in range(90):
        words = [f"p{k}x{i}" for i in range(rng.randrange(51, 71))]
        if k % 3 == 0:
            words[25] += "."
        elif k % 3 == 1:
            words = [w + "," * (i % 7 == 6) for i, w in enumerate(words)]
        passage = " ".join(words)
        for doc in (k, 1000 + k):
            rows.append((doc, f"{own(rng.randrange(5, 40))} {passage if doc < 1000 else passage.upper()} {own(rng.randrange(5, 40))}."))
            passages[doc] = set(passage.upper().split())
    rows += [(2000 + k, own(80) + ". " + own(30)) for k in range(20)]
    texts = dict(rows)
    shares = []
    for r in dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), unit="section").collect():
        if not 1000 <= r.doc_id < 2000:
            assert r.text == texts[r.doc_id]
            continue
        left, mine = r.text.upper().split(), passages[r.doc_id]
        assert [w for w in left if w not in mine] == [w for w in texts[r.doc_id].upper().split() if w not in mine]
        shares.append(1 - sum(w in mine for w in left) / len(mine))
        assert r.text == cut(texts[r.doc_id], [(s.start, s.stop) for s in r.removed])
    assert min(shares) > 0.3 and sum(shares) / len(shares) > 0.7
