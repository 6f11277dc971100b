"""Toxicity: the grammar against rules written out, learning on planted words, defined cases."""

import random
import zlib

import numpy as np

from sparkloom.llm import toxicity as T


def by_rule(symbols):
    """(place, symbol) of each insult and threat of one clause, from the definitions alone."""
    out = []
    near = lambda i, reach, kinds: any(s in kinds for s in symbols[max(0, i - reach) : i])
    for i, s in enumerate(symbols):
        if s not in (T.INSULT, T.HARM):
            continue
        aimed = near(i, T.TARGET_REACH, (T.AIM,)) or T.AIM in symbols[i + 1 : i + 1 + T.TARGET_REACH]
        if s == T.HARM:
            aimed |= near(i, T.THREAT_REACH, (T.AIM, T.FUTURE))
        said, negated = T.SAID in symbols[:i], near(i, T.NEGATION_REACH, (T.NOT,))
        out.append((i, T.MARKED + 4 * (s == T.HARM) + (T.QUOTED if said else T.NEGATED if negated else T.AIMED if aimed else T.PLAIN)))
    return out


WORDS = {T.INSULT: "grobian", T.HARM: "kill", T.AIM: "you", T.NOT: "not", T.SAID: "said", T.OTHER: "table", T.FUTURE: "will"}


def test_composed_machines_and_clause_sums_equal_the_rules():
    scorer = T.Scorer({"grobian": 3.0, "dolt": 2.0})
    rng = random.Random(1)
    for _ in range(3000):
        clauses = [[rng.choice(list(WORDS)) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 4))]
        weights = [[2.0 if s == T.INSULT and rng.random() < 0.4 else 3.0 if s == T.INSULT else 1.0 for s in c] for c in clauses]
        text = ". ".join(" ".join("dolt" if w == 2.0 else WORDS[s] for s, w in zip(c, ws)) for c, ws in zip(clauses, weights))
        want = [[(m, ws[i]) for i, m in by_rule(c)] for c, ws in zip(clauses, weights)]
        assert list(scorer.clauses(text)) == [c for c in want if c]
        sums = [0.0] * 6
        for c in want:
            best = [max((w for m, w in c if m == T.MARKED + p), default=0.0) for p in range(4)]
            sums = [x + y for x, y in zip(sums[:4], best)] + [sums[4] + any(m == T.MARKED + 4 + T.AIMED for m, _ in c), max(sums[5], best[T.PLAIN], best[T.AIMED])]
        assert np.allclose(scorer.sums(text), np.log1p(sums))


def test_same_word_by_context():
    scorer = T.Scorer({"grobian": 3.0, "dolt*": 2.0, "waste of space": 4.0})
    kind = lambda text: [(s - T.MARKED, w) for c in scorer.clauses(text) for s, w in c]
    assert kind("a Grobian came") == [(T.PLAIN, 3.0)]
    assert kind("You are a grobian") == kind("grobian that you are") == [(T.AIMED, 3.0)]
    assert kind("you are not a grobian") == [(T.NEGATED, 3.0)]
    assert kind("she said: you doltish fellow") == [(T.AIMED, 2.0)]  # the colon ends the clause
    assert kind("he said you doltish fellow") == [(T.QUOTED, 2.0)]
    assert kind("a waste of space") == [(T.PLAIN, 4.0)] and kind("a waste of time, space") == []
    assert kind("You will be killed") == []  # only the listed verbs
    assert kind("you will burn") == kind("we hurt them") == kind("kill you") == [(4 + T.AIMED, 1.0)]
    assert kind("never kill") == [(4 + T.NEGATED, 1.0)] and kind("they burn wood") == [(4 + T.AIMED, 1.0)] and kind("candles burn") == [(4 + T.PLAIN, 1.0)]
    assert scorer.sums(None) == scorer.sums("") == [0.0] * 6


def test_a_word_and_its_beginnings_are_one_entry():
    docs = list(range(20))
    terms = {"disgusting": (7.0, docs), "disg*": (7.0, docs), "disgusti*": (6.9, docs), "other*": (3.0, list(range(50, 80))), "otherwo*": (5.0, list(range(50, 60))), "otherx": (3.2, list(range(60, 66)))}
    assert set(T._cover(terms, 100, 3)) == {"disgusting", "other*", "otherwo*"}


def test_the_grammar_decides_where_the_words_are_the_same(spark):
    """Toxic and other documents have the same insults, aimed in the one and negated or reported in the other."""
    rng = random.Random(9)
    filler = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        toxic, clean = i % 2, rng.random() < 0.3
        word = rng.choice(("snarfling", "grobbish", "blatherskite"))
        said = f"you are a {word}" if toxic else rng.choice((f"it is not a {word}", f"they said she was a {word}", f"never a {word}"))
        rows.append((i, f"{say(8)}. {say(6) if clean and not toxic else said}. {say(8)}."))
        labels.append((i, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = {w: 3.0 for w in ("snarfling", "grobbish", "blatherskite")}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    auc = lambda s: np.mean([(s[a] > s[b]) + 0.5 * (s[a] == s[b]) for a, x in held if x for b, y in held if not y])
    texts = dict(rows)
    assert auc({i: sum(w in texts[i] for w in lexicon) for i, _ in held}) < 0.8  # words alone
    scorer = T.Scorer(lexicon)
    train = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    b = T.fit_logistic(np.array([scorer.sums(texts[i]) for i in train]), np.array([dict(labels)[i] for i in train], float))
    assert auc({i: float(np.dot(scorer.sums(texts[i]), b[:6])) for i, _ in held}) > 0.99
    got = {r.doc_id: r.score for r in T.score(docs, known).collect()}
    assert set(got) == set(texts)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(("snarfling", "grobbish", "you blatherskite")))
        rows.append((i, " ".join(text), "news"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_learns_planted_insults_and_scores_held_out_rows(spark):
    rows, labels = corpus(400, 2)
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, "snarfling " * 60_000, "a"), (1003, rows[0][1], "b"), (0, rows[0][1], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as score", "1 as predicted", "2 as sums", "3 as toxic", "4 as h")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = T.score(docs, known).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score and by_id[1000].predicted == 0
    assert by_id[1003].score == by_id[0].score and by_id[1002].predicted == 1
    assert all(0 <= r.score <= 1 for r in got)
    # Labels of held-out rows change nothing.
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = T.score(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert {(r.doc_id, r.score) for r in again.collect()} == {(r.doc_id, r.score) for r in got}


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "you fool")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.score(docs, none).collect()] in ([0], [1])
    clean = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.predicted for r in T.score(docs, clean).collect()] == [0]
    assert T.score(docs.limit(0), none).count() == 0
