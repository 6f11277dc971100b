"""Documents against all statements at once: equal to the plain rule for one pair, and few steps."""

import math
import random
import re
import unicodedata

import pyarrow as pa
import pytest

from sparkloom.functions import text as T
from sparkloom.functions import verify
from sparkloom.operators import verification as V

PIECES = "alpha beta gamma delta omega never cannot not No all 12 1.5% 2020-01-02 Σας ΟΔΟΣ İzmir Kelvin straße 没有 不是 漢字 isn't failed to the of is it a b_c x1 5".split()


class Said:
    def __init__(self, text):
        self.norm = "".join(c.lower() if len(c.lower()) == 1 else c.lower()[0] for c in text)
        self.tokens = {t.lower() for t in re.findall("[A-Za-z0-9_]+", text)}
        self.meaningful = {t for t in self.tokens if len(t) > 2 and t not in T.GENERIC_TOKENS}
        plain = "".join("x" if c > "\x7f" and unicodedata.category(c)[0] in "LMN" else c for c in text)
        self.negated = bool(re.search(T.NEGATION, plain, re.ASCII) or re.search(T.CJK_NEGATION, text))
        self.numbers = {m[0] for p in (T.NUMBER, T.DATE) for m in re.finditer(p, plain, re.ASCII)}
        self.scope = self.tokens & set(T.SCOPE_TERMS)


def relation(s, e):
    """(relation, detail, score, overlap, meaningful_overlap) of one pair, None without."""
    exact = e.norm in s.norm or s.norm in e.norm
    overlap = len(s.tokens & e.tokens) / len(s.tokens) if s.tokens else 0.0
    mean = len(s.meaningful & e.meaningful) / len(s.meaningful) if s.meaningful else 0.0
    if not exact and (overlap < 0.5 or mean < 0.4):
        return None
    negation, differ = s.negated != e.negated, lambda a, b: bool(a and b and a != b)
    hundredths = lambda x: math.floor(x * 100 + 0.5) / 100
    if exact and not negation and not differ(s.numbers, e.numbers):
        return "support", "strong_support", 0.95, 1.0, 1.0 if s.meaningful else 0.0
    if overlap >= 0.55 and mean >= 0.45 and negation:
        return "contradict", "contradiction", hundredths(min(0.95, 0.55 + overlap * 0.35)), overlap, mean
    if negation or differ(s.numbers, e.numbers) or differ(s.scope, e.scope) or (overlap >= 0.45 and mean < 0.35):
        return None
    if overlap >= 0.72 and mean >= 0.6:
        return "support", "strong_support", hundredths(min(0.9, 0.5 + overlap * 0.3)), overlap, mean
    if overlap >= 0.5 and mean >= 0.4:
        return "weak_support", "weak_support", hundredths(min(0.68, 0.35 + mean * 0.35)), overlap, mean
    return None


def plain(statements, docs):
    out, known = {}, {}
    said = lambda x: known.setdefault(x, Said(x))
    for doc, text in docs:
        for n, pair, excerpt in V.excerpts(text):
            for item, span, s in statements:
                if found := relation(said(s), said(excerpt)):
                    rank = (found[2], found[4], found[3], not pair, -n)
                    if (item, span, doc) not in out or rank > out[item, span, doc][0]:
                        out[item, span, doc] = (rank, (n, pair, excerpt, *found))
    return {k: v[1] for k, v in out.items()}


def texts(seed, n):
    rng = random.Random(seed)
    sentence = lambda: rng.choice((" ", " ", "  ", "\t")).join(rng.choice(PIECES) for _ in range(rng.randrange(1, 7)))
    made = ["".join(sentence() + rng.choice((".", ". ", "! ", "\n", "。", " \n ")) for _ in range(rng.randrange(0, 6))) for _ in range(n)]
    return [None, "", "...", " ..\n. ", "\n", *made]


def together(said, docs, most):
    held, met, out = V.Statements(said), None, []
    for doc, text in docs:
        met = met or V.Excerpts(held)
        met.add((doc,), text)
        if len(met.texts) >= most:
            out.append(met.best([pa.int64()]))
            met = None
    if met and met.texts:
        out.append(met.best([pa.int64()]))
    return out


@pytest.mark.parametrize("seed,cells,most", [(1, 1 << 19, 4096), (2, 1, 1), (3, 500, 40)])
def test_all_statements_at_once_are_the_plain_rule(monkeypatch, seed, cells, most):
    monkeypatch.setattr(V, "CELLS", cells)
    said = [(i, n, s) for i, t in enumerate(texts(seed, 25)) for n, pair, s in V.excerpts(t) if not pair and s]
    docs = list(enumerate(texts(seed + 100, 60)))
    rows = [tuple(r.values())[:11] for b in together(said, docs, most) for r in b.to_pylist()]
    got = {r[:3]: r[3:] for r in rows}
    want = plain(said, docs)
    assert len(rows) == len(got) and got == want and {v[3] for v in want.values()} == {"support", "weak_support", "contradict"} and any(v[1] for v in want.values())
    assert together([], docs, most) == []


def test_excerpts_meet_the_statements_in_few_steps(monkeypatch):
    """The rule was run pair by pair."""
    calls, relate = [], verify.relate
    monkeypatch.setattr(verify, "relate", lambda *x: calls.append(1) or relate(*x))
    said = [(i, 0, f"alpha beta gamma{i % 9} delta.") for i in range(50)]
    found = together(said, [(d, "alpha beta gamma1 delta. alpha gamma2 delta.") for d in range(40)], 4096)
    assert sum(b.num_rows for b in found) == 50 * 40 and len(calls) == 1


def test_candidates_need_no_join_with_documents(spark):
    """Their texts were shuffled to meet the sources."""
    from sparkloom.plans import evidence
    from tests.oracle import SF_DIR

    found = evidence.evidence_candidates(spark, SF_DIR)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source").collect()}
    assert all(sources[r["source_id"]] == r["domain"] for r in found.select("source_id", "domain").collect())
