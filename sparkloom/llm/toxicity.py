"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed. The insult transducer reads words and has an arc for each word of the learned words, word beginnings and phrases; where one ends
it writes an insult with its weight. The threat transducer turns a verb of harm into a threat where somebody is addressed or a future is announced
shortly before. The target, negation and reported-speech transducers mark insults and threats that follow an addressed person or a negation within a few words, or
a reporting word in their clause. Arcs of the composition are made when they are first met. A second machine, run from a clause's end to its beginning, marks what an addressed person
follows ("we will hurt them").

What is scored are clauses, not words: each clause (up to a full stop, colon, semicolon or line feed) with an insult or threat counts once, with its strongest match, by the pattern that the grammar found for it:
plain, aimed, negated or reported. A threat that is not aimed at anybody counts for nothing, nor does a clause whose matches are all negated or reported unless labels say otherwise. A logistic
model turns the sums of clause weights by pattern into a score. It is fitted on labelled documents and starts from PRIOR, so a pattern that no label speaks of keeps its prior weight.

The insults are learned: of at most train_rows labelled documents (by a hash of the id, held-out ones never), equal texts
counted once, the share of toxic and other documents with each word or word beginning gives its log odds; a word and its beginnings in the same documents are one entry. The lexicon is
bounded by lexicon_size and is the only thing that goes to the executors; the driver holds 3 * lexicon_size terms with the toxic ones of train_rows documents at most.

Defined cases: null and empty texts have no matches and get the model's base score; without toxic labels no insult is known and
scores follow the threats and the base rate; repeated rows score alike; texts are read whole; own columns named score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

# Fixed word classes in English, German, French and Spanish.
HARM_WORDS = "kill hurt burn destroy attack punish shoot stab beat strangle töten schlagen vernichten verletzen erschießen tuer frapper brûler détruire matar golpear quemar destruir"
FUTURE_WORDS = "will gonna going shall must should deserve deserves ll werde werden wird sollte sollten vais allons va doit devrait voy vamos va debe debería"
TARGET_WORDS = "you your yours he she him her they them their du dich dir euch ihr ihnen sie tu toi te vous vos votre ils elles tú te usted ustedes ellos ellas vosotros"
NEGATION_WORDS = "not no never none neither nor without cannot nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin"
REPORTED_WORDS = "said says told called claimed wrote quoted according sagte sagt laut nannte schrieb dit disait selon appelé écrit dijo dice según llamó escribió"

INSULT, HARM, AIM, NOT, SAID, END, OTHER, FUTURE, THREAT = range(9)
#: What the composed machine emits for an insult or threat: MARKED + pattern, for threats 4 more.
PATTERNS = ("plain", "aimed", "negated", "reported")
PLAIN, AIMED, NEGATED, QUOTED = range(4)
MARKED = 10
NEGATION_REACH, TARGET_REACH, THREAT_REACH = 3, 4, 4
PREFIXES = (8, 7, 6, 5, 4)
#: Of plain, aimed, negated and reported insults, aimed threats, and the strongest clause that is neither negated nor reported.
PRIOR = (1.0, 1.5, 0.0, 0.0, 1.5, 0.5)
#: Words that a task remembers.
KNOWN_WORDS = 100_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")

State = tuple | int


def _mark(symbol: int, pattern: int) -> int:
    """The symbol in this pattern, unless a stronger one is on it already."""
    base, now = (symbol, PLAIN) if symbol < MARKED else ((INSULT, THREAT)[(symbol - MARKED) // 4], (symbol - MARKED) % 4)
    return MARKED + 4 * (base == THREAT) + max(now, pattern)


def _hot(symbol: int) -> bool:
    return symbol in (INSULT, THREAT) or symbol >= MARKED


class Machine:
    """A transducer: step gives for a state and a symbol the next state and the symbol written. State 0 starts."""

    start: State = 0

    def step(self, state: State, symbol: int) -> tuple[State, int]:
        raise NotImplementedError


class Within(Machine):
    """Marks what follows one of `after` within reach words (0: anywhere) of the same clause. The state is the number of words left."""

    def __init__(self, after: tuple[int, ...], pattern: int, reach: int):
        self.after, self.pattern, self.reach = after, pattern, reach

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        to = (self.reach or 1) if symbol in self.after else 0 if symbol == END else max(0, state - (self.reach > 0))
        return to, _mark(symbol, self.pattern if state else PLAIN) if _hot(symbol) else symbol


class Threats(Machine):
    """A verb of harm is a threat: aimed where a person or a future stands shortly before, else plain."""

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        to = THREAT_REACH if symbol in (AIM, FUTURE) else 0 if symbol == END else max(0, state - 1)
        return to, (_mark(THREAT, AIMED if state else PLAIN) if symbol == HARM else symbol)


class Composed(Machine):
    """Runs first and feeds what it writes to second; arcs are made when they are first met."""

    def __init__(self, first: Machine, second: Machine):
        self.first, self.second = first, second
        self.start = (first.start, second.start)
        self.arcs: dict[tuple, tuple] = {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            a, between = self.first.step(state[0], symbol)
            b, out = self.second.step(state[1], between)
            arc = self.arcs[state, symbol] = ((a, b), out)
        return arc


def grammar() -> tuple[Machine, Machine]:
    """The machine for what stands before a match, and the one that is run backwards over a clause for what stands behind it."""
    forward: Machine = Threats()
    for after, pattern, reach in (((AIM,), AIMED, TARGET_REACH), ((NOT,), NEGATED, NEGATION_REACH), ((SAID,), QUOTED, 0)):
        forward = Composed(forward, Within(after, pattern, reach))
    return forward, Within((AIM,), AIMED, TARGET_REACH)


class Insults:
    """The insult transducer: reads words, writes symbols and weights. Phrases of several words are paths; a phrase's weight stands at its last word."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {w: x for w, x in lexicon.items() if " " not in w}
        self.phrases = {tuple(w.split()): x for w, x in lexicon.items() if " " in w}
        self.longest = max(map(len, self.phrases), default=1)
        self.inside = {w for p in self.phrases for w in p}
        classes = ((HARM, HARM_WORDS), (FUTURE, FUTURE_WORDS), (AIM, TARGET_WORDS), (NOT, NEGATION_WORDS), (SAID, REPORTED_WORDS))
        self.fixed = {w: s for s, text in classes for w in text.split()} | dict.fromkeys(".!?;:\n", END)
        self.marks = {s: (s, 1.0) for s in {OTHER, *self.fixed.values()}}
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, w: str) -> tuple[int, float]:
        found = self.known.get(w)
        if found is None:
            weight = self.words.get(w, 0.0)
            for n in PREFIXES:
                if not weight and len(w) > n:
                    weight = self.words.get(w[:n] + "*", 0.0)
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            found = self.known[w] = (INSULT, weight) if weight else self.marks[self.fixed.get(w, OTHER)]
        return found

    def read(self, words: list[str]) -> list[tuple[int, float]]:
        out = [self.word(w) for w in words]
        if self.phrases:
            for i, w in enumerate(words):
                if w in self.inside:
                    for n in range(2, min(self.longest, i + 1) + 1):
                        weight = self.phrases.get(tuple(words[i - n + 1 : i + 1]))
                        if weight:
                            out[i] = (INSULT, max(weight, out[i][1] if out[i][0] == INSULT else 0.0))
        return out


class Scorer:
    """Sums of clause weights by pattern, for texts."""

    def __init__(self, lexicon: dict[str, float]):
        self.insults = Insults(lexicon)
        self.forward, self.backward = grammar()

    def clauses(self, text: str) -> Iterator[list[tuple[int, float]]]:
        """Of each clause with a match its (emitted symbol, weight)."""
        tokens = self.insults.read(_TOKEN.findall(text.lower()))
        hot = [i for i, (s, _) in enumerate(tokens) if s <= HARM]
        done = -1
        for i in hot:  # clauses without a match need no run
            if i <= done:
                continue
            begin = i
            while begin and tokens[begin - 1][0] != END:
                begin -= 1
            end = i
            while end < len(tokens) and tokens[end][0] != END:
                end += 1
            done = end
            state, marks = self.forward.start, []
            for s, _ in tokens[begin:end]:
                state, mark = self.forward.step(state, s)
                marks.append(mark)
            back, state = list(marks), self.backward.start
            for k in range(len(marks) - 1, -1, -1):
                state, back[k] = self.backward.step(state, marks[k])
            yield [(m, w) for m, (_, w) in zip(back, tokens[begin:end]) if m >= MARKED]

    def sums(self, text: str | None) -> list[float]:
        """Logarithms of: by pattern the weights of the clauses' strongest insults, the clauses with an aimed threat, and the strongest plain or aimed clause."""
        out = [0.0] * 6
        for clause in self.clauses(text or ""):
            strongest = [0.0] * 4
            for mark, weight in clause:
                if mark < MARKED + 4:
                    strongest[mark - MARKED] = max(strongest[mark - MARKED], weight)
            for p in range(4):
                out[p] += strongest[p]
            out[4] += any(mark == MARKED + 4 + AIMED for mark, _ in clause)
            out[5] = max(out[5], strongest[PLAIN], strongest[AIMED])
        return [math.log1p(x) for x in out]


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def learn_lexicon(labelled: DataFrame, lexicon_size: int = 500, least_documents: int = 3, least_weight: float = 2.0) -> dict[str, float]:
    """Words, and word beginnings with a star, by log odds of toxic documents. labelled: text, toxic (0 or 1)."""
    texts = labelled.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    starts = F.transform(found, lambda w: F.array(w, *[F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]))
    terms = texts.select("h", F.col("toxic").cast("long").alias("toxic"), F.explode(F.array_distinct(F.array_compact(F.flatten(starts)))).alias("term"))
    total = texts.agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).first()
    bad, good = int(total["bad"] or 0), int(total["all"] or 0) - int(total["bad"] or 0)
    if not bad or not good:
        return {}
    weight = F.log((F.col("p") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (good + 1))
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).where(F.col("p") >= least_documents)
    best = counted.withColumn("w", weight).where(F.col("w") >= least_weight).orderBy((F.col("w") * F.col("p")).desc(), "term").limit(3 * lexicon_size)
    best = materialize(best.coalesce(1), "toxicity-terms")
    where = terms.where("toxic = 1").join(best, "term").groupBy("term", "w", "p").agg(F.collect_set("h").alias("docs")).collect()  # train_rows by 3 * lexicon_size at most
    return _cover({r["term"]: (float(r["w"]), r["docs"]) for r in where}, lexicon_size, least_documents)


def _cover(terms: dict[str, tuple[float, list[int]]], size: int, least: int, enough: int = 3, refine: float = 1.0) -> dict[str, float]:
    """Terms in descending order of weight times documents, as long as they add something: a term must stand in
    documents of which at least `least` have fewer than `enough` chosen terms so far. Words that only come along in
    copies of the same toxic document are explained by then and stay out. A term of the same beginning as others must be in `least` documents that
    these aren't in, or be a longer one that says more by `refine`: a word and its beginnings in the same documents are one entry."""
    hits: dict[int, set[str]] = {}
    out: dict[str, float] = {}
    families: dict[str, set[int]] = {}
    for term in sorted(terms, key=lambda t: (-terms[t][0] * len(terms[t][1]), -len(t), t)):
        weight, docs = terms[term]
        family = term.rstrip("*")[: PREFIXES[-1]]
        covered = families.setdefault(family, set())
        upper = [out[u] for n in PREFIXES if (u := term.rstrip("*")[:n] + "*") in out and u != term]
        if len(out) >= size or sum(len(hits.get(d, ())) < enough for d in docs) < least:
            continue
        if len(covered.union(docs)) - len(covered) >= least or (upper and weight >= max(upper) + refine):
            out[term] = weight
            covered.update(docs)
            for d in docs:
                hits.setdefault(d, set()).add(family)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, l2: float = 0.05, steps: int = 100) -> np.ndarray:
    """Coefficients, intercept last, by Newton's method with halved steps; the penalty draws them to prior."""
    x = np.column_stack([x, np.ones(len(x))])
    middle, penalty = np.array([*prior, 0.0]), np.array([l2] * len(prior) + [1e-4])
    loss = lambda c: np.logaddexp(0, x @ c).sum() - y @ (x @ c) + (penalty * (c - middle) ** 2).sum() / 2
    b = middle.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * (b - middle))
        while np.abs(step).max() >= 1e-8 and loss(b + step) > loss(b):
            step /= 2
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and coefficients, from labels that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(train_rows)
    known = materialize(known.select(F.col(id_col).alias("_tox_id"), F.col(label_col).cast("int").alias("toxic")).coalesce(1), "toxicity-labels")
    texts = docs.select(F.col(id_col).alias("_tox_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(known, "_tox_id").select("text", "toxic")
    labelled = materialize(texts, "toxicity-texts")
    lexicon = learn_lexicon(labelled)
    rows = score_columns(labelled, "text", lexicon, None).select("toxic", "sums").collect()  # train_rows at most
    if not rows or len({r["toxic"] for r in rows}) < 2:
        rate = (sum(r["toxic"] for r in rows) + 0.5) / (len(rows) + 1)
        return lexicon, np.array([*PRIOR, math.log(rate / (1 - rate))])
    return lexicon, fit_logistic(np.array([r["sums"] for r in rows]), np.array([r["toxic"] for r in rows], float))


def score_columns(docs: DataFrame, text_col: str, lexicon: dict[str, float], coefficients: np.ndarray | None) -> DataFrame:
    """docs with sums (array of double) and score."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    own = [f for f in docs.schema.fields if f.name not in ("sums", "score")]
    at = [f.name for f in own].index(text_col)
    names = [*(f.name for f in own), "sums", "score"]
    b = [0.0] * 7 if coefficients is None else [float(c) for c in coefficients]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                sums = [scorer.sums(t) for t in part.column(at).to_pylist()]
                scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, b[6] + sum(x * c for x, c in zip(s, b)))))) for s in sums]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums, pa.list_(pa.float64())), pa.array(scores, pa.float64())], names=names)

    schema = StructType([*own, StructField("sums", ArrayType(DoubleType())), StructField("score", DoubleType())])
    return docs.select(*[f.name for f in own]).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", read: DataFrame | None = None, **options) -> DataFrame:
    """docs with score and predicted. read: the documents to learn from, docs itself if none."""
    lexicon, coefficients = fit(docs if read is None else read, labels, id_col=id_col, text_col=text_col, **options)
    scored = score_columns(docs.drop("predicted"), text_col, lexicon, coefficients).drop("sums")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
