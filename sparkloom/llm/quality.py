"""Quality rules: text statistics in Spark expressions and a decision list learned from labels.

The list is grown by sequential covering. Each rule is a conjunction of thresholds on the statistics that
predicts bad quality: on the growing part of the labelled rows, the condition with the best FOIL gain is added
until no bad row is confused with a good one or no condition helps; on the other part, conditions are taken off
the end while that raises (bad - good) / (bad + good). Rows that a rule covers leave, and the next rule is learned
from what remains. A rule that is not precise enough on the pruning part ends the list. Candidates are quantiles
of the labelled rows; every step is one grouped count over them, and only counts by feature and bin reach the driver.

The verdict is an ordered CASE expression: the first rule that holds drops the document, none keeps it.

Fitting reads at most train_rows labelled documents, chosen by a hash of the id; statistics cover every document.

Defined cases: a null text is an empty one, with no words, so it fails the base rule (under 50 words). Without
labels, or with labels of one class, the list is empty and keeps what passes the base rule. Repeated rows are judged alike. Own columns of
the names of the statistics are replaced; all others stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, words

#: As insides of a character class.
SYMBOLS, UPPER, DIGITS, EXCLAIMS = r"#*$%&|<>", "A-Z", "0-9", "!"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_exclaims")


def _count_chars(text: Column, inside: str) -> Column:
    """Characters of the class; what lies between them goes run by run."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", "")).cast("long")


def repeat_words(w: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more.

    Windows are hashes of three word hashes (64 bits) with their positions, sorted; equal neighbours repeat.
    A window covers three words, but at most the distance to the next repeated window's start.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    threes = _beside(hashes, lambda h: {"a": h, "b": F.slice(h, 2, F.size(h)), "c": F.slice(h, 3, F.size(h))})
    windows = F.filter(F.transform(threes, lambda x: F.when(x["c"].isNotNull(), F.xxhash64(x["a"], x["b"], x["c"]))), lambda x: x.isNotNull())
    # Most texts repeat no window, which a hash set tells; only the others are sorted.
    return F.transform(F.array(windows), lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(_covered(v)))[0].cast("long")


def _covered(windows: Column) -> Column:
    none = F.lit(None).cast("struct<h:bigint,at:int>")
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    ranked = _beside(placed, lambda s: {"own": s, "next": F.slice(s, 2, F.size(s)), "last": F.concat(F.array(none), s)})
    same = lambda x, side: F.coalesce(x["own"]["h"] == x[side]["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(ranked, lambda x: same(x, "next") | same(x, "last")), lambda x: x["own"]["at"]))
    gaps = _beside(starts, lambda p: {"own": p, "next": F.slice(p, 2, F.size(p))})
    return F.aggregate(gaps, F.lit(0), lambda n, x: n + F.least(F.lit(3), F.coalesce(x["next"] - x["own"], F.lit(3))))


def _beside(values: Column, views: Callable[[Column], dict[str, Column]]) -> Column:
    """Arrays derived from one array, zipped; the lambda has it evaluated once."""
    return F.transform(F.array(values), lambda v: F.arrays_zip(*[c.alias(name) for name, c in views(v).items()]))[0]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts in BASE and EXTRA (all long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keep = [c for c in docs.columns if c not in (*BASE, *EXTRA)]
    split = docs.select(*keep, text.alias("_quality_text"), words(F.col(text_col).cast("string")).alias("_quality_words"), lines.alias("_quality_lines"))
    t, w, at = F.col("_quality_text"), F.col("_quality_words"), F.col("_quality_lines")
    return split.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count_chars(t, SYMBOLS).alias("n_symbols"),
        (F.size(at) - F.size(F.array_distinct(at))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        F.size(at).cast("long").alias("n_lines"),
        _count_chars(t, UPPER).alias("n_upper"),
        _count_chars(t, DIGITS).alias("n_digits"),
        _count_chars(t, EXCLAIMS).alias("n_exclaims"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may test, as doubles: sizes and shares of the words, characters and lines."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_a_word": share("word_chars", "n_words"),
        "symbols_a_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "exclaims_a_word": share("n_exclaims", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
    }


Rule = list[tuple[str, str, float]]  # conditions (feature, ">" or "<=", threshold)


def rule_column(rule: Rule, values: dict[str, Column]) -> Column:
    held = F.lit(True)
    for name, op, cut in rule:
        held = held & (values[name] > cut if op == ">" else values[name] <= cut)
    return held


def verdict(rules: list[Rule], values: dict[str, Column] | None = None) -> Column:
    """False at the first rule that holds, true if none does."""
    values, rest = values or features(), F.lit(True)
    for rule in reversed(rules):
        rest = F.when(rule_column(rule, values), F.lit(False)).otherwise(rest)
    return rest


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of the cuts the value is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(name) > c))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL gain of narrowing p0 bad and n0 good rows to p and n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 else -1.0


def learn(labelled: DataFrame, label_col: str, max_rules: int = 8, max_conditions: int = 4, bins: int = 32, least_precision: float = 0.75,
          least_covered: int = 3) -> list[Rule]:
    """Rules for label_col == 0 (bad) against 1. labelled: statistics, _quality_grow (boolean) and the label."""
    values = features()
    names = list(values)
    shares = [i / bins for i in range(1, bins)]
    flat = labelled.select((F.col(label_col) == 0).cast("int").alias("bad"), "_quality_grow", *[values[n].alias(n) for n in names]).where("bad is not null")
    spread = flat.agg(*[F.percentile_approx(F.when(F.col("bad") == b, F.col(n)), shares, 10_000).alias(f"{n}_{b}") for n in names for b in (0, 1)]).first()
    cuts = {n: sorted({float(x) for b in (0, 1) for x in (spread[f"{n}_{b}"] or [])}) for n in names}

    columns = {n: F.col(n) for n in names}
    rules: list[Rule] = []
    for _ in range(max_rules):
        left = flat
        for rule in rules:
            left = left.where(~rule_column(rule, columns))
        rule: Rule = []
        while len(rule) < max_conditions:
            at = left.where("_quality_grow").where(rule_column(rule, columns))
            binned = [F.struct(F.lit(n).alias("f"), _bin(n, cuts[n]).alias("b")) for n in names if cuts[n]]
            if not binned:
                return rules
            counts: dict[str, dict[int, tuple[int, int]]] = {}
            for r in at.select("bad", F.explode(F.array(*binned)).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect():
                counts.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
            if not counts:
                break
            one = next(iter(counts.values())).values()
            p0, n0 = sum(x[0] for x in one), sum(x[1] for x in one)
            if p0 == 0 or n0 == 0:
                break
            best = (0.0, "", "", 0.0)
            for name in names:
                p = n = 0
                for b in range(len(cuts[name])):  # bin b: above cuts[:b], so bins up to b are <= cuts[b]
                    x = counts.get(name, {}).get(b, (0, 0))
                    p, n = p + x[0], n + x[1]
                    best = max(best, (_gain(p, n, p0, n0), name, "<=", cuts[name][b]), (_gain(p0 - p, n0 - n, p0, n0), name, ">", cuts[name][b]))
            if best[0] <= 1e-9:
                break
            rule.append(best[1:])
        if not rule:
            break
        heads = [rule_column(rule[: k + 1], columns) for k in range(len(rule))]
        sums = lambda part: part.agg(*[F.sum(F.when(h, F.col("bad") if y else 1 - F.col("bad")).otherwise(0)).alias(f"{'np'[y]}{k}") for k, h in enumerate(heads) for y in (0, 1)]).first()
        held, grown = sums(left.where("not _quality_grow")), sums(left.where("_quality_grow"))
        value = lambda k: ((held[f"p{k}"] or 0) - (held[f"n{k}"] or 0)) / ((held[f"p{k}"] or 0) + (held[f"n{k}"] or 0) or 1)
        k = max(range(len(rule)), key=lambda k: (value(k), -k))
        p = (held[f"p{k}"] or 0) + (grown[f"p{k}"] or 0)
        n = (held[f"n{k}"] or 0) + (grown[f"n{k}"] or 0)
        if p < least_covered or p / (p + n) < least_precision or (held[f"p{k}"] or 0) < (held[f"n{k}"] or 0):
            break
        rules.append(rule[: k + 1])
    return rules


def sample_labels(labels: DataFrame, train_rows: int, id_col: str) -> DataFrame:
    """At most train_rows labels, in the order of a hash of their id."""
    return labels.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(train_rows)


def judge(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the statistics, base_failed and kept."""
    chosen = materialize(sample_labels(labels, train_rows, id_col).select(F.col(id_col).alias("_quality_id"), F.col(label_col).alias("_quality_label")).coalesce(1), "quality-labels")
    known = docs.select(F.col(id_col).alias("_quality_id"), F.col(text_col)).join(chosen, "_quality_id")
    grow = F.pmod(F.xxhash64(F.col("_quality_id"), F.lit("grow")), F.lit(3)) != 0
    labelled = statistics(known, text_col).drop(text_col).withColumn("_quality_grow", grow)
    # Written first, filtered then: as one plan, the filter and its statistics would move below the join, to all documents.
    rules = learn(materialize(labelled, "quality-labelled").where(~base_failed()), "_quality_label")
    out = statistics(docs.drop("base_failed", "kept"), text_col)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
