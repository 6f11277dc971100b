"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

A rule names a host (which stands for its subdomains too) and the beginning of a path; the longest that fits decides.
URLs without a rule go to a model of spark.ml, trained on at most train_rows labelled URLs (by a hash of the URL):
lengths, depth, share of digits, entropy of the characters, parameter and hyphen counts, and two suffix statistics,
the smoothed rates of bad URLs by the host's last two labels and by its last one, kept for the `most_suffixes` commonest
of the labelled URLs. The rates a URL is trained with leave its own fold out, so they don't tell its label. Everything is JVM-side; URLs are never grouped by host, so a host with a third of all rows is no matter.

A fifth of the labelled URLs (by a hash) is held out from all of that. On it the threshold is chosen: the least score from which on at least `precision` of the
held-out URLs are bad, over least_blocked of them or more. If there is none, the labels don't tell such URLs apart and the model blocks nothing: a guess that is wrong more often than right helps nobody.
fit() returns the threshold with the held-out area under the curve.

Defined cases: a null URL or one without :// has an empty host and path and fits no rule, and is judged from its zero
lengths; with fewer than least_labelled labels, or labels of one class, every URL without a rule is allowed; repeated rows are judged
alike; own columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

#: Rows of the base rate that a suffix rate is smoothed with.
WEIGHT = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # (verdict, host, path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The deciding rule as host and path in one string and its verdict, both null if none fits. rules: a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text).cast("double")
    counts = F.transform(F.array_distinct(F.split(text, "(?!^)")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / n * F.log2(x / n)).otherwise(0.0))
    return F.when(n > 0, total).otherwise(0.0)


def suffixes(host: Column) -> tuple[Column, Column]:
    """The host's last two labels and its last one."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    count = lambda s, pattern: F.coalesce(F.regexp_count(s, F.lit(pattern)), F.lit(0)).cast("double")
    length = F.length(text).cast("double")
    return {
        "url_length": length,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"),
        "host_labels": count(host, r"\.") + 1.0,
        "digit_ratio": F.when(length > 0, count(text, "[0-9]") / length).otherwise(0.0),
        "host_digits": count(host, "[0-9]"),
        "entropy": _entropy(text),
        "host_entropy": _entropy(host),
        "parameters": count(text, "[?&][^?&#=]+="),
        "hyphens": count(host, "-"),
        "https": text.startswith("https").cast("double"),
    }


def _rates(labelled: DataFrame, key: Column, prior: float, most: int) -> dict[str, float]:
    rows = labelled.groupBy(key.alias("k")).agg(F.sum("bad").alias("p"), F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(most).collect()
    return {r["k"]: (r["p"] + WEIGHT * prior) / (r["n"] + WEIGHT) for r in rows}


def _other_folds(key: Column, prior: float) -> Column:
    """The rate of a suffix in the labelled rows of the other folds. Rows: train_rows at most."""
    of = lambda what, *own: F.sum(what).over(Window.partitionBy(key, *own))
    bad, n = (of(c) - of(c, "fold") for c in (F.col("bad"), F.lit(1.0)))
    return (bad + WEIGHT * prior) / (n + WEIGHT)


def _looked_up(key: Column, rates: dict[str, float], prior: float) -> Column:
    if not rates:
        return F.lit(prior)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair]), key), F.lit(prior))


@dataclass
class Filter:
    """score: of a URL's columns url, host and path, 0 to 1; block from threshold on (none: never). auc: on held_out rows, of which rate are bad."""

    score: Column | None = None
    threshold: float | None = None
    auc: float | None = None
    rate: float | None = None
    held_out: int = 0
    model: object = None
    columns: dict[str, Column] | None = None


def area(scores: list[float], bad: list[float]) -> float | None:
    """Under the curve: how often a bad URL scores above another, equal scores half."""
    s, y = np.array(scores), np.array(bad) > 0
    if y.all() or not y.any():
        return None
    _, place, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[place]
    p = int(y.sum())
    return float((rank[y].sum() - p * (p + 1) / 2) / (p * (len(y) - p)))


def cut_off(scores: list[float], bad: list[float], precision: float, least: int) -> float | None:
    """The least score from which on `precision` are bad, of `least` or more."""
    order = np.argsort(-np.array(scores), kind="stable")
    s, y = np.array(scores)[order], np.array(bad)[order]
    right = np.cumsum(y) / np.arange(1, len(y) + 1)
    whole = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)  # equal scores go together
    good = np.flatnonzero(whole & (right >= precision) & (np.arange(1, len(y) + 1) >= least))
    return float(s[good[-1]]) if len(good) else None


def fit(labelled: DataFrame, train_rows: int = 20_000, least_labelled: int = 40, most_suffixes: int = 200, trees: int = 20, depth: int = 3, precision: float = 0.5, least_blocked: int = 10) -> Filter:
    """labelled: url and bad (0 or 1)."""
    sample = labelled.where("bad is not null").select("url", F.col("bad").cast("double").alias("bad")).orderBy(F.xxhash64("url"), "url", "bad").limit(train_rows)
    known = sample.withColumns(dict(zip(("host", "path"), host_and_path(F.col("url"))))).withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(5)).cast("int"))
    known = materialize(known.coalesce(1), "url-labels")
    train, held = known.where("fold > 0"), known.where("fold = 0")
    n, bad = train.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    if n < least_labelled or not 0 < bad < n:
        return Filter()
    prior = bad / n
    keys = suffixes(F.col("host"))
    lexical = features(F.col("url"), F.col("host"), F.col("path"))
    own = lexical | {f"suffix_{i}": _looked_up(key, _rates(train, key, prior, most_suffixes), prior) for i, key in enumerate(keys)}
    out_of_fold = lexical | {f"suffix_{i}": _other_folds(key, prior) for i, key in enumerate(keys)}
    model = _fit(materialize(train.select("bad", *[c.alias(k) for k, c in out_of_fold.items()]).coalesce(2), "url-features"), list(own), trees, depth)
    score = _score(model, own)
    rows = held.select(score.alias("score"), "bad").collect()  # a fifth of train_rows
    scores, truth = [r["score"] for r in rows], [r["bad"] for r in rows]
    return Filter(score, cut_off(scores, truth, precision, least_blocked), area(scores, truth), sum(truth) / max(1, len(truth)), len(rows), model, own)


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """pages with host, path, rule and verdict. labelled: url and bad (0 or 1). options: see fit."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(url_col)
    host, path = host_and_path(url)
    found = pages.select(F.struct(*kept).alias("row"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, says = match_rules(F.col("host"), F.col("path"), rules)
    learned = fit(labelled, **options)
    block = F.lit(False) if learned.threshold is None else learned.score >= learned.threshold
    verdict = F.coalesce(says, F.when(block, "block").otherwise("allow"))
    return found.select("row.*", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _fit(train: DataFrame, names: list[str], trees: int, depth: int):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train)
    return GBTClassifier(labelCol="bad", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=10, seed=7).fit(vectors)


def _score(model, columns: dict[str, Column]) -> Column:
    """The fitted trees as CASE expressions, weighted and summed; probability 1 / (1 + exp(-2 margin))."""
    values = list(columns.values())

    def tree(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(node.prediction())
        split = node.split()
        return F.when(values[split.featureIndex()] <= split.threshold(), tree(node.leftChild())).otherwise(tree(node.rightChild()))

    margin = F.lit(0.0)
    for t, weight in zip(model.trees, model.treeWeights):
        margin = margin + tree(t._call_java("rootNode")) * weight
    return 1.0 / (1.0 + F.exp(-2.0 * margin))
