"""How an excerpt relates to a statement, and how precise a citation is.

`Signals` of texts and `relate`, the rule over arrays of pairs, are used inside tasks where documents' excerpts meet all statements; the rest are column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# The thresholds and scores of relate() and citation_precision() are fixed values of the rules.
#: No relation but containment holds below this share of meaningful tokens.
LEAST_MEANINGFUL = 0.4
#: Nor below this share of all tokens.
LEAST_OVERLAP = 0.5
RELATIONS = (("support", "strong_support"), ("contradict", "contradiction"), ("weak_support", "weak_support"))
WORD = re.compile("[A-Za-z0-9_]+")
_GENERIC, SCOPE = frozenset(T.GENERIC_TOKENS), frozenset(T.SCOPE_TERMS)
_NEGATION, CJK_NEGATION = re.compile(T.NEGATION, re.ASCII), re.compile(T.CJK_NEGATION)
#: Each match of T.NEGATION has one of these tokens.
NEGATING = frozenset("not no never without cannot can doesn isn wasn weren failed false incorrect".split())
_NUMBER, _DATE = re.compile(T.NUMBER, re.ASCII), re.compile(T.DATE, re.ASCII)


class _Lower(dict):
    """Lower case character by character, whatever stands around it."""

    def __missing__(self, c: int) -> str:
        low = chr(c).lower()
        self[c] = low = low if len(low) == 1 else low[0]
        return low


class _Plain(dict):
    """Letters, marks and digits beyond ASCII as x, so that words of any script have ASCII's word boundaries."""

    def __missing__(self, c: int) -> str:
        self[c] = x = "x" if c > 127 and unicodedata.category(chr(c))[0] in "LMN" else chr(c)
        return x


_LOWER, _PLAIN = _Lower(), _Plain()


def normal(text: str) -> str:
    """Lower case. Only these two letters lower otherwise in a word than alone."""
    return text.translate(_LOWER) if "\u03a3" in text or "\u0130" in text else text.lower()


def tokens(text: str) -> set[str]:
    return {t.lower() for t in WORD.findall(text)}


class Signals:
    """What a squeezed text is compared by, each computed when it is asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def norm(self) -> str:
        return normal(self.text)

    @cached_property
    def tokens(self) -> set[str]:
        return tokens(self.text)

    @cached_property
    def meaningful(self) -> set[str]:
        return {t for t in self.tokens if len(t) > 2 and t not in _GENERIC}

    @cached_property
    def plain(self) -> str:
        return self.text if self.text.isascii() else self.text.translate(_PLAIN)

    @cached_property
    def negated(self) -> bool:
        return bool(_NEGATION.search(self.plain) or CJK_NEGATION.search(self.text))

    @cached_property
    def numbers(self) -> set[str]:
        """Numbers and dates."""
        return {m[0] for p in (_NUMBER, _DATE) for m in p.finditer(self.plain)}


def relate(exact, overlap, mean, meaningful, negation, numeric, scope):
    """(kind, score, overlap, meaningful_overlap) of pairs of an excerpt and a statement, as arrays; kind is a place in RELATIONS, -1 if the excerpt says nothing about the
    statement. exact: one text contains the other; then the statement counts as covered whole, also one without a token. meaningful: the statement has such
    tokens. negation: one of the two is negated. numeric, scope: both have numbers or scope terms, but not the same."""
    import numpy as np

    hundredths = lambda x: np.floor(x * 100 + 0.5) / 100
    whole = exact & ~negation & ~numeric
    cases = [
        whole, (overlap >= 0.55) & (mean >= 0.45) & negation, numeric | negation | scope | (overlap >= 0.45) & (mean < 0.35),
        (overlap >= 0.72) & (mean >= 0.6), (overlap >= LEAST_OVERLAP) & (mean >= LEAST_MEANINGFUL),
    ]
    kind = np.select(cases, [0, 1, -1, 0, 2], -1)
    score = np.select(cases, [0.95, hundredths(np.minimum(0.95, 0.55 + overlap * 0.35)), 0.0, hundredths(np.minimum(0.9, 0.5 + overlap * 0.3)), hundredths(np.minimum(0.68, 0.35 + mean * 0.35))], 0.0)
    return kind, score, np.where(whole, 1.0, overlap), np.where(whole, np.where(meaningful, 1.0, 0.0), mean)


def status(support: Column, weak: Column, contradict: Column) -> Column:
    return (
        F.when((support > 0) & (contradict == 0), "supported").when((contradict > 0) & ((support > 0) | (weak > 0)), "mixed")
        .when(contradict > 0, "contradicted").otherwise("unsupported")
    )


def citation_precision(excerpt: Column, whole: Column) -> Column:
    """sentence, short_span, coarse_span or chunk_fallback."""
    norm = T.squeeze(excerpt)
    ends = F.length(norm) - F.length(F.translate(norm, ".!?。！？", ""))
    like = norm.rlike("[.!?。！？]$") | (F.size(F.split(norm, " ")) <= 32)
    return (
        F.when((F.trim(whole) == F.trim(excerpt)) & (F.length(F.trim(whole)) > 360), "chunk_fallback")
        .when((F.length(norm) <= 520) & (ends >= 2), "short_span").when((F.length(norm) <= 360) & like, "sentence")
        .when(F.length(norm) <= 500, "short_span").otherwise("coarse_span")
    )
