"""Column functions over text: tokens, normal forms, hashes and the signals that verification compares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the matching rules.
GENERIC_TOKENS = "a an and are as be by can does for from has have how in is it its of on or that the this to what with work works".split()
SCOPE_TERMS = "all always any cannot can every may must never only requires should".split()
NEGATION = (
    r"(?i)\b(?:not|no|never|without|cannot|can't|did not|does not|doesn't|is not|isn't|was not|wasn't|were not|weren't|failed to|false|incorrect)\b"
)
CJK_NEGATION = "(不|未|没有|無|无|並非|并非)"
NUMBER = r"\b\d+(?:[.,]\d+)?%?\b"
DATE = r"\b(?:19|20)\d{2}(?:[-/]\d{1,2}(?:[-/]\d{1,2})?)?\b"
NO_IDENTITY = "[^0-9a-zA-Z\u4e00-\u9fff]+"
SENTENCE = r"[^\n.!?。！？]+(?:[.!?。！？]+)?"
#: Whether sentences() finds any: something besides blanks and ends, or a blank before an end.
HAS_SENTENCE = r"[^\n.!?。！？ ]| [.!?。！？]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def meaningful(token_array: Column) -> Column:
    generic = F.array(*map(F.lit, GENERIC_TOKENS))
    return F.filter(token_array, lambda t: (F.length(t) > 2) & ~F.array_contains(generic, t))


def overlap_ratio(statement: Column, excerpt: Column) -> Column:
    """Shared tokens by the statement's; 0 without any."""
    n = F.size(statement)
    return F.when(n > 0, F.size(F.array_intersect(statement, excerpt)) / n).otherwise(F.lit(0.0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def has_negation(text: Column) -> Column:
    return text.rlike(NEGATION) | text.rlike(CJK_NEGATION)


def numbers(text: Column) -> Column:
    """Distinct numbers and dates, sorted."""
    found = F.concat(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.regexp_extract_all(text, F.lit(DATE), F.lit(0)))
    return F.array_sort(F.array_distinct(found))


def differ(a: Column, b: Column) -> Column:
    """Both have something, but not the same."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def scope_terms(token_array: Column) -> Column:
    return F.array_sort(F.array_intersect(token_array, F.array(*map(F.lit, SCOPE_TERMS))))


def sentences(text: Column) -> Column:
    """Trimmed sentence-like stretches, in order, without empty ones."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), F.lit(1)), lambda s: F.trim(s))
    return F.filter(found, lambda s: s != "")


def excerpt_hash(text: Column) -> Column:
    return F.sha2(F.lower(squeeze(text)), 256)


def claim_identity(text: Column) -> Column:
    """What makes two statements the same: letters, digits and ideographs alone."""
    return F.regexp_replace(F.lower(text), NO_IDENTITY, "")


def candidate_id(*parts: Column) -> Column:
    return F.concat(F.lit("ec_"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24))


def information_density(text: Column) -> Column:
    """Unique share .42, length up to 90 tokens .38, prose .2, less .25 if a few tokens make up the text."""
    t = tokens(text)
    return density_of(text, F.size(t), F.size(F.array_distinct(t)))


def density_of(text: Column, n: Column, distinct: Column) -> Column:
    """The same of known numbers of tokens. As columns of a table they are counted once; an expression with tokens() in it is evaluated anew at each use."""
    unique = distinct / F.greatest(n, F.lit(1))
    prose = text.rlike(r"[.!?]") & (n >= 8)
    repeats = (n >= 20) & (unique < 0.3)
    score = unique * 0.42 + F.least(n / F.lit(90.0), F.lit(1.0)) * 0.38 + F.when(prose, 0.2).otherwise(0.0) - F.when(repeats, 0.25).otherwise(0.0)
    return F.when(n == 0, F.lit(0.0)).otherwise(clamp(score))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def fingerprint(text: Column) -> Column:
    """16 hex digits of the hash of the first 256 bytes."""
    return F.substring(F.sha2(F.substring(F.encode(text, "UTF-8"), 1, 256), 256), 1, 16)


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def plain_text(text: Column) -> Column:
    """Lines with single blanks, trimmed; any number of blank lines between them is one."""
    blanks = F.regexp_replace(line_feeds(text), r"[^\S\n]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(blanks, " *\n *", "\n"), "\n\n+", "\n\n"), r"^\s+|\s+$", "")


def structured_text(text: Column) -> Column:
    """Lines keep their indentation and lose what is blank at their ends; blank lines at either end go."""
    ends = F.regexp_replace(line_feeds(text), r"[^\S\n]+(\n|$)", "$1")
    return F.regexp_replace(ends, r"^\n+|\n+$", "")


def first_line_title(text: Column) -> Column:
    """The first line of a plain text, 200 characters at most, null without one."""
    return F.nullif(F.substring(F.regexp_extract(text, "^[^\n]*", 0), 1, 200), F.lit(""))
