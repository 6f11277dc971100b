"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of tags and text runs. A run scores its number of words times a weight, which is positive for words where
content stands and negative for words where labelled pages have none; every tag costs something. One linear scan finds the
contiguous stretch with the highest sum, and the words in it that stand in a content place are the text. Words in an unwanted place inside
the article's own element (CONTAINERS) cost nothing: they are left out, and a short title before an advert or share bar isn't cut off by it.

Weights are learned from labelled pages: pages whose own markup names the article (one <article> element), about train_pages of
them by a hash. For each kind of element (its tag, and its tag with each class) the words under it are counted inside and
outside the article, and the log odds is the kind's weight. A run's weight is the lowest of the kinds it stands under, as one
menu or comment box is enough to disqualify it. Counts of words, summed by kind, are all that leaves the tasks. A kind that the labelled pages
have in LEAST_WORDS words goes by its learned weight alone; other kinds that name the unwanted parts of a page (PRIOR) have a weight of their own. What stands
around the content (body and wrappers, whatever their classes say) has no weight, in learning and in reading: see `around_content`.

Text: character references are decoded, white space inside a block becomes one blank, blocks are joined by one blank; tags that do not
break the line put nothing between their texts. Script, style, comments and markup never count. Time is linear in the page however deep its elements nest.

Defined cases: a null or empty page, and one without a word in a content place, gives an empty text; pages cut off anywhere are read to
their end; without labelled pages the prior weights alone decide; pages are read whole, one at a time.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A tag is `<` before a letter, `/`, `!` or `?`; any other `<` is text. Quoted values of attributes may hold `<` and `>`.
_REST = r"""(?>=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b{_REST}>.*?(?:</\1\s*>|\Z)|</?[a-z]{_REST}(?:>|\Z)|<[!?/][^<>]*(?:>|\Z)|[^<]+|<", re.S | re.I
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Elements without content, those inside a line, and those that an opening tag of the same kind closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i img kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Kinds that hold no content wherever they stand, by tag, and by word in a class, id or role.
PRIOR_TAGS = frozenset("nav footer aside form button select head title menu dialog fieldset".split())
PRIOR_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header login menu nav navbar navigation"
    " newsletter notice notices popup promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PRIOR_WEIGHT, PLAIN_WEIGHT, TAG_COST, LEAST_WORDS = -3.0, 1.0, 0.05, 20
#: What one run can take away at most: a short advert inside an article doesn't cut off what follows.
LEAST_SCORE = -8.0
#: The content's own elements.
CONTAINERS = frozenset(("article", "main"))
#: Kinds that say nothing by themselves: what holds them does. Links and lists are in menus and in articles.
NEUTRAL = INLINE | frozenset("html body div main section article ul ol li dl dt dd table thead tbody tr td th".split())


def kinds(tag: str, name: str) -> tuple[str, ...]:
    """The kinds of an element: its tag and tag.word for the words of its class, id and role."""
    words = {w for m in _CLASS.findall(tag) for w in "".join(m).lower().split()}
    return (name, *(f"{name}.{w}" for w in sorted(words)))


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(what, text or name, kinds): "open", "close" or "text"."""
    for m in _TOKEN.finditer(page):
        s = m[0]
        if s[0] != "<" or s == "<":
            yield "text", s, ()
        elif m[1] is None and (t := _TAG.match(s)):
            name = t[2].lower()
            yield ("close", name, ()) if t[1] else ("open", name, kinds(s, name))


class Stack(list):
    """The elements open at a place. Each entry is [name, kinds, and what the user of the stack keeps]; `at_push` makes that, `at_pop` gets the entry."""

    def __init__(self, at_push: Callable[[Stack, tuple[str, ...]], list], at_pop: Callable[[Stack, list], None] | None = None):
        super().__init__()
        self.at_push, self.at_pop, self.open = at_push, at_pop, Counter()

    def down_to(self, name: str) -> None:
        while True:
            entry = self.pop()
            self.open[entry[0]] -= 1
            if self.at_pop:
                self.at_pop(self, entry)
            if entry[0] == name:
                return

    def runs(self, page: str) -> Iterator[tuple[str, str]]:
        """The tokens of a page as (what, value), with the stack as it is at each."""
        for what, value, own in tokens(page):
            if what == "open":
                if value in SELF_CLOSING and any(e[0] == value for e in self[-3:]):
                    self.down_to(value)
                if value not in VOID:
                    self.append([value, own, *self.at_push(self, own)])
                    self.open[value] += 1
            elif what == "close" and self.open[value]:
                self.down_to(value)
            yield what, value
        if self.at_pop:
            while self:
                self.at_pop(self, self.pop())


@lru_cache(100_000)
def prior(kind: str) -> float | None:
    """Names count whole, or when each of their parts is a name of the list (cookie-banner, but not article-header)."""
    name, _, word = kind.partition(".")
    parts = [p for p in re.split(r"[^a-z0-9]+", word) if p]
    return PRIOR_WEIGHT if name in PRIOR_TAGS or parts and PRIOR_WORDS.issuperset(parts) else None


def around_content(page: str) -> frozenset[int]:
    """The elements (numbers of their opening tags) around the page's content, which are never unwanted whatever they are called: those around the first
    <main>, else around the first <article> that isn't named as unwanted. A page with neither has its content in the parent with the most words in paragraphs
    outside unwanted elements, or, if all are inside some (a form around the whole page), in that with the most words."""
    outside: list[int] = []  # by element: the one it stands in, -1 for none

    def at_push(stack: Stack, own: tuple[str, ...]) -> list:
        outside.append(stack[-1][2] if stack else -1)
        return [len(outside) - 1, (stack[-1][3] if stack else False) or any(prior(k) is not None for k in own)]

    stack = Stack(at_push)
    article, words = -1, Counter()
    for what, value in stack.runs(page):
        if what == "open" and value in CONTAINERS and stack:
            if value == "main":
                article = stack[-1][2]
                break
            if article < 0 and all(prior(k) is None for k in stack[-1][1]):
                article = stack[-1][2]
        elif what == "text" and article < 0 and (at := next((i for i in range(len(stack) - 1, max(0, len(stack) - 5), -1) if stack[i][0] == "p"), 0)):
            words[not stack[at - 1][3], stack[at - 1][2]] += len(value.split())
    if article < 0 and words:
        article = max(words, key=lambda k: (k[0], words[k], -k[1]))[1]
    around = set()
    while article >= 0:
        around.add(article)
        article = outside[article]
    return frozenset(around)


def count_kinds(page: str) -> Counter:
    """(kind, inside the article): words, of a page with one article. Words count for each element they stand in, those of the article for the elements in it.
    The article itself and what stands around it say nothing: they hold content and the rest."""
    out: Counter = Counter()

    def at_pop(stack: Stack, entry: list) -> None:
        name, own, inside, good, bad = entry
        if not inside:
            own = () if good or name == "article" else own
        for kind in own:
            if good:
                out[kind, True] += good
            if bad:
                out[kind, False] += bad
        if stack:
            stack[-1][3] += good
            stack[-1][4] += bad

    stack = Stack(lambda stack, own: [stack.open["article"] > 0, 0, 0], at_pop)
    for what, value in stack.runs(page):
        if what == "text" and stack and (n := len(value.split())):
            stack[-1][3 if stack.open["article"] else 4] += n
    return out


def learn(pages: DataFrame, train_pages: int = 2000, most_kinds: int = 2000, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights of kinds, from pages whose markup names one article."""
    share = train_pages / max(1, pages.count())
    html = F.col(html_col)
    chosen = pages.where((F.pmod(F.xxhash64(F.col(id_col), html), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))) & (F.regexp_count(html, F.lit("<article[ >]")) == 1))
    chosen = chosen.select(html.alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(count_kinds(page))
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "inside", "n"]
            )

    counts = chosen.select("html").mapInArrow(count, "kind string, inside boolean, n long")
    by_kind = counts.groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("bad"))
    rows = by_kind.where(F.col("good") + F.col("bad") >= LEAST_WORDS).orderBy((F.col("good") + F.col("bad")).desc(), "kind").limit(most_kinds).collect()
    out = {}
    for r in rows:
        if r["kind"] not in NEUTRAL:
            out[r["kind"]] = max(-5.0, min(3.0, math.log((r["good"] + 1) / (r["bad"] + 1))))
    return out


class Extractor:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[tuple[str, ...], float | None] = {}
        self.around: frozenset[int] = frozenset()
        self.number = 0

    def weight(self, own: tuple[str, ...]) -> float | None:
        """The lowest weight among an element's kinds, none if it has none."""
        if own not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            found = [w for k in own if (w := self.weights.get(k, prior(k))) is not None]
            self.known[own] = min(found, default=None)
        return self.known[own]

    def _push(self, stack: Stack, own: tuple[str, ...]) -> list:
        """The lowest weight of the elements down to this one (none if no kind has any), and whether the content's own element is open."""
        weight, (above, inside) = None if self.number in self.around else self.weight(own), stack[-1][2:] if stack else (None, False)
        self.number += 1
        lowest = above if weight is None else weight if above is None else min(weight, above)
        return [lowest, inside or own[0] in CONTAINERS]

    def text(self, page: str | None) -> str:
        best, best_at, total, start = 0.0, (0, 0), 0.0, 0
        self.around, self.number = around_content(page or ""), 0
        parts: list[tuple[str, bool]] = []  # text with its place's verdict; an empty text breaks the line
        stack = Stack(self._push)
        for what, value in stack.runs(page or ""):
            weight, inside = stack[-1][2:] if stack else (None, False)
            weight = PLAIN_WEIGHT if weight is None else weight
            if what != "text":
                score = -TAG_COST
                parts.append(("" if value in INLINE else "\n", False))
            else:
                score = max(LEAST_SCORE, weight * len(value.split()))
                parts.append((value, weight > 0))
            if inside and weight <= 0:
                score = 0.0
            if total <= 0:
                total, start = 0.0, len(parts) - 1
            total += score
            if total > best:
                best, best_at = total, (start, len(parts))
        inside = "".join(entities.unescape(s) if good else s if s == "\n" else "" for s, good in parts[slice(*best_at)])
        return " ".join(inside.split())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", **options) -> DataFrame:
    """pages without html, with text and n_chars."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    weights = learn(pages, id_col=id_col, html_col=html_col, **options)
    own = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    names = [*(f.name for f in own), "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extractor.text(h) for h in part.column(len(own)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    schema = StructType([*own, StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*[f.name for f in own], html_col).mapInArrow(run, schema)
