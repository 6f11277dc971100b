"""Main content of web pages, redirect stubs, cleaned texts and their segments.

A page's tags are read once, with a stack that says of each open element whether it is left out (navigation, forms and the like, by tag, role, class
or id; everything inside goes with it) and whether it is the content's own (article, main, or an id or class that says so). Text goes to the page's text and, inside
content elements, to the main text too; block elements break lines. The main text counts from LEAST_MAIN characters on; else the page's text stands in.
Wiki pages fall back to their readable paragraphs where these say more, and pages without any text to their title. Python only reads tags, a page at a
time in Arrow batches; what is chosen, cleaned and recognised afterwards is column expressions.

As in lenient readers, an end tag closes the innermost open element whatever its name, and one without an open element does nothing. Defined cases: a null or empty page
has an empty text and no title; pages cut off anywhere are read to their end; other columns stay, those named as the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Fixed values of the extraction rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("article blockquote br dd div dt footer h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table td th tr ul".split())
LEFT_OUT_TAGS = frozenset("aside button footer form header nav noscript script style svg".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search".split())
LEFT_OUT_CLASSES = frozenset("menu mw-editsection mw-jump-link navbox reference references reflist sidebar toc".split())
LEFT_OUT_MARKS = "ambox catlinks cookie footer hatnote mw-editsection mw-jump-link mw-references navbox navigation reflist sidebar vector-header".split()
MAIN_TAGS, MAIN_IDS, MAIN_CLASSES = frozenset(("article", "main")), frozenset(("bodycontent", "content", "main", "mw-content-text")), frozenset(("mw-body", "mw-parser-output"))
UNREADABLE = ("jump to content", "main menu", "move to sidebar", "privacy policy", "about wikipedia", "retrieved from", "hidden categories")
REDIRECT_MARKS = ("redirecting to ", "you are being redirected", "moved permanently", "click here if you are not redirected")
BROKEN_LINKS = ((r"\s+from\s+up\s+to\s+\d+\s+\.", "from up to <number> ."), (r"\s+listed\s+at\s+\.", "listed at ."), (r"\s+see\s+\.", "see ."), (r"\s+at\s+\.", "at ."))
LEAST_MAIN, LEAST_PARAGRAPH, LEAST_WIKI, MOST_STUB = 40, 40, 120, 500
#: What a wiki page's paragraphs may stand in, in this order.
WIKI = (("wikipedia_mw_parser_output_paragraphs", "class", "mw-parser-output"), ("wikipedia_mw_content_text_paragraphs", "id", "mw-content-text"), ("body_readable_paragraphs", "tag", "body"))


def one_line(text: str) -> str:
    return " ".join(text.split())


def plain_lines(text: str) -> str:
    """Lines with single blanks; any number of empty lines between two is one."""
    lines = [one_line(s) for s in re.split("\r\n|\r|\n", text)]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def left_out(tag: str, attrs: dict[str, str]) -> bool:
    if tag in LEFT_OUT_TAGS or attrs.get("role", "") in LEFT_OUT_ROLES or LEFT_OUT_CLASSES.intersection(attrs.get("class", "").split()):
        return True
    if attrs.get("id", "") == "toc" or attrs.get("id", "").startswith("toc-"):
        return True
    names = " ".join(v for k, v in attrs.items() if k in ("id", "class", "aria-label"))
    return any(m in names for m in LEFT_OUT_MARKS)


def is_main(tag: str, attrs: dict[str, str]) -> bool:
    own = attrs.get("id", "")
    return tag in MAIN_TAGS or attrs.get("role") == "main" or own in MAIN_IDS or own.replace("-", "") in MAIN_IDS or bool(MAIN_CLASSES.intersection(attrs.get("class", "").split()))


class Page(HTMLParser):
    """What one reading of a page finds."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[bool, bool, tuple[bool, ...]]] = []  # left out, content, and which of WIKI it starts
        self.whole: list[str] = []
        self.main: list[str] = []
        self.title: list[str] = []
        self.in_title, self.links, self.boxes, self.anchors, self.anchor = False, 0, 0, 0, ""
        self.n_main, self.n_wiki = 0, [0] * len(WIKI)
        self.paragraph: tuple[int, list[str]] | None = None
        self.paragraphs: list[list[str]] = [[] for _ in WIKI]
        self.feed(html)
        self.close()

    def put(self, text: str) -> None:
        self.whole.append(text)
        if self.n_main:
            self.main.append(text)

    def handle_starttag(self, tag, attrs):
        given = {k.lower(): (v or "").strip().lower() for k, v in attrs}
        hidden = bool(self.open) and self.open[-1][0]
        if tag in VOID:
            if tag in BLOCKS and not hidden:
                self.put("\n")
            return
        gone = left_out(tag, given)
        if hidden or gone:
            self.boxes += not hidden
            self.open.append((True, False, ()))
            return
        if tag == "title":
            self.in_title = True
        if tag == "a":
            self.anchor = "" if not self.anchors else self.anchor
            self.anchors += 1
        content = is_main(tag, given)
        self.n_main += content
        starts = tuple(tag == name if kind == "tag" else name == given.get("id") if kind == "id" else name in given.get("class", "").split() for _, kind, name in WIKI)
        self.n_wiki = [n + s for n, s in zip(self.n_wiki, starts, strict=True)]
        self.open.append((False, content, starts))
        if tag == "p" and any(self.n_wiki):
            self.paragraph = (len(self.open), [])
        if tag in BLOCKS:
            self.put("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0]:
            self.open.pop()
            return
        if tag == "title":
            self.in_title = False
        if tag == "a" and self.anchors:
            self.anchors -= 1
            self.links += not self.anchors and bool(self.anchor.strip())
        if tag == "p" and self.paragraph and self.paragraph[0] == len(self.open):
            text = one_line("".join(self.paragraph[1]))
            if len(text) >= LEAST_PARAGRAPH and not any(m in text.lower() for m in UNREADABLE) and re.search("[.!?。！？]", text):
                for kept, n in zip(self.paragraphs, self.n_wiki, strict=True):
                    if n:
                        kept.append(text)
            self.paragraph = None
        if tag in BLOCKS:
            self.put("\n")
        if self.open:
            _, content, starts = self.open.pop()
            self.n_main -= content
            self.n_wiki = [n - s for n, s in zip(self.n_wiki, starts, strict=True)]

    def handle_data(self, data):
        if self.open and self.open[-1][0]:
            return
        if self.paragraph:
            self.paragraph[1].append(data)
        if self.in_title:
            self.title.append(data)
            return
        if self.anchors:
            self.anchor += data
        self.put(data)


READ = StructType([
    StructField("_title", StringType()), StructField("_whole", StringType()), StructField("_main", StringType()), StructField("_wiki", ArrayType(StringType())),
    StructField("removed_boilerplate", LongType()), StructField("link_texts", LongType()),
])
RESULTS = ("title", "text", "strategy", "fallback_used", "removed_boilerplate", "link_texts", "dropped_fragments", "reason", "followup_url")


def _read(pages: DataFrame, html_col: str) -> DataFrame:
    own = pages.schema.fields
    at = [f.name for f in own].index(html_col)
    schema = StructType([*own, *READ.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64())
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, rows = batch.slice(begin, 256), []
                for html in part.column(at).to_pylist():
                    p = Page(html or "")
                    wiki = ["\n\n".join(x) for x in p.paragraphs]
                    rows.append((one_line("".join(p.title)), plain_lines("".join(p.whole)), plain_lines("".join(p.main)), wiki, p.boxes, p.links))
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return pages.mapInArrow(run, schema)


def broken_links(text: Column) -> tuple[Column, Column]:
    """The text without what is left of removed links, and the labels of what went."""
    labels = []
    for pattern, label in BROKEN_LINKS:
        found = text.rlike(f"(?iU){pattern}")
        labels.append(F.when(found, F.lit(label)))
        text = F.regexp_replace(text, f"(?iU){pattern}", ".")
    return text, F.array_compact(F.array(*labels))


def redirect_target(text: Column, html: Column) -> Column:
    """The first absolute address that a text names, else that the page's refresh or first link does."""
    address = r"(?i)(https?://[^\s<>'\")]+)"
    refresh = r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+content=["'][^"']*url=([^"'>]+)"""
    link = r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>"""
    clean = lambda x: F.rtrim(F.regexp_replace(F.trim(F.replace(x, F.lit("&amp;"), F.lit("&"))), "[.,;]+$", ""))
    absolute = lambda x: F.when(clean(x).rlike("^https?://"), clean(x))
    return F.coalesce(*[absolute(F.regexp_extract(where, pattern, 1)) for where in (text, html) for pattern in (address, refresh, link)])


def redirect_stub(text: Column, html: Column) -> dict[str, Column]:
    """Of a page that only sends its reader on: reason and followup_url, both null for any other page."""
    line = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    stub = (F.length(line) <= MOST_STUB) & F.exists(F.array(*map(F.lit, REDIRECT_MARKS)), lambda m: F.contains(F.lower(line), m))
    return {"reason": F.when(stub, "redirect_stub"), "followup_url": F.when(stub, redirect_target(line, html))}


def main_content(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html, with title, text, strategy, fallback_used, removed_boilerplate (boxes left out), link_texts (links whose text is kept), dropped_fragments, and for redirect stubs
    reason and followup_url."""
    read = _read(pages.select([c for c in pages.columns if c not in RESULTS]), html_col)
    html, low = F.coalesce(html_col, F.lit("")), F.lower(F.coalesce(html_col, F.lit("")))
    main = F.when(F.length("_main") >= LEAST_MAIN, F.col("_main")).otherwise("")
    plain = F.when(main != "", main).otherwise(F.col("_whole"))
    first = F.array_position(F.transform("_wiki", lambda x: x != ""), True).cast("int")
    wiki = F.when(low.contains("mw-parser-output") | low.contains("mw-content-text") | low.contains("mediawiki"), F.when(first > 0, F.get("_wiki", first - 1)))
    use_wiki = F.coalesce(wiki.isNotNull() & ((main == "") | (F.length(wiki) >= F.greatest(F.lit(LEAST_WIKI), F.length(plain) * 2))), F.lit(False))
    named = F.element_at(F.array(*[F.lit(n) for n, _, _ in WIKI]), F.greatest(first, F.lit(1)))
    found = F.when(use_wiki, wiki).otherwise(plain)
    titled = (found == "") & (F.col("_title") != "")
    chosen = read.withColumn("_found", F.when(titled, F.col("_title")).otherwise(found)).withColumn("strategy", F.when(titled, "title_text_fallback").when(use_wiki, named).otherwise("main_content"))
    text, dropped = broken_links(F.col("_found"))
    out = chosen.withColumn("text", text).withColumn("dropped_fragments", dropped)
    out = out.withColumns(redirect_stub(F.col("text"), html))
    out = out.withColumn("title", F.nullif("_title", F.lit(""))).withColumn("fallback_used", F.col("strategy") != "main_content")
    return out.select(*[c for c in read.columns if c not in READ.names and c != html_col], *RESULTS)


def segments(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, segment_no, start, stop, segment): a text's paragraphs with single blanks, and where each lies in the text that they make joined by an empty line."""
    rows = texts.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n{2,}")).alias("n", "raw"))
    squeezed = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?U)[^\S\n]+", " "), r" ?\n ?", "\n"))
    rows = rows.withColumn("segment", F.regexp_replace(squeezed, r"^\n+|\n+$", "")).where("segment <> ''")
    before = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("segment") + 2).over(before), F.lit(0)).cast("long"))
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("n")) - 1
    return placed.select(id_col, number.cast("long").alias("segment_no"), "start", (F.col("start") + F.length("segment")).cast("long").alias("stop"), "segment")
