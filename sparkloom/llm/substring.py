"""Substring dedup by hashing lines, paragraphs or the sections of lines.

Units are normalised (lower case, runs of white space as one blank) and hashed; the digests are grouped over all documents, the
occurrence in the document of least rank stays and the others go where neighbouring ones make up min_words words. Original offsets are kept.

unit="line" and unit="paragraph" take whole lines and paragraphs, so a passage inside a longer line is not seen. unit="section" cuts each
line further, where its words say so: a section begins at a line's first word and at each word whose hash (with the word before it) is the least
within REACH words of the line on either side, and after MOST_WORDS words. So the same words are cut in the same places wherever they stand,
in the middle of sentences and without punctuation. What is hashed then is each section together with the next one of its document: single
sections that recur by chance remove nothing, and a line that recurs is covered from its first word to its last. Of a repeated passage, up to
a section at either end stays, because it hangs together with other words there. Sections have 7 words on average in long lines; of planted passages of 51
random words 41 go on average, of 40 words 29, of 30 words 14; 77 of 200 passages of 30 words and all of 20 stay whole, so min_words bounds what may be cut and doesn't promise that all of it is.

Scale: a row per distinct digest of a document. Grouping takes the least and the greatest rank by digest, with map-side sums, so a line in a third of all documents is a row
per task; the digests that several documents have are a table of their own, joined back to the occurrences: Spark broadcasts it if it is small and
else splits skewed keys. No group of occurrences is ever gathered; only the unit numbers of one document are.

A digest has 96 bits. Rows are told apart by id and a hash of the text, so rows with one id and different texts never lose each other's units.

Defined cases: a null text stays null and an empty one empty; rank is the id; a null id ranks by its text, before the least ids in use; rows with the same id and text count as one
document and lose the same; rows with the same id and other texts have the same rank and keep what they share; a unit repeated inside one document goes after its
first occurrence (sections: where the two don't overlap); all columns of the input stay, and one named removed is replaced. Offsets count code points of the original text.
A line of which nothing is left goes with its line feed. Text is lost nowhere: the first occurrence of each unit is never removed for another document's sake.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sparkloom.llm.common import materialize

BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n\s*\n"), "section": re.compile(r"\n")}
REACH, MOST_WORDS = 3, 24
KNOWN_WORDS = 200_000
_WORD = re.compile(r"\S+")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MOST = np.uint64(2**64 - 1)


class WordHashes(dict):
    """64-bit hashes of lower-case words, remembered as long as the worker lives."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_known = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _before(first: np.ndarray) -> np.ndarray:
    """For a mask of beginnings: how many elements each stands behind its beginning."""
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _sums(words: np.ndarray, begins: np.ndarray, lane: int) -> np.ndarray:
    """A hash of each stretch of words, by the places where they begin."""
    first = np.zeros(len(words), bool)
    first[begins] = True
    behind = _before(first)
    powers = np.full(int(behind.max(initial=0)) + 1, _ODD[lane])
    powers[0] = 1
    x = words if lane == 0 else _mixed(words ^ _ODD[1])
    return _mixed(np.add.reduceat(x * np.cumprod(powers)[behind], begins)) if len(begins) else np.zeros(0, np.uint64)


def _cuts(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the sections of lines begin. begins: the lines' first words."""
    n = len(words)
    first = np.zeros(n, bool)
    first[begins] = True
    c = words * _ODD[0]
    c[1:] += np.where(first[1:], np.uint64(0), words[:-1])
    c = _mixed(c)
    at = np.arange(n) + REACH * np.cumsum(first)  # lines stand apart, so that no window sees two
    wide = np.full(n + REACH * (len(begins) + 1), _MOST)
    wide[at] = c
    least = first.copy()
    inside = np.ones(n, bool)
    for k in range(1, REACH + 1):
        inside &= (c < wide[at - k]) & (c <= wide[at + k])
    least |= inside
    return np.flatnonzero(least | (_before(least) % MOST_WORDS == 0))


class Units:
    """The units of some texts: begins and words of each (begins by the word in all texts), the text each is in, and what is hashed: two lanes for each key, the
    first unit it covers and how many it covers."""

    def __init__(self, texts: list[str], unit: str):
        parts = [[p.split() for p in BREAKS[unit].split(t.lower())] for t in texts]
        parts = [[p for p in ps if p] for ps in parts]
        flat = [w for ps in parts for p in ps for w in p]
        words = np.fromiter(map(_known.__getitem__, flat), np.uint64, len(flat))
        sizes = np.array([len(p) for ps in parts for p in ps], np.int64)
        self.text_begins = np.concatenate([[0], np.cumsum([sum(map(len, ps)) for ps in parts])]).astype(np.int64)
        self.begins = (np.cumsum(sizes) - sizes).astype(np.int64)
        if unit == "section" and len(words):
            self.begins = _cuts(words, self.begins)
        self.sizes = np.diff(np.append(self.begins, len(words)))
        self.text = np.searchsorted(self.text_begins, self.begins, side="right") - 1
        # Texts without a word begin where the next one does.
        lanes = [_sums(words, self.begins, lane) for lane in (0, 1)]
        if unit == "section":
            n = len(self.begins)
            follows = np.zeros(n, bool)
            follows[: max(0, n - 1)] = self.text[1:] == self.text[:-1]
            alone = ~follows & ~np.concatenate([[False], follows[:-1]])[:n]
            self.key_unit = np.flatnonzero(follows | alone)
            self.covers = np.where(follows, 2, 1)[self.key_unit]
            second = [np.where(follows, np.append(x[1:], np.uint64(0))[:n], np.uint64(0)) for x in lanes]
            lanes = [_mixed(x * odd + y)[self.key_unit] for x, y, odd in zip(lanes, second, reversed(_ODD))]
        else:
            self.key_unit, self.covers = np.arange(len(self.begins)), np.ones(len(self.begins), np.int64)
        self.digests = lanes[0].view(np.int64), (lanes[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        self.key_text = self.text[self.key_unit]

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys that occur first in their text, and for each key the first one alike in its text."""
        alike = _mixed(self.digests[0].view(np.uint64) + self.digests[1].view(np.uint32) * _ODD[1]) + self.key_text.astype(np.uint64) * _ODD[0]
        order = np.argsort(alike, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = alike[order[1:]] == alike[order[:-1]]
        origin = np.empty(len(order), np.int64)
        origin[order] = order[np.arange(len(order)) - _before(~same)]
        return np.flatnonzero(origin == np.arange(len(order))), origin


def stretches(text: str, marks: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Spans of the stretches of min_words or more marked words, each up to the next word in the same line."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))).tolist()
    long = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= min_words]
    if not long:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    out = []
    for a, b in long:
        stop = places[b - 1][1]
        if b < len(places) and "\n" not in text[stop : places[b][0]]:
            stop = places[b][0]
        out.append((places[a][0], stop))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans, and without the lines of which nothing is left."""
    gone = bytearray(len(text))
    for a, b in spans:
        gone[a:b] = b"\1" * (b - a)
    kept, start = [], 0
    for line in text.split("\n"):
        stop = start + len(line)
        marks = gone[start:stop]
        left = "".join(c for c, g in zip(line, marks) if not g) if any(marks) else line
        if left.strip() or not any(marks):
            kept.append(left)
        start = stop + 1
    return "\n".join(kept)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Rank and text hash, which together tell rows apart. A null id gets a rank by its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(text), F.lit(1 << 61))), F.hash(text)


def occurrences(docs: DataFrame, unit: str, id_col: str, text_col: str) -> DataFrame:
    """A row per digest and document: high, low (the digest), rank, row (the text's hash) and key (the number of its first unit)."""
    names = ["high", "low", "rank", "row", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = Units(part.column(2).to_pylist(), unit)
                first, _ = found.firsts()
                of = pa.array(found.key_text[first])
                number = first - np.searchsorted(found.key_text, found.key_text[first])
                high, low = (pa.array(d[first]) for d in found.digests)
                yield pa.RecordBatch.from_arrays([high, low, part.column(0).take(of), part.column(1).take(of), pa.array(number.astype(np.int32))], names=names)

    rank, row = row_key(id_col, text_col)
    rows = docs.select(rank.alias("rank"), row.alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "high long, low int, rank long, row int, key int")


def repeats(docs: DataFrame, unit: str, id_col: str, text_col: str) -> DataFrame:
    """rank, row and again (the numbers of the document's keys that a document of lower rank has); only documents that have any."""
    found = materialize(occurrences(docs, unit, id_col, text_col), "substring-units")
    ranks = found.groupBy("high", "low").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last")
    shared = materialize(ranks.select("high", "low", "first"), "substring-shared")
    return found.join(shared, ["high", "low"]).where("rank > first").groupBy("rank", "row").agg(F.collect_set("key").alias("again"))


def dedup(docs: DataFrame, unit: str = "line", min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cut, and removed: the spans of the original text that are gone (empty if none)."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    again = repeats(docs, unit, id_col, text_col).withColumnsRenamed({"rank": "_sub_rank", "row": "_sub_row", "again": "_sub_again"})
    own = [f for f in docs.schema.fields if f.name != "removed"]
    at = [f.name for f in own].index(text_col)
    names = [*(f.name for f in own), "removed"]
    rank, row = row_key(id_col, text_col)
    joined = docs.withColumns({"_sub_own_rank": rank, "_sub_own_row": row})
    joined = joined.join(again, (F.col("_sub_own_rank") == F.col("_sub_rank")) & (F.col("_sub_own_row") == F.col("_sub_row")), "left").select(*[f.name for f in own], "_sub_again")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    step = 2 if unit == "section" else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts, again = part.column(at).to_pylist(), part.column(len(own)).to_pylist()
                found = Units([t or "" for t in texts], unit)
                _, origin = found.firsts()
                marked = np.zeros(len(found.begins), bool)
                local = found.key_unit - found.key_unit[origin] >= step if len(origin) else np.zeros(0, bool)
                begin = np.searchsorted(found.key_text, np.arange(len(texts)))
                hit = np.flatnonzero(local)
                far = [begin[k] + np.array(numbers) for k, numbers in enumerate(again) if numbers]
                # A key alike in the same text goes where its first one does.
                there = np.zeros(len(origin), bool)
                if far:
                    there[np.concatenate(far)] = True
                hit = np.union1d(hit, np.flatnonzero(there[origin])) if len(origin) else hit
                marked[found.key_unit[hit]] = True
                marked[found.key_unit[hit] + found.covers[hit] - 1] = True
                words = np.repeat(marked, found.sizes)
                spans: list[list[tuple[int, int]]] = [[] for _ in texts]
                for k in np.unique(found.text[marked]).tolist():
                    spans[k] = stretches(texts[k], words[found.text_begins[k] : found.text_begins[k + 1]], min_words)
                    if spans[k]:
                        texts[k] = cut(texts[k], spans[k])
                columns = [*part.columns[:at], pa.array(texts, pa.string()), *part.columns[at + 1 : len(own)]]
                removed = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([*columns, removed], names=names)

    span = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])
    return joined.mapInArrow(run, StructType([*own, StructField("removed", ArrayType(span))]))
