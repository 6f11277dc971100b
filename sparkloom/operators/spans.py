"""From documents to chunks, sentences and their neighbours, with exact character offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

CHUNKS = "chunk_no int, text string, token_count long, char_start int, char_end int, paragraph_count int"
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")
_SENTENCE = re.compile(T.SENTENCE)
#: Neighbouring sentences make a pair if so many characters at most lie between them, and so many are in both.
PAIR_GAP, PAIR_MOST = 120, 520
#: Spans that a task holds before it hands them on, but for those of one document.
MOST_ROWS = 20_000


def _pieces(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Spans of the paragraphs, the long ones cut at the last blank that leaves at most `most` characters."""
    for m in _PARAGRAPH.finditer(text):
        a, b = m.start(), m.end()
        while b - a > most:
            cut = text.rfind(" ", a, a + most + 1)
            cut = cut if cut - a >= most // 2 else a + most
            yield a, cut
            a = cut
            while a < b and text[a].isspace():
                a += 1
        if a < b:
            yield a, b


def chunk(text: str, most: int = 1200) -> list[tuple[int, str, int, int, int, int]]:
    """Neighbouring paragraphs packed up to `most` characters; offsets are those of the original text."""
    packed: list[list[tuple[int, int]]] = []
    size = 0
    for a, b in _pieces(text, most):
        if not text[a:b].strip():
            continue
        if packed and size + 2 + b - a <= most:
            packed[-1].append((a, b))
            size += 2 + b - a
        else:
            packed.append([(a, b)])
            size = b - a
    out = []
    for n, spans in enumerate(packed):
        body = "\n\n".join(text[a:b].strip() for a, b in spans)
        out.append((n, body, max(1, -(-len(body) // 4)), spans[0][0], spans[-1][1], len(spans)))
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1200) -> DataFrame:
    """A row per chunk. Reads one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(c.split()[0] for c in CHUNKS.split(", "))]
        types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [(i, *c) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for c in chunk(t or "", most)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names=names)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, {CHUNKS}")
    return out.withColumnRenamed("id", id_col)


def sentence_rows(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, span_no, excerpt): the sentences in order."""
    return _cut(docs, id_col, text_col, "excerpt", lambda s: s)


def sentence_identities(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, span_no, identity): of each sentence what T.claim_identity says, by Arrow's kernel."""
    return _cut(docs, id_col, text_col, "identity", lambda s: pc.replace_substring_regex(pa.array([x.lower() for x in s.to_pylist()], pa.string()), T.NO_IDENTITY, ""))


def _cut(docs: DataFrame, id_col: str, text_col: str, name: str, change: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """(id, span_no, name): T.sentences of each text, changed; null texts have none. Rows go on every MOST_ROWS."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([docs.schema[id_col], StructField("span_no", LongType()), StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: pa.Array, of: list[int], numbers: list[int], found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), pa.array(numbers, pa.int64()), change(pa.array(found, pa.string()))], names=[id_col, "span_no", name])

        for batch in batches:
            of, numbers, found = [], [], []
            for i, t in enumerate(batch.column(1)):
                own = [s for m in _SENTENCE.findall(t.as_py() or "") if (s := m.strip(" "))]
                of += [i] * len(own)
                numbers += range(len(own))
                found += own
                if len(found) >= MOST_ROWS:
                    yield made(batch.column(0), of, numbers, found)
                    of, numbers, found = [], [], []
            yield made(batch.column(0), of, numbers, found)

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, sentence) in order; a text without a sentence is one span."""
    none = True
    for m in _SENTENCE.finditer(text):
        s = m[0].strip()
        if s:
            a, none = m.start() + m[0].index(s), False
            yield a, a + len(s), s
    if none and text.strip():
        yield 0, len(text), text


def sentence_spans(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, span_no, start, stop, excerpt) with excerpt = text[start:stop]; a text without a sentence is one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["id", "span_no", "start", "stop", "excerpt"])

        for batch in batches:
            rows: list[tuple] = []
            for i, t in zip(batch.column(0), batch.column(1)):
                rows += [(i.as_py(), n, *found) for n, found in enumerate(sentences(t.as_py() or ""))]
                if len(rows) >= MOST_ROWS:
                    yield made(rows)
                    rows = []
            yield made(rows)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(run, "id long, span_no int, start int, stop int, excerpt string").withColumnRenamed("id", id_col)


def with_neighbours(spans: DataFrame, id_col: str, gap: int = PAIR_GAP, most: int = PAIR_MOST) -> DataFrame:
    """The spans and each pair of neighbours that are close and short enough together."""
    ahead = Window.partitionBy(id_col).orderBy("span_no")
    pair = spans.select(
        id_col, "span_no", "start", F.lead("stop").over(ahead).alias("stop"), F.concat_ws(" ", "excerpt", F.lead("excerpt").over(ahead)).alias("excerpt"),
        (F.lead("start").over(ahead) - F.col("stop")).alias("_gap"),
    ).where((F.col("_gap") <= gap) & (F.length("excerpt") <= most)).drop("_gap")
    return spans.withColumn("pair", F.lit(False)).unionByName(pair.withColumn("pair", F.lit(True)))


def overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals [start, stop] of a key that touch, ends included. Both sides have key, start and stop.

    Intervals are put into cells of `cell` characters, so a long document joins cell by cell and not all with all."""
    cell = 4096
    cells = lambda df, n: df.withColumn(f"_{n}", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("stop") / cell))))
    a = cells(left, "a").select(key, F.col("_a").alias("_cell"), F.struct(*left.columns).alias("l"))
    b = cells(right, "b").select(key, F.col("_b").alias("_cell"), F.struct(*right.columns).alias("r"))
    touch = (F.col("r.stop") >= F.col("l.start")) & (F.col("r.start") <= F.col("l.stop"))
    first = F.col("_cell") == F.floor(F.greatest("l.start", "r.start") / cell)  # each pair once, in its first common cell
    return a.join(b, [key, "_cell"]).where(touch & first).select(key, "l", "r")


def validity(text: F.Column) -> F.Column:
    """Why a chunk may not be stored, null if it may."""
    n = F.greatest(F.length(text), F.lit(1))
    printable = F.length(F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Cn}\p{Co}\p{Cs}]+", "")) / n
    control = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+", "")) / n
    pdf = text.rlike(r"\b\d+ \d+ obj\b") & text.contains("endobj") | text.startswith("%PDF-")
    return (
        F.when(text.isNull(), "null_text").when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "blank_text").when(text.contains("\x00"), "nul_character")
        .when(pdf, "pdf_residue").when(printable < 0.42, "low_printable_ratio").when(control > 0.14, "high_control_ratio")
    )
