"""Grouping of spelling variants: words one edit apart, found by Gram matrices of letter counts.

Words are counted by column expressions, with partial sums before the shuffle. What is left (words of least_length code points found
least_count times) is dealt into cells by how many of a word's letters fall in each of `groups` groups of letters; the sum of a cell's
counts is the words' length. One replaced letter moves at most one count from one group to another, one inserted letter adds one to one
group, so near words lie in the same cell, or in cells one such step apart: blocks of the same and of adjacent lengths.
Each unordered pair of neighbouring cells meets once. A cell of more than `block` words (fewer if they are long) is cut into
blocks by the words' hash, so no task holds more than two blocks whatever the vocabulary; the pairs of blocks are dealt by cell and block.

In a task, NumPy multiplies two blocks' letter counts: |a|^2 + |b|^2 - 2ab is the squared distance, 1 for a letter inserted and 2 for a letter
replaced. Pairs within two are then verified, all at once, on the words' code points. Only real neighbours leave the task.

A word's form is its near word with the largest count, if that is at least `ratio` times its own; roots follow forms by pointer doubling
over the words that have one (counts at least double at each step with a ratio of 2, so chains are short).

Defined cases: null and empty texts have no runs; a null id counts as the empty string in the hash; ties between forms go to the smallest
in code-point order; an empty table gives no words; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs are letters of ASCII and U+00C0 to U+00FF; anything else stands between.
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
#: Columns of the letter counts: a to z, then U+00C0 to U+00FF.
LETTERS = 26 + 64


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """One row (word) per run of letters, A-Z lower-cased; where every divides the hash of id and run, a letter that the hash points at is left out."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(text, BETWEEN)).alias("run")).where("run <> ''")
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, at + 2)"))
    marked = found.withColumn("h", h).withColumn("at", at)
    return marked.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of words long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _group(k: int, groups: int) -> str:
    """The letters of group k as a class of letters."""
    letters = [*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]
    return "".join(letters[k::groups])


def letter_groups(word: Column, groups: int) -> Column:
    """How many letters of a word fall in each group."""
    return F.array(*[F.length(word) - F.length(F.translate(word, _group(k, groups), "")) for k in range(groups)])


def neighbours(groups: int) -> Column:
    """The cells that column `cell` meets: itself, those after it one replacement away, and those one letter longer."""
    part = [F.col("cell")[k] for k in range(groups)]
    cells = [F.col("cell")]
    for i in range(groups):
        cells.append(F.array(*[part[k] + int(k == i) for k in range(groups)]))
        # A letter moves from group j to an earlier group i: the other cell is the greater of the two.
        cells += [F.when(part[j] > 0, F.array(*[part[k] + int(k == i) - int(k == j) for k in range(groups)])) for j in range(i + 1, groups)]
    return F.array_compact(F.array(*cells))


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)


def _counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts, a row per word."""
    letter = np.where(codes < 128, codes - 97, codes - 0xC0 + 26)
    flat = (np.arange(len(codes))[:, None] * LETTERS + letter).ravel()
    return np.bincount(flat, minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS).astype(np.float32)


def near(a: list[str], b: list[str], same: bool, wide: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs one edit apart; all words of a have one length, those of b the same or one more. same: b is a, and each pair comes once."""
    if not a or not b:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = _codes(a), _codes(b)
    length, longer = left.shape[1], right.shape[1] - left.shape[1]
    x, y = _counts(left), _counts(right)
    x2, y2 = (x * x).sum(1), (y * y).sum(1)
    found_a, found_b = [], []
    for at in range(0, len(a), wide):
        for upto in range(0, len(b), wide):
            distance = x2[at : at + wide, None] + y2[None, upto : upto + wide] - 2 * (x[at : at + wide] @ y[upto : upto + wide].T)
            i, j = np.nonzero((distance > 0.5) & (distance < 2.5))
            i, j = i + at, j + upto
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 65536):
                p, q = i[s : s + 65536], j[s : s + 65536]
                equal = left[p] == right[q][:, :length]
                if longer:
                    # The longer word without one letter: a common beginning and a common end cover the shorter word.
                    head = np.logical_and.accumulate(equal, 1).sum(1)
                    tail = np.logical_and.accumulate((left[p] == right[q][:, 1:])[:, ::-1], 1).sum(1)
                    good = head + tail >= length
                else:
                    good = equal.sum(1) == length - 1
                found_a.append(p[good])
                found_b.append(q[good])
    return np.concatenate(found_a or [np.empty(0, np.int64)]), np.concatenate(found_b or [np.empty(0, np.int64)])


def near_pairs(words: DataFrame, groups: int = 6, block: int = 2048) -> DataFrame:
    """(word, n, other, other_n): words exactly one inserted, deleted or replaced code point apart, each pair both ways. words has word and n, one row a word."""
    celled = words.select("word", "n", letter_groups(F.col("word"), groups).alias("cell"))
    # Blocks of long words hold fewer of them, so that a block's code points are bounded too.
    sizes = celled.groupBy("cell").agg(F.ceil(F.sum(F.greatest(F.lit(16), F.length("word"))) / (16 * block)).cast("long").alias("blocks"))
    sizes = materialize(sizes, "spelling-cells")
    chosen = celled.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    blocks = chosen.groupBy("cell", "block").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    blocks = materialize(blocks, "spelling-blocks")
    meets = blocks.select(F.col("cell").alias("own"), F.col("block").alias("own_block"), "words", F.explode(neighbours(groups)).alias("cell")).join(sizes, "cell")
    meets = meets.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meets = meets.where("cell <> own or block >= own_block")
    pairs = meets.join(blocks.select("cell", "block", F.col("words").alias("others")), ["cell", "block"])
    pairs = pairs.select("words", "others", F.expr("cell = own and block = own_block").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, others, same in zip(*batch.columns, strict=True):
                a, b = words.values, others.values
                names_a, names_b = a.field("word"), b.field("word")
                i, j = near(names_a.to_pylist(), names_b.to_pylist(), same.as_py())
                if len(i):
                    left, right = (names_a.take(i), a.field("n").take(i)), (names_b.take(j), b.field("n").take(j))
                    yield pa.RecordBatch.from_arrays([*left, *right], names=["word", "n", "other", "other_n"])
                    yield pa.RecordBatch.from_arrays([*right, *left], names=["word", "n", "other", "other_n"])

    return pairs.mapInArrow(run, "word string, n long, other string, other_n long")


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root) for each word that has a form (word, form): each round, what a word points at is replaced by what that points at."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now
    raise RuntimeError("forms run in a circle")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, every: int = 97, id_col: str = "doc_id", text_col: str = "text", groups: int = 6, block: int = 2048) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the vocabulary."""
    if ratio < 2:
        raise ValueError("forms need a ratio of at least 2, or they run in circles")
    words = materialize(vocabulary(runs(docs, id_col, text_col, every), least_length, least_count), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    linked = near_pairs(words, groups, block).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    linked = linked.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    linked = materialize(linked, "spelling-near")
    ends = roots(linked.where("form is not null"))
    whole = words.join(linked, "word", "left").join(ends, "word", "left")
    return whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
