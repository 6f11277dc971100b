"""Importance resampling towards a target: documents are drawn by how much more likely the target's n-grams make them than the corpus's do.

Texts go through Arrow kernels, some megabytes at a time: `ascii_lower`, `split_pattern_regex`, `list_flatten` and `dictionary_encode` turn
them into word indices; an n-gram is that index and the shifted ones, so only distinct n-grams are ever joined and put through CRC-32, and
`take` gives each occurrence its bucket. The first pass counts occurrences by bucket: a task emits one row a bucket, so `buckets` rows (a
parameter) are all that the driver reads. The second pass takes each bucket's gain and reduces it over each document's segment.

The draw has no window over the whole table. `approxQuantile` gives a score below which nothing is drawn (its error is bounded, so the
candidates always hold the draw); candidates are dealt out by ranges of their order, written, and numbered range by range; what a range
adds to its rows' numbers is the count of the ranges before it.

Defined cases: null and empty texts have no feature, weight 0 and still a score; a text shorter than n words has no n-gram of that length; a null
id takes part as the empty string and comes after other ids among equal scores; repeated rows are drawn one by one; an empty
corpus gives no rows and an empty target leaves all gains to the corpus's counts. Extra columns stay (`keep=False` leaves all but the id
out, which spares their bytes); columns named as the results are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkloom.llm.common import materialize, slices

#: Between words stands any ASCII character that is neither a digit nor a letter; upper-case letters have been lowered by then.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ("n_features", "n_words", "weight", "score", "rank")


def features(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each occurrence of a run of 1 to n words, and the rows' word counts."""
    # Lowered before the cast: ascii_lower gives wrong texts for a slice whose offsets were cast.
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()), pattern=BETWEEN)
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = pc.dictionary_encode(flat.filter(full))
    rows, codes, names = rows[full.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()
    n_words = np.bincount(rows, minlength=len(texts))
    all_rows, all_buckets = [], []
    own, gram, starts = [(c,) for c in range(len(names))], codes, np.arange(len(codes))
    for k in range(1, n + 1):
        if k > 1:
            # The k-gram at i is the (k-1)-gram at i and the word at i + k - 1 of the same row.
            inside = starts + k - 1 < len(codes)
            starts, gram = starts[inside], gram[inside]
            same = rows[starts] == rows[starts + k - 1]
            starts, gram = starts[same], gram[same]
            distinct, gram = np.unique(gram * max(1, len(names)) + codes[starts + k - 1], return_inverse=True)
            own = [(*own[d // len(names)], d % len(names)) for d in distinct.tolist()]
        bucket = np.fromiter((zlib.crc32(b" ".join([names[c] for c in gram_codes])) % buckets for gram_codes in own), np.int64, len(own))
        all_rows.append(rows[starts])
        all_buckets.append(np.take(bucket, gram) if len(own) else gram)
    return np.concatenate(all_rows), np.concatenate(all_buckets), n_words


def bucket_counts(df: DataFrame, text: str, n: int, buckets: int) -> list[int]:
    """Occurrences by bucket over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                total += np.bincount(features(part, n, buckets)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    out = [0] * buckets
    for r in df.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """1000 times the log of how much likelier each bucket is in the target, with one more of each bucket on both sides, floored."""
    size, wanted, buckets = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log((t + 1.0) * (size + float(buckets)) / ((s + 1.0) * (wanted + float(buckets))))) for s, t in zip(corpus, target, strict=True)]


def noise(id_col: str, seed: str) -> Column:
    """1000 times a standard Gumbel number that the id and the seed decide, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """docs with n_features (occurrences of runs of 1 to n words), n_words and weight (the sum of their buckets' gains)."""
    if n < 1 or not 1 <= buckets <= 1 << 24:
        raise ValueError("n from 1 and buckets from 1 to 16,777,216 are needed")
    docs = docs.select([c for c in docs.columns if c not in ADDED])
    gain = np.array(gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, text_col, n, buckets)), np.int64)
    own = [f for f in docs.schema.fields if keep or f.name == id_col]
    names = [*(f.name for f in own), "n_features", "n_words", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(len(own))):
                rows, bucket, n_words = features(part, n, buckets)
                order = np.argsort(rows, kind="stable")
                taken, counts = np.take(gain, bucket[order]), np.bincount(rows, minlength=len(part))
                weight = np.zeros(len(part), np.int64)
                some = counts > 0
                if some.any():
                    weight[some] = np.add.reduceat(taken, (np.cumsum(counts) - counts)[some])
                out = [pa.array(x, pa.int64()) for x in (counts, n_words, weight)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns[: len(own)]), *out], names=names)
                at += len(part)

    schema = StructType([*own, *(StructField(c, LongType()) for c in ("n_features", "n_words", "weight"))])
    return docs.select(*[f.name for f in own], F.col(text_col).alias("_weighed")).mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, buckets: int = 10_000, seed: str = "2024",
    id_col: str = "doc_id", text_col: str = "text", keep: bool = True, ranges: int | None = None,
) -> DataFrame:
    """docs with n_features, n_words, weight, score (weight plus noise) and rank: of the documents with least_words words, percent in a
    hundred (floored) with the highest scores have ranks from 1, ties going to the smaller id; rank is null for all others."""
    spark = docs.sparkSession
    scored = weigh(docs, target, n, buckets, id_col, text_col, keep).withColumn("score", F.col("weight") + noise(id_col, seed))
    scored = materialize(scored, "importance-scored")
    able = scored.where(F.col("n_words") >= least_words)
    wanted = able.count() * percent // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    error = 0.002
    (least,) = able.stat.approxQuantile("score", [max(0.0, 1 - percent / 100 - 2 * error)], error)
    inside = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(int(least)))
    # Equal rows come in any order; the last key only spreads them over ranges.
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("_spread")]
    parts = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = scored.where(inside).withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "importance-ranges")
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for k in sorted(sizes):
        rows.append((k, before))
        before += sizes[k]
    starts = spark.createDataFrame(rows, "_range int, _before long")  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    ranked = dealt.join(F.broadcast(starts), "_range").withColumn("rank", F.when(place <= wanted, place.cast("long")))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~inside).withColumn("rank", F.lit(None).cast("long")))
