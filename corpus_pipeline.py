"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the grammar's model rejects go.
2. jaccard: of each component of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.
3. substring: passages that an earlier document has are cut out of later ones.
4. mixing: sources are mixed to their target weights; a document that is taken twice is there twice.
5. packing: what is left, as pieces of token sequences.

All stages but the last return the columns of documents. Stages read labels from the tables' folder and nothing else but their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, table
from sparkloom.llm.jaccard import components
from sparkloom.llm.mixing import mix
from sparkloom.llm.packing import pack
from sparkloom.llm.queries import tokenizer_path
from sparkloom.llm.substring import dedup
from sparkloom.llm.toxicity import score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.where("predicted = 0").select(docs.columns)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the kept row itself (same id, same text) stay with it; ids name documents."""
    found = components(docs, n=5, percent=80)
    others = found.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedup(docs, unit="section", min_words=20).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix(docs, weights=(5, 2, 1), share=1.5)
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return taken.where("copies > 0").select(*docs.columns, each).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, max_tokens=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("substring", substring), ("mixing", mixing), ("packing", packing)]
#: No SQL: the stages learn from labels, tokenise and compare sets; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
