"""The thin queries over the training-data operators: each takes (spark, sf_dir) and returns its operator's full result as digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table
from sparkloom.llm.oracles import ORACLE_SQL

TOKENIZER_PACKAGE = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    from importlib import import_module

    return import_module(TOKENIZER_PACKAGE).path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.jaccard import components

    found = components(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.flac import read_flac, write_flac

    docs = table(spark, sf_dir, "documents")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    read = read_flac(write_flac(docs, "doc_id", data))
    pcm, tail = F.col("pcm"), F.expr("substring(pcm, length(pcm) - 31, 32)")
    return read.select(
        "doc_id", "n_bytes", F.length(pcm).cast("long").alias("payload_bytes"), F.sha2(pcm, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.toxicity import held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.quality import BASE, judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")


#: A conversation whose texts say what a template's control strings might.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.chat import format_chats, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(own), tokenizer_path("byte_bpe_50k.json")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.substring import dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, unit="section").select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, max_tokens=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs whose page shows a labelled document (the number in the path is the document's id): bad if its quality is 0."""
    doc = F.regexp_extract("url", r"/(\d{1,18})(?:[./?#]|$)", 1)
    urls = table(spark, sf_dir, "pages").select("url", F.when(doc != "", doc.cast("long")).alias("doc_id"))
    return urls.join(table(spark, sf_dir, "labels"), "doc_id").select("url", (F.col("quality") == 0).cast("int").alias("bad"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.urls import judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES, labelled_urls(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), keep=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.common import scratch
    from sparkloom.llm.lines import LineIndex

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark, scratch(spark, "line-index"), least_docs=3, least_chars=20)
    index.insert(docs)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return index.clean(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.spelling import variants

    found = variants(table(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2, every=97)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.importance import resample

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample(docs, table(spark, sf_dir, "benchmark"), percent=10, least_words=20, n=1, buckets=10_000, seed="2024", keep=False)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_flac": op2_flac, "op3_toxicity": op3_toxicity, "op4_quality_rules": op4_quality_rules, "op5_chat_format": op5_chat_format, "op6_substring_dedup": op6_substring_dedup, "op7_packing": op7_packing, "op8_url_filter": op8_url_filter, "op9_html_text": op9_html_text, "op10_mixing": op10_mixing, "op11_line_dedup": op11_line_dedup, "op12_spelling": op12_spelling, "op13_importance": op13_importance, "pipeline": pipeline}
