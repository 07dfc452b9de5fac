"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontam, exactdedup, histsort, langid, linededup, simhash, tokenbin, tokencount, urlfilter
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return langid.classify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by the fixed rules."""
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, action string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of the benchmark."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written files of token ids hold of every document."""
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return bytebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage that goes, with its offsets and the document that keeps it."""
    return linededup.repeats(table(spark, sf_dir, "documents"), min_words=linededup.PASSAGE_WORDS)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return tokencount.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and owner of every document."""
    return exactdedup.duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return histsort.shard(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_simhash, op4_decontamination, op5_token_files, op6_byte_bpe, op7_line_dedup, op8_token_counts, op9_exact_dedup, op10_sharding, pipeline)}
ORACLES = {"op2_url_filter": urlfilter.SQL, "op4_decontamination": decontam.SQL, "op9_exact_dedup": exactdedup.SQL}
