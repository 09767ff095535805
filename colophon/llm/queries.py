"""The queries of the corpus operators: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quantisation, byte_bpe, chat_format, html_extraction, mixing, near_duplicates, periodic_runs, quality_classifier, quality_rules, ranked_search, substring_dedup, suffix_dedup, token_files
from .common import table
from .oracles import ORACLES as ORACLES

MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY_BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY_VOCABULARY = 50_257


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score_quality(docs, net)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("__len").alias("size"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, MULTI_BPE, public_tokenizers.PATTERN).select("doc_id", "__bpe.*")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.new_token_folder(spark)
    token_files.write_token_file(docs, folder, LIBRARY_BPE, LIBRARY_VOCABULARY)
    return token_files.read_token_file(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantisation.nearest(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_extraction.extract_text(pages, html_extraction.fit_weights(pages))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: A conversation whose texts are made of the template's own markers.
MARKED = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return chat_format.read_back(chat_format.format_conversations(rows.union(marked)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    return found.select("doc_id", *[f"__runs.{c}" for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")])


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_source_mixing, op3_substring_dedup, op4_jaccard_join, op5_byte_bpe, op6_token_files, op7_additive_quantisation, op8_suffix_dedup, op9_html_extraction, op10_quality_rules, op11_chat_format, op12_periodic_runs, op13_ranked_search)}
