"""The corpus pipeline: five stages, each applying one operator of ``colophon.llm`` to what the stage before it kept.

Defined cases: a null text has no words, so the quality rules reject its document; a null source is a source, a null doc_id
comes after all others; of documents that link, and of equal ones, the first in the order of doc_id stays; an empty table
gives an empty result; texts of any length are handled whole. Columns besides doc_id, text and source go through all stages
but the last unchanged, whatever they are called (n_chars alone follows the text).
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm import byte_bpe, mixing, near_duplicates, quality_rules, substring_dedup
from colophon.llm.common import shared_dir, table


def _on_documents(stage):
    """A stage whose operator sees the other columns of docs under names that no operator uses; it returns those of docs."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        other = {c: f"other{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
        rows = stage(spark, docs.withColumnsRenamed(other), sf_dir)
        rows = rows.withColumnsRenamed({v: k for k, v in other.items()}).select(*docs.columns)
        if "n_chars" in docs.columns:
            rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return rows

    return run


@_on_documents
def rule_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are too frequent in their source."""
    ruled = quality_rules.quality_rules(docs).filter("kept").withColumn("text", F.col("clean_text"))
    return ruled.select(*docs.columns)


@_on_documents
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group that links connect."""
    return near_duplicates.keep_one(docs)


@_on_documents
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur earlier."""
    return substring_dedup.dedup_substrings(docs).select(*docs.columns)


@_on_documents
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix_sources(docs)
    copies = F.when(F.col("__len") > 0, (F.col("__taken") / F.col("__len")).cast("int")).otherwise(0)
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, source, and the length and digests of its token ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", "__bpe.*")


STAGES = [
    ("quality rules", rule_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: Grouping by links, seeded subsets and BPE have no form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{i}")
    return docs
