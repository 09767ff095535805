"""Quality rules, natively: rules on one text, and the frequency of lines across documents.

A line is normalised (lower case, single spaces, trimmed) and hashed. For each host (``source``) the distinct documents
that hold a line are counted; copies of one text count once. A line found in more than ``max_share`` of the host's
documents is boilerplate and is removed; ``min_docs`` only guards against chance, and decides in no host of 80 distinct
documents or more. A document is rejected if it fails the rules on its own text, or if the removal leaves less than
``min_left`` of its words.

Defined cases. A null text is an empty text: no words, so the base rules reject it. A null source is a host of its own; a
null doc_id is kept as it is. Repeated rows give repeated results. Empty tables give empty results. Columns other than
doc_id, text and source pass through untouched, but for those named like a result, which the result replaces; names that
start with ``__`` are reserved. A text of 2^28 words or more is an error, as a position has 28 bits.

Everything is DataFrame code: hashes of three-word windows are packed with their position in a long and sorted as a
primitive array, so neighbours that agree are repeats. Two packings with different bits of the hash must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words_of

INDEX_BITS = 28
INDEX_MASK = (1 << INDEX_BITS) - 1


def _packed(hashes: Column, low: bool) -> Column:
    """Sorted longs: 36 bits of each hash, then its position."""
    bits = (lambda x: F.shiftleft(x, INDEX_BITS)) if low else (lambda x: x.bitwiseAND(F.lit(~INDEX_MASK)))
    return F.sort_array(F.transform(hashes, lambda x, i: bits(x).bitwiseOR(i.cast("long"))))


def _repeated(name: str) -> Column:
    """Positions whose hash bits equal a neighbour's in the sorted array column."""
    s = F.col(name)
    same = lambda x, i: F.shiftright(F.get(s, i), INDEX_BITS) == F.shiftright(x, INDEX_BITS)
    kept = F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
    return F.transform(kept, lambda x: x.bitwiseAND(F.lit(INDEX_MASK)))


def with_base_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to the columns of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = F.lit(SPACES)
    none = F.array().cast("array<bigint>")
    df = docs.withColumns(
        {
            "__words": F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)),
            "__lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, gone) != ""),
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.when(F.size("__words") > INDEX_MASK, F.raise_error(F.lit(f"a text of {INDEX_MASK + 1} words or more")).cast("long")).otherwise(F.size("__words").cast("long")),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__tri": F.when(
                F.size("__words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("__words") - 3),
                    lambda i: F.xxhash64(F.get(F.col("__words"), i), F.get(F.col("__words"), i + 1), F.get(F.col("__words"), i + 2)),
                ),
            ).otherwise(none),
        }
    )
    df = df.withColumn("__again", F.size(F.array_distinct("__tri")) < F.size("__tri"))
    for name, low in (("__high", False), ("__low", True)):
        df = df.withColumn(name, F.when(F.col("__again"), _packed(F.col("__tri"), low)).otherwise(none))
    df = df.withColumn("__at", F.array_intersect(_repeated("__high"), _repeated("__low")))
    # (a lambda with a second parameter, even one with a default, would be given the position)
    covered = F.array_distinct(F.concat("__at", F.transform("__at", lambda x: x + 1), F.transform("__at", lambda x: x + 2)))
    df = df.withColumn("n_repeat_words", F.size(covered).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # A generator of one row, through which no filter on these columns moves: it would take their expressions along, into
    # the lambdas, which would then run once for each element of another.
    return df.select(*[c for c in docs.columns if c not in made], F.inline(F.array(F.struct(*made))))


def _line_column(text: Column) -> Column:
    """Per line of the text: hash of the normalised line and number of its words; 0 words for a blank line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    norm = lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(SPACES)), r"[\x20\x09-\x0D]+", " "))
    both = lambda n: F.struct(F.xxhash64(n).alias("h"), F.when(n == "", 0).otherwise(F.size(F.split(n, " "))).alias("w"))
    return F.transform(F.transform(lines, norm), both)


def frequent_lines(docs: DataFrame, max_share: float = 0.05, min_docs: int = 5) -> DataFrame:
    """(__host, __h, n_docs): lines above the limits, by host."""
    lines = docs.select(F.col("source").alias("__host"), F.xxhash64("text").alias("__text"), F.explode(_line_column(F.col("text"))).alias("__line"))
    seen = lines.filter("__line.w > 0").select("__host", "__text", F.col("__line.h").alias("__h")).distinct()
    hosts = seen.select("__host", "__text").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("__docs"))
    often = seen.groupBy("__host", "__h").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    hosts = hosts.withColumnRenamed("__host", "__of")
    return often.join(hosts, F.col("__host").eqNullSafe(F.col("__of"))).filter(F.col("n_docs") > max_share * F.col("__docs")).select("__host", "__h", "n_docs")


def quality_rules(docs: DataFrame, max_share: float = 0.05, min_docs: int = 5, min_left: float = 0.2) -> DataFrame:
    """All rows and columns of docs, with the base columns, kept_words, kept, and ``clean_text`` without the frequent lines."""
    often = frequent_lines(docs, max_share, min_docs)
    own = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t"), F.col("source").alias("__s"), F.explode(F.array_distinct(F.transform(_line_column(F.col("text")), lambda x: x.h))).alias("__own"))
    hit = own.join(often, F.col("__s").eqNullSafe(F.col("__host")) & (F.col("__own") == F.col("__h")))
    hit = hit.groupBy("__id", "__t", "__s").agg(F.collect_set("__h").alias("__gone"))
    df = with_base_rules(docs).withColumns({"__text": F.xxhash64("text"), "__info": _line_column(F.col("text"))})
    df = df.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__t")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    left = F.aggregate(F.filter("__info", lambda x: ~F.array_contains(F.col("__gone"), x.h)), F.lit(0).cast("long"), lambda a, x: a + x.w)
    df = df.withColumn("kept_words", F.when(F.col("__gone").isNull(), F.col("n_words")).otherwise(left))
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), F.get(F.col("__info"), i).h))
    df = df.withColumns(
        {
            "kept": ~F.col("base_failed") & (F.col("kept_words") > 0) & (F.col("kept_words") >= min_left * F.col("n_words")),
            "clean_text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")),
        }
    )
    return df.drop("__text", "__info", "__id", "__t", "__s", "__gone")
