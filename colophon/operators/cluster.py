"""Clusters of records that share a key, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved
from .hot import WIDTH, hot_keys, sketch, total, without

MOST = 100_000


def is_ref(doc: Column) -> Column:
    """Whether a raw document is marked as a reference."""
    return F.contains(doc, F.lit('"status":"ref"'))


def sizes(rows: DataFrame, least: int = 2, most: int = MOST, both: bool = False, drop_empty: bool = False) -> DataFrame:
    """(key, n, refs): of keyed rows with a boolean column ref, the clusters to keep; one combining aggregate."""
    if drop_empty:
        rows = rows.filter("key <> ''")
    out = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("ref").alias("refs")).filter(F.col("n").between(least, most))
    return out.filter("refs > 0 AND refs < n") if both else out


def members(rows: DataFrame, **limits) -> DataFrame:
    """The rows of the clusters to keep; nothing is collected, so a common key does no harm."""
    return rows.join(sizes(rows, **limits).select("key"), "key", "left_semi")


def cluster(rows: DataFrame, **limits) -> DataFrame:
    """(key, n, idents, docs): clusters with their members in order of ident and doc. Sizes are checked before lists are made."""
    pairs = members(rows, **limits).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ident", "doc"))).alias("m"))
    return pairs.select("key", F.size("m").alias("n"), F.col("m.ident").alias("idents"), F.col("m.doc").alias("docs"))


def cluster_apart(rows: DataFrame, least: int = 2, most: int = MOST, seen=None) -> DataFrame:
    """cluster() where most rows may have keys above ``most``: those are found by a sketch of the keys alone and go before documents are shuffled. ``seen``: an Observation, which gets the number of rows that are, as ``n``."""
    counters = saved(sketch(rows))
    # fewer than total / most keys can be above most
    kept = without(rows, hot_keys(rows, most, counters=counters), few=total(counters) <= most * WIDTH)
    if seen is not None:
        kept = kept.observe(seen, F.count(F.lit(1)).alias("n"))
    pairs = kept.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ident", "doc"))).alias("m")).filter(F.size("m") >= least)
    return pairs.select("key", F.size("m").alias("n"), F.col("m.ident").alias("idents"), F.col("m.doc").alias("docs"))


def stats(rows: DataFrame, mode: str = "default") -> DataFrame:
    """default: (key, n). count: (key, total, refs, nonrefs). unmatched: (key, n) of the clusters that hold references alone."""
    all_ = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("ref").alias("refs"))
    if mode == "count":
        return all_.select("key", F.col("n").alias("total"), "refs", (F.col("n") - F.col("refs")).alias("nonrefs"))
    if mode == "unmatched":
        all_ = all_.filter("refs = n")
    return all_.select("key", "n")


def first_of_cluster(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter("__r = 1").drop("__r")


def count_lines(lines: DataFrame) -> DataFrame:
    """(value, n): how often each line occurs."""
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
